"""Exact k-means over integer vectors: bounds with the second-nearest centroid, and a search ball that shrinks while it is scanned."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import settle

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = "2"
#: Components are held within this, so that a squared distance of 64 components fits a long.
LIMIT = 2**27 - 1


def _up(x: np.ndarray) -> np.ndarray:
    """At least the exact value of a rounded bound."""
    return x * (1 + 1e-12) + 1e-9


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-12) - 1e-9


class Centroids:
    """Integer centroids with their distances from each other, each one's neighbours in order, and how far they just moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None) -> None:
        self.now = now
        self.gap = np.sqrt(((now[:, None] - now[None]) ** 2).sum(axis=2).astype(float))
        np.fill_diagonal(self.gap, -1.0)  # itself first, even among equal centroids
        self.order = np.argsort(self.gap, axis=1, kind="stable")
        k = len(now)
        self.half = _down(self.gap[np.arange(k), self.order[:, 1]] / 2) if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((now - before) ** 2).sum(axis=1).astype(float))
        self.moved = _up(moved)
        most = np.argsort(moved, kind="stable")[::-1]
        self.others = np.full(k, self.moved[most[0]])  # the largest move of any other centroid
        if k > 1:
            self.others[most[0]] = self.moved[most[1]]

    def squared(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((x - self.now[c]) ** 2).sum(axis=1)

    def assign(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """New nearest and second-nearest centroid and the two bounds of each vector, from those of the round before.

        A vector whose upper bound is below its lower one, or below half the way to the next centroid, keeps its centroid. For the
        others the scan starts at the closer of the two remembered centroids and follows its sorted neighbours, as far as the
        ball that the present second distance allows. Bounds are rounded outwards; what they leave open is compared in integers.
        """
        a, b = a.copy(), b.copy()
        upper, lower = _up(upper + self.moved[a]), _down(lower - self.others[a])
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[a]))
        first = self.squared(x[open_], a[open_])
        upper[open_] = _up(np.sqrt(first.astype(float)))
        still = upper[open_] >= np.maximum(lower[open_], self.half[a[open_]])
        rows, first = open_[still], first[still]
        if len(self.now) == 1 or not len(rows):
            return a, b, upper, lower
        home, other = a[rows], b[rows]
        second = self.squared(x[rows], other)
        swap = (second < first) | ((second == first) & (other < home))
        home, other = np.where(swap, other, home), np.where(swap, home, other)
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        start, skip, near = home.copy(), other.copy(), np.sqrt(first.astype(float))
        alive = np.arange(len(rows))
        for step in range(1, len(self.now)):
            c = self.order[start[alive], step]
            within = self.gap[start[alive], c] <= _up(near[alive] + np.sqrt(second[alive].astype(float)))
            alive, c = alive[within], c[within]
            if not len(alive):
                break
            fresh = c != skip[alive]
            at, c = alive[fresh], c[fresh]
            d = self.squared(x[rows[at]], c)
            best = (d < first[at]) | ((d == first[at]) & (c < home[at]))
            middle = ~best & ((d < second[at]) | ((d == second[at]) & (c < other[at])))
            won, came = at[best], at[middle]
            other[won], second[won] = home[won], first[won]
            home[won], first[won] = c[best], d[best]
            other[came], second[came] = c[middle], d[middle]
        a[rows], b[rows] = home, other
        upper[rows], lower[rows] = _up(np.sqrt(first.astype(float))), _down(np.sqrt(second.astype(float)))
        return a, b, upper, lower


STATE = {"x": "array<int>", "a": "int", "b": "int", "upper": "double", "lower": "double"}


def _assigned(state: DataFrame, model: Centroids, distance: bool = False) -> DataFrame:
    """`state` after an assignment round; with `distance`, the exact squared distance instead of bounds."""
    spread = state.sparkSession.sparkContext.broadcast(model)  # k rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            if not batch.num_rows:
                continue
            a, b, upper, lower = model.assign(x, *(batch.column(c).to_numpy() for c in ("a", "b", "upper", "lower")))
            if distance:
                made = [batch.column("id"), pa.array(a, pa.int32()), pa.array(model.squared(x, a))]
                yield pa.RecordBatch.from_arrays(made, ["id", "cluster", "distance"])
            else:
                made = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), *made], ["id", *STATE])

    kind = state.schema["id"].dataType.simpleString()
    rest = "cluster int, distance long" if distance else ", ".join(f"{n} {k}" for n, k in STATE.items())
    return state.mapInArrow(run, f"id {kind}, {rest}")


def integers(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """floor(256 * x) of each component; null unless all of them are there and finite."""
    good = (F.size(vector) == dimensions) & F.forall(vector, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    limit = F.lit(float(LIMIT))
    return F.when(good, F.transform(vector, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, limit), -limit)).cast("int")))


def cluster(
    vectors: DataFrame,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each usable vector, and the final centroids.

    Vectors with another number of components, or any that is null or not finite, are left out. Components beyond `LIMIT` after scaling
    are held there, as no squared distance would fit a long. Centroids start as the vectors of the `k` smallest hashes of seed and
    id (a null id is hashed as an empty one; of rows with one id the smaller vector comes first); with fewer rows there are fewer
    centroids, with none the result is empty. Equal distances go to the smaller number, an empty cluster keeps its centroid.
    Repeated rows count each. Other columns are ignored, whatever their names.

    Each round reads one written table of vectors with their bounds; means come from partial sums, k rows reach the driver.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(vec_id).alias("id"), integers(F.col(vector), dimensions).alias("x")).filter("x is not null")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    start = usable.orderBy(F.sha2(text, 256), "x").limit(k).select("x").collect()
    now = np.array([r["x"] for r in start], np.int64).reshape(-1, dimensions)
    if not len(now):
        return usable.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), now
    second = min(1, len(now) - 1)
    nothing = float(8 * LIMIT * dimensions**0.5)  # beyond any distance
    state = usable.select("id", "x", F.lit(0).alias("a"), F.lit(second).alias("b"), F.lit(nothing).alias("upper"), F.lit(0.0).alias("lower"))
    model = Centroids(now)
    sums = [F.sum(F.col("x")[i].cast("long")) for i in range(dimensions)]
    for _ in range(rounds):
        state = settle(_assigned(state, model))
        found = state.groupBy("a").agg(F.count("*"), *sums).collect()
        new = now.copy()
        for row in found:
            new[row[0]] = [s // row[1] for s in row[2:]]
        model, now = Centroids(new, now), new
    return settle(_assigned(state, model, distance=True)), now


def clusters(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): `cluster`'s rows with the totals of each cluster and of all.

    A total beyond a long is null.
    """
    found, centroids = cluster(vectors, vector, vec_id)
    spark = vectors.sparkSession
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}

    def long(n: int) -> int | None:
        return n if n < 2**63 else None

    rows = [
        (c, long(n), long(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in sums.items()
    ]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(totals), "cluster")  # a row for each centroid
    return out.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Every round as two subqueries: the nearest centroid of each vector, then the floored means."""
    good = f"len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMENSIONS}"
    whole = f"list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT)"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, {whole} AS x FROM embeddings WHERE {good})",
        "parts AS MATERIALIZED (SELECT row, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c, x FROM kept"
        f" QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) <= {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        parts.append(
            f"e{k} AS MATERIALIZED (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM c{k}),"
            f" d{k} AS (SELECT row, c, sum((p.v - e.v) * (p.v - e.v)) AS d FROM parts p JOIN e{k} e USING (i) GROUP BY ALL),"
            f" a{k} AS MATERIALIZED (SELECT row, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"
        )
        if k < ROUNDS:
            total, n = "sum(v)::BIGINT", "count(*)"
            floor = f"(({total} - ((({total}) % {n}) + {n}) % {n}) // {n})"
            parts.append(
                f"m{k} AS (SELECT c, i, {floor} AS v FROM a{k} JOIN parts USING (row) GROUP BY ALL),"
                f" n{k} AS (SELECT c, list(v ORDER BY i) AS x FROM m{k} GROUP BY ALL),"
                f" c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n.x, o.x) AS x FROM c{k} o LEFT JOIN n{k} n USING (c))"
            )
    last = f"a{ROUNDS}"
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM {last} JOIN c{ROUNDS} f USING (c) JOIN kept USING (row)
"""


SQL = _sql()
