import hashlib
import math
import random

import numpy as np

from barloom.llm import clustering

from ..conftest import SMALL

DIM = 64


def brute(vectors, k=40, rounds=5, dimensions=DIM, seed="2"):
    """(id, cluster, distance) and centroids by plain k-means over all centroids."""
    kept = []
    for vec_id, v in vectors:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [min(max(math.floor(256 * float(x)), -clustering.LIMIT), clustering.LIMIT) for x in v]))
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for turn in range(rounds + 1):
        out = []
        for vec_id, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            best = min(range(len(d)), key=lambda j: (d[j], j))
            out.append((vec_id, best, d[best], v))
        if turn < rounds:
            for c in range(len(centroids)):
                own = [v for _, best, _, v in out if best == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [r[:3] for r in out] if centroids else [], centroids


def same(spark, rows, **options):
    schema = "vec_id long, embedding array<float>, cluster string, x int, a int, id string"
    frame = spark.createDataFrame([(i, v, "c", 1, 2, "i") for i, v in rows], schema)
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]  # as floats
    found, centroids = clustering.cluster(frame.repartition(3), **options)
    want, means = brute(rows, **options)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)
    assert centroids.tolist() == means


def test_clusters_equal_plain_k_means(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.2, (9, 8))
    rows = [(k, (centres[k % 9] + rng.normal(0, 0.05, 8)).tolist()) for k in range(400)]
    same(spark, rows, k=12, rounds=6, dimensions=8)


def test_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(4)
    grid = [(k, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(4)]) for k in range(150)]  # many equal distances
    bad = [(900, None), (901, [0.1] * 3), (902, [0.1, None, 0.2, 0.3]), (903, [0.1, float("nan"), 0.2, 0.3]), (904, [float("inf")] * 4)]
    far = [(905, [3e30, -3e30, 0.0, 1.0]), (None, [0.25] * 4), (None, [0.25] * 4)]
    third = [(906 + k % 2, [0.5, 0.5, 0.5, 0.5]) for k in range(80)]
    same(spark, grid + bad + far + third, k=10, rounds=4, dimensions=4)


def test_fewer_rows_than_clusters(spark):
    same(spark, [(1, [0.1, 0.2])], k=5, rounds=2, dimensions=2)
    same(spark, [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [0.9, 0.2])], k=5, rounds=2, dimensions=2)
    same(spark, [(1, None)], k=5, rounds=2, dimensions=2)
    same(spark, [], k=5, rounds=2, dimensions=2)


def test_few_distances_are_compared():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-12, 13, (3000, 16))
    counted = []

    class Counted(clustering.Centroids):
        def squared(self, x, c):
            counted.append(len(x))
            return super().squared(x, c)

    a, b = np.zeros(3000, np.int32), np.ones(3000, np.int32)
    upper, lower = np.full(3000, 1e12), np.zeros(3000)
    before = None
    for _ in range(3):
        a, b, upper, lower = Counted(centres, before).assign(x, a, b, upper, lower)
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all()
        before = centres
        centres = np.array([x[a == c].mean(axis=0) // 1 if (a == c).any() else centres[c] for c in range(40)]).astype(np.int64)
    assert sum(counted) < 0.5 * 3 * 3000 * 40


def test_query_totals(spark):
    got = clustering.query(spark, SMALL).toPandas()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, means = brute(vectors)
    assert sorted(zip(got.vec_id, got.cluster, got.distance, strict=True)) == sorted(want)
    assert set(got.inertia) == {sum(r[2] for r in want)}
    for c, part in got.groupby("cluster"):
        assert set(part.cluster_inertia) == {part.distance.sum()}
        assert set(part.centroid_sha256) == {hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()}


def test_query_takes_unusable_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None), (2, [0.5] * 63)]):
        assert clustering.clusters(spark.createDataFrame(rows, schema)).collect() == []
