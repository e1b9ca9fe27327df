"""SimHash near-duplicates: candidate fingerprints meet by shared blocks, pivot distance tables discard, popcount verifies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WORD, documents, fresh, settle, small, with_columns
from barloom.llm.components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Widths of the fingerprint's blocks: four differing bits leave two of the six blocks intact.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Members of one bucket that a task compares; larger buckets are dealt out as pairs of slabs of half this size.
BUCKET = 4096
ROWS = 100_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _references(n: int) -> np.ndarray:
    """The reference fingerprints: a multiplicative sequence, well spread and the same everywhere."""
    out, x = [], 1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x ^ (x >> 31))
    return np.array(out, np.uint64)


REFERENCES = _references(16)


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; zero without a word."""
    words = WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: max(0, len(words) - SHINGLE)])]
    ends = ends[SHINGLE - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(ends), 65_536):
        block = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, name: str) -> DataFrame:
    """`docs` with its text column replaced by the fingerprint (a long) under `name`."""
    carry = [c for c in docs.columns if c != text]
    work = lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]
    return with_columns(docs, text, carry, [(name, "long", pa.int64())], work)


def _blocks() -> list[F.Column]:
    """One key per pair of blocks: the pair's number above the bits of both."""
    shift, parts = 0, []
    for width in BLOCKS:
        parts.append((F.shiftrightunsigned("fp", shift).bitwiseAND(2**width - 1), width))
        shift += width
    return [
        F.lit(k).cast("long") * 2**22 + a * 2**wb + b
        for k, ((a, _), (b, wb)) in enumerate(combinations(parts, 2))
    ]


def _joined_up(fp: np.ndarray, group: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each row the first row that it hangs together with in its group (rows sorted by group, then by `near`)."""
    table = np.bitwise_count(fp[:, None] ^ REFERENCES[None, 1:]).astype(np.int8)
    root = np.arange(len(fp))
    alive, step = np.arange(len(fp)), 0
    while True:
        step += 1
        alive = alive[alive < len(fp) - step]
        alive = alive[(group[alive] == group[alive + step]) & (near[alive + step] - near[alive] <= DISTANCE)]
        if not len(alive):
            return root
        left = alive
        for columns in (slice(0, 3), slice(3, 15)):
            gap = np.abs(table[left, columns] - table[left + step, columns]).max(axis=1)
            left = left[gap <= DISTANCE]
        left = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= DISTANCE]
        right = left + step
        while len(left):
            a, b = root[left], root[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]


def _forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, slabs, near, fp) sorted by bucket, slabs and near; out come edges of a spanning forest of each group."""
    waiting: list[pd.DataFrame] = []

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        ids = rows[["bucket", "slabs"]].to_numpy()
        group = np.concatenate([[0], (ids[1:] != ids[:-1]).any(axis=1).cumsum()])
        root = _joined_up(fp, group, rows["near"].to_numpy())
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"u": fp[moved].view(np.int64), "v": fp[root[moved]].view(np.int64)})

    for frame in frames:
        waiting.append(frame)
        if sum(map(len, waiting)) >= ROWS:
            rows = pd.concat(waiting, ignore_index=True)
            last = (rows["bucket"] == rows["bucket"].iloc[-1]) & (rows["slabs"] == rows["slabs"].iloc[-1])
            waiting = [rows[last]]
            if not last.all():
                yield close(rows[~last])
    if waiting and sum(map(len, waiting)):
        yield close(pd.concat(waiting, ignore_index=True))


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) whose components are those of all links.

    Within the distance, two fingerprints agree in at least two of six blocks, so equality of a block pair brings every
    link together. A bucket's members are sorted by their distance to the first reference; those further apart than the
    bound are never paired, and the other reference distances discard more pairs before bits are counted. Buckets over
    `BUCKET` members are dealt into slabs, and each pair of slabs is a group of its own. A group gives the edges of a
    spanning forest, never all its pairs.
    """
    first = int(REFERENCES[:1].view(np.int64)[0])
    keyed = prints.select("fp", F.explode(F.array(*_blocks())).alias("bucket"))
    hot = small(keyed.groupBy("bucket").count().filter(F.col("count") > BUCKET))
    dealt = keyed.join(hot, "bucket", "left")
    slabs = F.ceil(F.col("count") / (BUCKET // 2)).cast("long")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), slabs)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), slabs - 1), lambda j: F.least(own, j) * slabs + F.greatest(own, j))
    dealt = dealt.select(
        "bucket",
        "fp",
        F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("slabs"),
        F.bit_count(F.col("fp").bitwiseXOR(F.lit(first))).cast("int").alias("near"),
    )
    grouped = dealt.repartition("bucket", "slabs").sortWithinPartitions("bucket", "slabs", "near")
    return grouped.mapInPandas(_forests, "u long, v long")


def near_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, row_id: str | None = None
) -> DataFrame:
    """Rows (columns `carry`, by default the id alone) with fingerprint, component_id and kept.

    Lower-cased (A-Z) words, shingles of four words, repeats included; a text of fewer words is one shingle, one without
    words (null, empty or blank) has fingerprint zero and is linked like any other. Fingerprints link at `DISTANCE` or fewer
    differing bits; component_id is the smallest id reachable. Of a component one row is kept: the smallest id, and of rows
    repeating that id the first. Existing columns of these names are replaced. An empty table gives an empty one.

    `row_id` names a column that tells rows apart and is the same in every scan: only it, the id and the fingerprint are then
    written, and `carry` is joined to them. Without one, rows are numbered once and written with `carry`.
    """
    carry = [c for c in ([doc_id] if carry is None else carry) if c.lower() not in ("fingerprint", "component_id", "kept")]
    names = fresh(["row", "id", "text", "fp"], *(f"c{k}" for k in range(len(carry))))
    carried = [F.col(c).alias(n) for c, n in zip(carry, names, strict=True)]
    row = (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row")
    rows = docs.select(row, F.col(doc_id).alias("id"), F.col(text).alias("text"), *([] if row_id else carried))
    marked = settle(fingerprints(rows, "text", "fp"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    distinct = settle(marked.groupBy("fp").agg(least))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = placed.groupBy("root").agg(F.min("least").alias("best"))
    of = settle(placed.select("fp", "root").join(best, "root").select("fp", "best"))  # so that a hot fingerprint can be split
    decided = marked.join(of, "fp")
    if row_id:
        decided = docs.select(row, *carried).join(decided, "row")
    return decided.select(
        *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"),
        (F.col("best.row") == F.col("row")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")
