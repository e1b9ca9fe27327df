"""Removal of repeated byte passages: texts meet at common anchors, and Burrows-Wheeler orders are merged column by column."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import documents, fresh, scratch, settle, small, with_columns

#: Length of a repeat, of an anchor, and the bytes that a window can have before its anchor.
REPEAT = 200
ANCHOR = 40
LEFT = REPEAT - ANCHOR
WIDTH = LEFT + REPEAT
#: Different surroundings of one anchor that a task merges; those of commoner anchors are split by window.
GROUP = 20_000
ROWS = 24_000
OUTSIDE = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = 1 << 16


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    out = []
    for factor in (_BASE, _BACK):
        x = np.full(n, factor, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """`pick` over every `width` neighbours, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and hash of the surroundings of each anchor.

    Every window of `REPEAT` bytes has as anchors its `ANCHOR`-byte strings of smallest hash. They depend on its
    bytes alone, so equal windows have the same anchors at the same places.
    """
    n = len(content)
    if n < REPEAT:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    size = max(_POWERS, 1 << (n + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(content, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    least = _sliding(h, LEFT + 1, np.minimum)  # by window
    padded = np.zeros(len(least) + 2 * LEFT, np.uint64)
    padded[LEFT : LEFT + len(least)] = least
    at = np.flatnonzero(h == _sliding(padded, LEFT + 1, np.maximum))
    lo, hi = np.maximum(at - LEFT, 0), np.minimum(at + REPEAT, n)
    around = _mix((sums[hi] - sums[lo]) * down[lo]) + (at - lo).astype(np.uint64) * np.uint64(1_000_003) + (hi - at).astype(np.uint64)
    return at, h[at], _mix(around)


def _find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [anchors(c) for c in frame["content"]]
        counts = [len(at) for at, _, _ in found]
        at, a, c = (np.concatenate(x) if x else np.zeros(0) for x in zip(*found, strict=True))
        rows = np.repeat(frame["rid"].to_numpy(), counts)
        yield pd.DataFrame({"rid": rows, "at": at.astype(np.int64), "a": a.view(np.int64), "c": c.view(np.int64)})


def repeated(columns: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows (LEFT + 1, rows) of the given texts (WIDTH, rows), aligned at their groups' anchors, are repeated.

    Each text is a shard whose own order is trivial. The interleave of a group's texts by what follows column c + 1 is
    refined to the one by what follows column c, by the last-to-first step of Burrows-Wheeler transforms: a stable
    distribution by the byte at c. The common prefixes of neighbours follow from the earlier ones by minima over ranges,
    and no suffix is sorted. A window starting at c is repeated if its prefix in common with a neighbour covers it.
    """
    n = columns.shape[1]
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int32)
    common[n] = np.iinfo(np.int32).max
    out = np.zeros((LEFT + 1, n), bool)
    for c in range(WIDTH - 1, -1, -1):
        byte = columns[c][order]
        step = np.argsort(byte, kind="stable")
        step = step[np.argsort(group[order[step]], kind="stable")]
        new_order = order[step]
        new_byte, new_group = byte[step], group[new_order]
        before, after = step[:-1], step[1:]
        same = (new_byte[1:] == new_byte[:-1]) & (new_group[1:] == new_group[:-1])
        new = np.zeros(n + 1, np.int32)
        new[n] = common[n]
        new[1:n] = np.where(same, common[after] + 1, 0)
        far = np.flatnonzero(same & (after != before + 1))
        if len(far):
            ranges = np.stack([before[far] + 1, after[far] + 1], axis=1).ravel()
            new[far + 1] = np.minimum.reduceat(common, ranges)[::2] + 1
        order, common = new_order, new
        if c <= LEFT:
            following = np.append(common[1:n], 0)
            out[c, order] = np.maximum(common[:n], following) >= REPEAT
    return out


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, c, before, part) sorted by a; out come (a, c, lo, hi): the stretch around the anchor that is repeated."""
    waiting: list[pd.DataFrame] = []

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        texts = np.full((len(rows), WIDTH), OUTSIDE, np.uint16)
        before = rows["before"].to_numpy()
        sizes = rows["part"].map(len).to_numpy()
        for k, (b, part) in enumerate(zip(before.tolist(), rows["part"], strict=True)):
            texts[k, LEFT - b : LEFT - b + len(part)] = np.frombuffer(part, np.uint8)
        a = rows["a"].to_numpy()
        group = np.concatenate([[0], (a[1:] != a[:-1]).cumsum()]).astype(np.uint16)
        found = repeated(np.ascontiguousarray(texts.T), group).T
        place = np.arange(LEFT + 1)[None, :]
        found &= (place >= LEFT - before[:, None]) & (place + REPEAT <= (LEFT - before + sizes)[:, None])
        any_ = found.any(axis=1)
        lo = found.argmax(axis=1) - LEFT
        hi = LEFT - found[:, ::-1].argmax(axis=1) + REPEAT - LEFT
        return pd.DataFrame({"a": a, "c": rows["c"], "lo": lo.astype(np.int64), "hi": hi.astype(np.int64)})[any_]

    for frame in frames:
        waiting.append(frame)
        if sum(map(len, waiting)) >= ROWS:
            rows = pd.concat(waiting, ignore_index=True)
            last = (rows["a"] == rows["a"].iloc[-1]).to_numpy()
            waiting = [rows[last]]
            if not last.all():
                yield close(rows[~last].reset_index(drop=True))
    if waiting and sum(map(len, waiting)):
        yield close(pd.concat(waiting, ignore_index=True))


def _windows(parts: DataFrame) -> DataFrame:
    """The same (a, c, lo, hi) for anchors with very many surroundings: each window is a row, counted by its hashes."""
    most = F.least(F.lit(LEFT), F.col("before"), F.octet_length("part") - REPEAT)
    rows = parts.filter(F.octet_length("part") >= REPEAT).withColumn(
        "s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("before") - LEFT), F.greatest(F.lit(0), most)))
    )
    rows = rows.filter((F.col("s") <= F.col("before")) & (F.col("s") + REPEAT <= F.octet_length("part")))
    window = F.substring(F.col("part"), F.col("s") + 1, F.lit(REPEAT))
    rows = rows.select("a", "c", (F.col("s") - F.col("before")).alias("lo"), F.xxhash64(window).alias("w"), F.xxhash64(window, F.lit(1)).alias("v"))
    twice = rows.groupBy("a", "lo", "w", "v").count().filter("count > 1").drop("count")
    found = rows.join(twice, ["a", "lo", "w", "v"]).groupBy("a", "c")
    return found.agg(F.min("lo").cast("long").alias("lo"), (F.max("lo") + REPEAT).cast("long").alias("hi"))


def covered(base: DataFrame) -> DataFrame:
    """(rid, lo, hi): stretches of base(rid, content) whose union is what repeats cover; ends may lie outside the text.

    1. Anchors are counted by hash, and those that occur once are dropped: no window there is repeated.
    2. Where an anchor's surroundings (all windows that hold it) occur twice, all of them are repeated.
    3. The other surroundings, one row for each different one, are merged anchor by anchor. Anchors with more than `GROUP`
       of them are split by window.
    """
    found = base.select("rid", "content").mapInPandas(_find, "rid long, at long, a long, c long")
    counts = found.groupBy("a").agg(F.count("*").alias("total"), F.min("c").alias("first"), F.max("c").alias("last"))
    # written first, so that Spark can split a hot anchor's side of the join
    counts = settle(counts.filter("total > 1").select("a", (F.col("first") != F.col("last")).alias("mixed")))
    common = settle(found.join(counts, "a"))
    kinds = common.filter("mixed").groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one"))
    kinds = settle(kinds.select("a", "c", "n", "one.rid", "one.at"))
    hot = small(kinds.groupBy("a").count().filter(F.col("count") > GROUP).select("a", F.lit(True).alias("hot")))
    before = F.least(F.lit(LEFT), F.col("at"))
    part = F.substring(F.col("content"), (F.col("at") - before + 1).cast("int"), (before + REPEAT).cast("int"))
    parts = kinds.join(base.select("rid", "content"), "rid").select("a", "c", before.cast("int").alias("before"), part.alias("part"))
    if hot.isEmpty():
        split = None
    else:
        parts = settle(parts.join(hot, "a", "left"))
        split = _windows(parts.filter("hot").drop("hot"))
        parts = parts.filter("hot is null").drop("hot")
    merged = parts.repartition("a").sortWithinPartitions("a").mapInPandas(_merge, "a long, c long, lo long, hi long")
    merged = merged if split is None else merged.unionByName(split)
    again = kinds.filter("n > 1").select("a", "c", F.lit(-LEFT).cast("long").alias("lo"), F.lit(REPEAT).cast("long").alias("hi"))
    single = merged.join(kinds.filter("n = 1").select("a", "c"), ["a", "c"], "left_semi")
    partly = common.filter("mixed").join(settle(single.unionByName(again)), ["a", "c"])
    wholly = common.filter("not mixed").withColumns({"lo": F.lit(-LEFT).cast("long"), "hi": F.lit(REPEAT).cast("long")})
    both = partly.select("rid", "at", "lo", "hi").unionByName(wholly.select("rid", "at", "lo", "hi"))
    return both.select("rid", F.greatest(F.lit(0), F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))


def cut(content: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and the bytes left."""
    if not len(starts):
        return 0, 0, content
    order = np.argsort(starts)
    lo, hi = starts[order], np.maximum.accumulate(np.minimum(ends[order], len(content)))
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    first, last = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
    kept = [content[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(content)], strict=True)]
    return int((last - first).sum()), len(first), b"".join(kept)


def remove_repeats(docs: DataFrame, text: str = "text", carry: list[str] | None = None, texts: str | None = None) -> DataFrame:
    """Rows (columns `carry`, by default all but the text) with n_bytes, n_removed, n_spans and kept_sha256.

    Every byte covered by a string of `REPEAT` bytes that starts at another place too, in any text or the same one,
    is removed; all is judged on the input. Null texts are empty; texts under `REPEAT` bytes stay. With `texts`, that column
    has what is left (bytes of a character cut in two are dropped). Columns of these names are replaced. Identical
    rows are repeats of each other. An empty table gives an empty one.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([texts] if texts else [])]
    carry = [c for c in (docs.columns if carry is None else carry) if c != text and c.lower() not in made]
    names = fresh([*made, "lo", "hi", "rid", "content", "spans"], *(f"c{k}" for k in range(len(carry))))
    spark = docs.sparkSession
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("content"),
        *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)),
    )
    # one table, bucketed by row, is read by all steps: texts are shuffled once
    parts, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"barloom_{uuid.uuid4().hex}"
    base.repartition(parts, "rid").write.option("path", scratch(spark)).bucketBy(parts, "rid").saveAsTable(table)
    base = spark.table(table)
    spans = covered(base).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    spans = spans.select("rid", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))

    def work(contents: list, lows: list, highs: list) -> list:
        rows = []
        for content, lo, hi in zip(contents, lows, highs, strict=True):
            removed, runs, kept = cut(content, np.array(lo or [], np.int64), np.array(hi or [], np.int64))
            rest = [kept.decode("utf-8", "ignore")] if texts else []
            rows.append([len(content), removed, runs, hashlib.sha256(kept).hexdigest(), *rest])
        return list(zip(*rows, strict=True))

    columns = [(c, "long", pa.int64()) for c in made[:3]] + [(c, "string", pa.string()) for c in made[3:]]
    result = with_columns(base.join(spans, "rid", "left"), "content", names, columns, work, also=["lo", "hi"])
    return result.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), *made)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
