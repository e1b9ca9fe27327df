"""Packing of token sequences: best fit, then local search by moves and swaps that empties bins."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, fresh, settle, slices
from barloom.llm.encoding import encoder

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END = b"\0\0\0\0"
#: Pieces that are packed together. Bins never cross shards, so a shard costs half a bin on average.
SHARD_ROWS = 8192
#: Steps of the search that may go by without emptying a bin, and bins considered as givers in one step.
PATIENCE = 400


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each piece, largest first, each into the fullest bin that has room."""
    place = np.empty(len(sizes), np.int64)
    room: list[tuple[int, int]] = []
    bins = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            free, b = capacity, bins
            bins += 1
        else:
            free, b = room.pop(at)
        place[k] = b
        if free > size:
            insort(room, (free - size, b))
    return place, bins


class Search:
    """Moves, one-for-one and two-for-one exchanges between underfull bins, each raising the sum of squared fills."""

    def __init__(self, sizes: np.ndarray, place: np.ndarray, bins: int, capacity: int) -> None:
        self.sizes, self.place, self.capacity = sizes.astype(np.int64), place.copy(), capacity
        self.fill = np.bincount(place, sizes, bins).astype(np.int64)

    def _step(self, giver: int) -> bool:
        """Apply the change that fills a receiver most with pieces of `giver`; False if none raises the squared fill."""
        own = np.flatnonzero(self.place == giver)
        under = (self.fill < self.capacity) & (self.fill > 0)
        under[giver] = False
        free = np.where(under, self.capacity - self.fill, 0)
        best: tuple[int, int, tuple[int, ...], int, int] | None = None  # squared gain, receiver, given, taken (-1: none), delta
        others = np.flatnonzero(under[self.place])
        other_size, other_bin = self.sizes[others], self.place[others]
        order = np.argsort(-self.sizes[own], kind="stable")
        own = own[order][:64]
        groups = [(int(k),) for k in own]
        groups += [(int(a), int(b)) for i, a in enumerate(own[:12]) for b in own[i + 1 : 12]]
        for group in groups:
            size = int(self.sizes[list(group)].sum())
            if len(group) == 1:
                fits = np.flatnonzero(free >= size)
                if len(fits):
                    b = int(fits[np.argmax(self.fill[fits])])
                    gain = 2 * size * (int(self.fill[b]) - int(self.fill[giver]) + size)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, b, group, -1, size)
            delta = size - other_size
            fine = np.flatnonzero((delta > 0) & (delta <= free[other_bin]))
            if len(fine):
                d = delta[fine]
                gains = 2 * d * (self.fill[other_bin[fine]] - self.fill[giver] + d)
                k = int(np.argmax(gains))
                if gains[k] > 0 and (best is None or gains[k] > best[0]):
                    best = (int(gains[k]), int(other_bin[fine[k]]), group, int(others[fine[k]]), int(d[k]))
        if best is None:
            return False
        _, receiver, given, taken, delta = best
        self.place[list(given)] = receiver
        if taken >= 0:
            self.place[taken] = giver
        self.fill[receiver] += delta
        self.fill[giver] -= delta
        return True

    def run(self) -> np.ndarray:
        """Empty one bin after another, the emptiest first, until none has given anything for a while."""
        stuck: set[int] = set()
        steps = 0
        while steps < PATIENCE:
            total = int((self.capacity - self.fill[self.fill > 0]).sum())
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            open_ = [int(b) for b in open_[np.argsort(self.fill[open_], kind="stable")] if int(b) not in stuck]
            if total < self.capacity or not open_:
                break  # no bin can be saved: all gaps together are less than one, or nothing moves any more
            giver = open_[0]
            if self._step(giver):
                stuck.clear()
                steps = 0 if self.fill[giver] == 0 else steps + 1
            else:
                stuck.add(giver)
                steps += 1
        return self.place


def pack_shard(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each piece. Bins that best fit has filled are left alone."""
    place, bins = best_fit(sizes, capacity)
    return Search(sizes, place, bins, capacity).run() if bins > 1 else place


def pieces(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Every document as one piece, or cut from the end into pieces of `CAPACITY` tokens, the first one with the rest."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [doc_id, "piece", "start", "length", "ids_crc32"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 4 * CAPACITY
        for batch in slices(batches, text):
            rows = []
            for row, ids in enumerate(encoder(TOKENIZER).ids(batch.column(text).to_pylist())):
                ids += END
                cuts = [0, *range(len(ids) % width or width, len(ids), width), len(ids)]
                rows += [(row, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            of, *columns = zip(*rows, strict=True)
            new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).take(pa.array(of)), *new], names)

    schema = f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows that repeat an id are packed as documents of their own. An empty table
    gives an empty one. Pieces of full length are sequences by themselves; the others are dealt at random, without regard
    to any key, into shards of about `SHARD_ROWS`, each packed by a task that holds only their lengths.
    """
    cut = settle(pieces(docs, text, doc_id))
    open_ = cut.filter(F.col("length") < CAPACITY)
    shards = max(1, -(-open_.count() // SHARD_ROWS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        shard = rows.column(name)[0].as_py()
        sizes = rows.column("length").to_numpy()
        place = pack_shard(sizes)
        order = np.argsort(place, kind="stable")
        place, sizes = place[order], sizes[order]
        before = np.cumsum(sizes) - sizes
        first = np.concatenate([[True], place[1:] != place[:-1]])
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        out = rows.drop_columns([name]).take(pa.array(order))
        out = out.append_column("sequence_id", pa.array(2 * (place + (shard << 32)), pa.int64()))
        yield from out.append_column("offset", pa.array(offset, pa.int64())).to_batches()

    (name,) = fresh(cut.columns, "shard")
    packed = open_.repartition(shards).withColumn(name, F.spark_partition_id()).mapInArrow(run, schema)
    full = cut.filter(F.col("length") == CAPACITY).select(
        *cut.columns, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
