"""Token-id files compressed by Re-Pair grammars, decodable at any place by expansion lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import documents, fresh, scratch, slices
from barloom.llm.encoding import encoder

TOKENIZER = "word_bpe_49k.json"
END = (2).to_bytes(4, "little")
#: The vocabulary's ids; nonterminals take the remaining 16-bit numbers.
TERMINALS = 49_408
SYMBOLS = 65_536
#: Tokens of a grammar, at least (a document is never split). Rounds go on until no pair is replaced as often as LEAST
#: times; a rule takes 8 bytes and saves 2 a place, so rarer ones would not shorten the file.
BLOCK = 1_500_000
LEAST = 5
#: A round takes pairs at least about 1/SPAN as frequent as its most frequent one.
SPAN = 8


def _slices(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of slices that start at `begin` and hold `size` places, one slice after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - (upto - size), size) + np.arange(size.sum())


class Pairs:
    """Pairs of neighbours that may occur LEAST times, by kind: key (both symbols), count, and the places it was found at.

    `kind` is that of the pair at each place (0: a rarer one, or none), so a place listed before it changed is told apart.
    """

    def __init__(self, n: int) -> None:
        self.kind = np.zeros(n + 1, np.int32)
        self.key, self.count, self.begin, self.size = (np.zeros(1, np.int64) for _ in range(4))
        # n at first, and two new pairs beside each of fewer than n replacements
        self.places = np.empty(3 * n, np.int32)
        self.filled = 0

    def add(self, at: np.ndarray, pair: np.ndarray) -> None:
        """Pairs that none of the known ones equals, at places without one."""
        both = np.sort((pair.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64))
        pair = (both >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        size = np.diff(np.append(first, len(pair)))
        often = size >= LEAST
        at = both[np.repeat(often, size)].astype(np.uint32)
        first, size = first[often], size[often]
        self.kind[at] = np.repeat(np.arange(len(self.key), len(self.key) + len(size), dtype=np.int32), size)
        self.places[self.filled : self.filled + len(at)] = at
        self.key, self.count, self.size = (np.append(x, y) for x, y in ((self.key, pair[first]), (self.count, size), (self.size, size)))
        self.begin = np.append(self.begin, self.filled + np.cumsum(size) - size)
        self.filled += len(at)

    def drop(self, at: np.ndarray) -> None:
        """No pairs at these places any more."""
        self.count -= np.bincount(self.kind[at], minlength=len(self.count))
        self.kind[at] = 0

    def where(self, kinds: np.ndarray) -> np.ndarray:
        """The places of pairs of these kinds, ascending."""
        at = np.sort(self.places[_slices(self.begin[kinds], self.size[kinds])])
        wanted = np.zeros(len(self.key), bool)
        wanted[kinds] = True
        live = wanted[self.kind[at]]
        live[1:] &= at[1:] != at[:-1]
        return at[live]


def compress(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules (n, 2), expansion lengths (n,)): frequent neighbours replaced by nonterminals, round by round.

    A round replaces the pairs that are about as frequent as the most frequent one. Where two of them overlap, the more
    frequent one wins and the other is taken up in a later round. In a run of equal symbols every second place is counted
    and replaced. Rounds end when no pair is frequent, or when all numbers are given. A replacement makes new pairs beside
    it only and no other pair more frequent: so the sequence is counted once, then only what is beside replaced places.
    Symbols stay at their places, linked to the next and the last one that is left; place n is beyond either end.
    """
    n = len(seq)
    seq = np.append(np.asarray(seq, np.uint16), np.uint16(0))
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    before[0] = n
    left = np.ones(n, bool)
    score = np.zeros(n + 1, np.int32)
    rules: list[np.ndarray] = []
    lengths = np.ones(TERMINALS, np.int64)

    def joined(at: np.ndarray) -> np.ndarray:
        return (seq[at].astype(np.uint32) << np.uint32(16)) | seq[after[at]]

    known = Pairs(n)
    pair = joined(np.arange(n - 1))
    bucket = (pair * np.uint32(2654435761)) >> np.uint32(12)
    heavy = np.flatnonzero((np.bincount(bucket, minlength=1 << 20) >= LEAST)[bucket])
    known.add(heavy, pair[heavy])
    while room := SYMBOLS - len(lengths):
        counts = known.count.copy()
        counts[0] = 0
        runs = known.where(np.flatnonzero((counts >= LEAST) & (known.key >> 16 == known.key & 0xFFFF)))
        order = np.arange(len(runs))
        starts = np.append(True, after[runs[:-1]] != runs[1:])[: len(runs)]
        skipped = runs[(order - np.maximum.accumulate(np.where(starts, order, 0))) % 2 == 1]
        counts -= np.bincount(known.kind[skipped], minlength=len(counts))
        best = np.flatnonzero(counts >= max(LEAST, int(counts.max()) // SPAN))
        best = best[np.argsort(known.key[best] - (counts[best] << 32))][:room]
        if not len(best):
            break
        rank = np.zeros(len(counts), np.int32)
        rank[best] = np.arange(len(best), 0, -1)
        at = known.where(best)
        own = rank[known.kind[at]]
        score[at] = own
        score[skipped] = 0
        won = (score[at] > score[before[at]]) & (score[at] >= score[after[at]])
        score[at] = 0
        at, own = at[won], own[won]
        used = np.bincount(own, minlength=len(best) + 1)
        worth = np.flatnonzero(used >= LEAST)[::-1]  # by falling rank, so the most frequent first
        fresh = len(lengths)
        number = np.zeros(len(best) + 1, np.int64)
        number[worth] = fresh + np.arange(len(worth))
        at, own = at[number[own] > 0], own[number[own] > 0]
        made = known.key[best[len(best) - worth]]
        rules.append(np.stack([made >> 16, made & 0xFFFF], axis=1))
        lengths = np.concatenate([lengths, lengths[rules[-1]].sum(axis=1)])
        gone = after[at]
        for places in (at, gone, before[at]):
            known.drop(places)
        seq[at] = number[own]
        left[gone] = False
        onward = after[gone]
        after[at] = onward
        before[onward] = at
        beside = before[at]
        changed = np.sort(np.concatenate([at, beside[(beside < n) & (seq[beside] < fresh)]]))
        changed = changed[after[changed] < n]
        known.add(changed, joined(changed))
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq[:-1][left], table.astype(np.uint16), lengths[TERMINALS:].astype(np.uint32)


class Grammar:
    """A block read back: decodes any stretch of its tokens without the rest."""

    def __init__(self, sequence: bytes, rules: bytes, lengths: bytes) -> None:
        self.sequence = np.frombuffer(sequence, "<u2")
        table = np.frombuffer(rules, "<u2").reshape(-1, 2)
        self.length = np.concatenate([np.ones(TERMINALS, np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)])
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.zeros(self.length.sum(), "<u4")
        self.flat[:TERMINALS] = np.arange(TERMINALS)
        told = np.arange(len(self.length)) < TERMINALS
        rules = np.arange(len(table))
        while len(rules):  # those whose both symbols are expanded
            ready = told[table[rules]].all(axis=1)
            symbols = rules[ready] + TERMINALS
            a, b = table[rules[ready]].astype(np.int64).T
            for part, at in ((a, self.first[symbols]), (b, self.first[symbols] + self.length[a])):
                self.flat[_slices(at, self.length[part])] = self.flat[_slices(self.first[part], self.length[part])]
            told[symbols] = True
            rules = rules[~ready]
        self.ends = np.cumsum(self.length[self.sequence])

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Tokens from `start` up to `stop`."""
        if stop <= start:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        symbols = self.sequence[a:b]
        sizes = self.length[symbols]
        upto = np.cumsum(sizes)
        out = self.flat[np.repeat(self.first[symbols] - (upto - sizes), sizes) + np.arange(upto[-1])]
        skip = start - (self.ends[a] - sizes[0])
        return out[skip : skip + stop - start]


def write(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of all texts in ascending id order as blocks of (shard, block, ids, sizes, grammar).

    Each shard is a range of ids, written by one task in blocks of bounded size. Rows are ranged by id and then by their
    place in the input, so that a repeated id is no hot key. Null ids come first. Null texts are empty: the end id alone.
    """
    order, whole = fresh([doc_id, "shard"], "order", "whole")
    rows = docs.select(doc_id, F.col(text).alias(whole), F.monotonically_increasing_id().alias(order))
    rows = rows.repartitionByRange(F.col(doc_id).asc(), F.col(order).asc()).sortWithinPartitions(doc_id, order)
    kind = docs.schema[doc_id].dataType.simpleString()

    names = ["shard", "block", "before", "ids", "sizes", "sequence", "rules", "lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        keys: list[pa.Array] = []

        def close() -> pa.RecordBatch:
            nonlocal block, before
            joined = np.frombuffer(b"".join(ids), "<u4")
            sequence, rules, lengths = compress(joined)
            sizes = [len(x) // 4 for x in ids]
            binary = [x.tobytes() for x in (sequence.astype("<u2"), rules.astype("<u2"), lengths.astype("<u4"))]
            numbers = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64())]
            of = pa.concat_arrays(keys)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of), pa.array([sizes], pa.list_(pa.int64()))]
            row = pa.RecordBatch.from_arrays([*numbers, *lists, *(pa.array([x], pa.binary()) for x in binary)], names)
            block, before = block + 1, before + len(joined)
            ids.clear()
            keys.clear()
            return row

        held = 0
        for batch in slices(batches, whole, 1_000_000):
            first = 0
            for k, x in enumerate(encoder(TOKENIZER).ids(batch.column(whole).to_pylist())):
                ids.append(x + END)
                held += len(x) // 4 + 1
                if held >= BLOCK:
                    keys.append(batch.column(doc_id).slice(first, k + 1 - first))
                    yield close()
                    first, held = k + 1, 0
            if first < batch.num_rows:
                keys.append(batch.column(doc_id).slice(first))
        if ids:
            yield close()

    schema = f"shard int, block int, before long, ids array<{kind}>, sizes array<long>, sequence binary, rules binary, lengths binary"
    rows.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, decoded from the files; start counts the ids before it."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    names = ["shard", doc_id, "within", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                grammar = Grammar(*(row[c].as_py() for c in ("sequence", "rules", "lengths")))
                sizes = row["sizes"].values.to_numpy()
                ends = np.cumsum(sizes)
                tokens = grammar.decode(0, int(ends[-1]))
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                shard = pa.array(np.full(len(sizes), row["shard"].as_py(), np.int32))
                within = pa.array(row["before"].as_py() + ends - sizes)
                yield pa.RecordBatch.from_arrays([shard, row["ids"].values, within, pa.array(sizes), pa.array(crc, pa.int64())], names)

    found = blocks.mapInArrow(run, f"shard int, `{doc_id}` {kind}, within long, n_tokens long, ids_crc32 long")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    starts = totals.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    return found.join(starts, "shard").select(doc_id, (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write(documents(spark, sf_dir), path)
    return read(spark, path)
