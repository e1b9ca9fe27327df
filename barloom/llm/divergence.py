"""Divergence of sources from each other and from their language, by single-pass in-memory indexing."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import documents, settle, slices, small

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
#: Postings that a task gathers before it writes them as a sorted run.
MEMORY = 800_000
#: Terms of a run that one row of it holds; the merge keeps one such row of each run.
CHUNK = 2_048
#: Sources of a language whose shares of many terms a task holds as one matrix; more go through in tiles of this width.
TILE = 1_024
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20


def _table() -> bytes:
    """ASCII letters in lower case and all bytes of other characters stay; what separates terms becomes a space."""
    keep = set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in keep else 0x20 for b in range(256))


_TERMS = _table()


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of what about `PIECE` bytes hold; no term is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_TERMS)
        while end < len(text) and piece[-1] != 0x20:  # on to the next separator
            more = text[end : end + max(4096, len(piece))].translate(_TERMS)
            stop = more.find(b" ") + 1 or len(more)
            piece, end = piece + more[:stop], end + stop
        yield piece.split()
        at = end


class Block:
    """Postings in memory: the occurrences of terms by (language, source), and the documents that have them by language."""

    def __init__(self) -> None:
        self.held: dict[bytes, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.docs: dict[bytes, Counter] = defaultdict(Counter)
        self.size = 0

    def add(self, lang: bytes, source: str, text: bytes) -> None:
        counts, seen = self.held[lang][source], set()
        before = len(counts)
        for terms in terms_of(text):
            counts.update(terms)
            seen.update(terms)
        self.docs[lang].update(seen)
        self.size += len(counts) - before

    def run(self, shards: int) -> Iterator[tuple[int, list]]:
        """(shard, chunk) with the keys of a chunk in order; a key is the language, a zero byte (terms have none) and the term."""
        for lang, by_source in self.held.items():
            postings: dict[bytes, tuple[list, list]] = {}
            for source, counts in by_source.items():
                for term, n in counts.items():
                    found = postings.get(term)
                    if found is None:
                        postings[term] = [source], [n]
                    else:
                        found[0].append(source)
                        found[1].append(n)
            head, docs = lang + b"\0", self.docs[lang]
            start = zlib.crc32(head)
            by_shard = [[] for _ in range(shards)]
            for term in postings:
                by_shard[zlib.crc32(term, start) % shards].append(term)
            for shard, terms in enumerate(by_shard):
                terms.sort()
                for at in range(0, len(terms), CHUNK):
                    part = terms[at : at + CHUNK]
                    rows = [postings[t] for t in part]
                    sources, counts = ([x for r in rows for x in r[k]] for k in (0, 1))
                    yield shard, [[head + t for t in part], [len(r[0]) for r in rows], [docs[t] for t in part], sources, counts]
        self.__init__()


_RUN = pa.schema(
    [
        ("shard", pa.int32()),
        ("first", pa.binary()),
        ("keys", pa.list_(pa.binary())),
        ("widths", pa.list_(pa.int32())),
        ("docs", pa.list_(pa.int64())),
        ("sources", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())),
    ]
)
_RUN_SQL = "shard int, first binary, keys array<binary>, widths array<int>, docs array<long>, sources array<string>, counts array<long>"


def _runs(shards: int, memory: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()

        def spill() -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for shard, (keys, *rest) in block.run(shards):
                rows.append((shard, keys[0], keys, *rest))
                held += len(keys)
                if held >= 16 * CHUNK:
                    yield _batch(rows, _RUN)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _RUN)

        for batch in slices(batches, "text"):
            raw = pc.cast(batch.column("text"), pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw, strict=True):
                block.add(lang.encode(), source, text)
                if block.size >= memory:
                    yield from spill()
        yield from spill()

    return work


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TERM = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("total", pa.int64())]
)
_TERM_SQL = "lang string, term string, sources array<string>, counts array<long>, total long"


def _merge(min_docs: int):
    """Chunks come ordered by shard and first key: one is opened only when the heap's least key has reached its first."""

    def below(heap: list[tuple], limit: bytes | None) -> Iterator[tuple]:
        """The kept terms before `limit`. An entry of the heap: key, number of its chunk, place in it, first posting, the chunk."""
        while heap and (limit is None or heap[0][0] < limit):
            key, docs, met = heap[0][0], 0, []
            while heap and heap[0][0] == key:
                _, number, at, start, chunk = heap[0]
                keys, widths, of_key, sources, counts = chunk
                end = start + widths[at]
                docs += of_key[at]
                met.append((sources, counts, start, end))
                at += 1
                if at < len(keys):
                    heapq.heapreplace(heap, (keys[at], number, at, end, chunk))
                else:
                    heapq.heappop(heap)
            if docs >= min_docs:
                total: dict[str, int] = {}
                for sources, counts, start, end in met:
                    for k in range(start, end):
                        total[sources[k]] = total.get(sources[k], 0) + counts[k]
                lang, term = key.rsplit(b"\0", 1)
                yield lang.decode(), term.decode(), list(total), list(total.values()), sum(total.values())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple] = []
        out: list[tuple] = []
        shard, number = None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                of, first, *chunk = (batch.column(n)[k].as_py() for n in _RUN.names)
                out += below(heap, None if of != shard else first)
                shard, number = of, number + 1
                heapq.heappush(heap, (first, number, 0, 0, chunk))
                if len(out) >= 10_000:
                    yield _batch(out, _TERM)
                    out = []
        out += below(heap, None)
        if out:
            yield _batch(out, _TERM)

    return work


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, memory: int = MEMORY) -> DataFrame:
    """(lang, term, sources, counts, total) of each term in at least `min_docs` documents of its language.

    `docs` has text, lang and source without nulls. A task fills a block of postings and, whenever it holds `memory` of them,
    hands it on as a run sorted by term, dealt to hash shards. A shard's task merges its runs with a heap, one chunk of each
    run in memory. A term's documents are counted in its runs, so a frequent term is a posting a run.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("text", "lang", "source").mapInArrow(_runs(shards, memory), _RUN_SQL)
    merged = runs.repartition(shards, "shard").sortWithinPartitions("shard", "first")
    return settle(merged.mapInArrow(_merge(min_docs), _TERM_SQL))


_PAIR = pa.schema([("lang", pa.string()), ("low", pa.string()), ("high", pa.string()), ("part", pa.int64())])
_PAIR_SQL = "lang string, low string, high string, part long"


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms that two sources share change in the sum for both, summed over the terms of a batch."""

    def block(lang: str, names: list[str], row: np.ndarray, column: np.ndarray, p: np.ndarray, b: np.ndarray, terms: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(names), TILE):
            for j in range(i, len(names), TILE):
                one, two = (dense(row, column, p, b, terms, k, min(k + TILE, len(names))) for k in (i, j))
                for k in range(one[0].shape[1]):
                    has = np.flatnonzero(one[2][:, k])
                    mine, base = one[0][has, k][:, None], one[1][k]
                    q, c, present = two[0][has], two[1], two[2][has]
                    change = np.abs(mine - q) - np.abs(mine - c) - np.abs(base - q) + np.abs(base - c)
                    total = (change * present).sum(axis=0)
                    at = np.flatnonzero(total)
                    at = at[at + j > i + k]
                    if len(at):
                        high = pa.array([names[j + x] for x in at], pa.string())
                        low = pa.array([names[i + k]] * len(at), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), low, high, pa.array(total[at])], schema=_PAIR)

    def dense(row: np.ndarray, column: np.ndarray, p: np.ndarray, b: np.ndarray, terms: int, first: int, last: int) -> tuple:
        """Shares by term and source, base by source, and where a term is present."""
        own = (column >= first) & (column < last)
        shares, present = np.zeros((terms, last - first), np.int64), np.zeros((terms, last - first), bool)
        shares[row[own], column[own] - first] = p[own]
        present[row[own], column[own] - first] = True
        bases = np.zeros(last - first, np.int64)
        bases[column[own] - first] = b[own]
        return shares, bases, present

    for whole in batches:
        for batch in slices([whole], "found", 200_000):
            langs = batch.column("lang").dictionary_encode()
            found = batch.column("found")
            lengths = pc.list_value_length(found).to_numpy()
            of_term = np.repeat(np.arange(batch.num_rows), lengths)
            flat = found.flatten()
            sources = flat.field("source").dictionary_encode()
            p, b = (flat.field(n).to_numpy() for n in ("p", "base"))
            source, lang_of = sources.indices.to_numpy(), langs.indices.to_numpy()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                own = lang_of[of_term] == number
                used = np.unique(source[own])
                names = [sources.dictionary[int(x)].as_py() for x in used]
                order = sorted(range(len(names)), key=names.__getitem__)
                place = np.zeros(len(sources.dictionary), np.int64)
                place[used[order]] = np.arange(len(order))
                terms, row = np.unique(of_term[own], return_inverse=True)
                step = max(1, 1_000_000 // min(TILE, max(1, len(names))))
                for first in range(0, len(terms), step):
                    part = (row >= first) & (row < first + step)
                    args = (row[part] - first, place[source[own][part]], p[own][part], b[own][part], min(step, len(terms) - first))
                    yield from block(lang, [names[k] for k in order], *args)


def _alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each source and every other: its terms against the other's share of an absent term, and (once) those of neither."""
    for batch in batches:
        for row in batch.to_pylist():
            base = np.array([x["base"] for x in row["others"]], np.int64)
            names = [x["source"] for x in row["others"]]
            own, me = row["base"], row["source"]
            hist = sorted((x["p"], x["n"]) for x in row["hist"])
            p, n = (np.array(x, np.int64) for x in (zip(*hist, strict=True) if hist else ((), ())))
            cn, cp = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (n, n * p))
            k = np.searchsorted(p, base)
            far = base * cn[k] - cp[k] + (cp[-1] - cp[k]) - base * (cn[-1] - cn[k])
            first = np.array([me < x for x in names])
            part = far + np.abs(own - base) * (np.where(first, row["terms"], 0) - cn[-1])
            other = [k for k, x in enumerate(names) if x != me]
            low = [min(me, names[k]) for k in other]
            high = [max(me, names[k]) for k in other]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * len(other), pa.string()), pa.array(low, pa.string()), pa.array(high, pa.string()), pa.array(part[other], pa.int64())],
                schema=_PAIR,
            )


def _share(count: str, total: str) -> F.Column:
    """Exact: products beyond a long are decimals. Zero if the language keeps no term."""
    return F.expr(
        f"coalesce(if(terms = 0, 0L, 1L + (cast({SCALE} as decimal(12, 0)) * cast({count} + {PRIOR} as decimal(20, 0)))"
        f" div cast({total} + {PRIOR} * terms as decimal(20, 0))), 0L)"
    )


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, memory: int = MEMORY
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language are apart, and the terms they overuse.

    Nulls in any of the three columns are ''. Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A language keeps
    the terms of at least `min_docs` of its documents; a language without any has pairs of value 0. Part `pair` has a row for each
    ordered pair of sources, part `term` the `top` terms whose share in the source is above that in the language. Ties in value
    are ranked by item. Repeated rows count as documents each. Other columns are ignored, whatever their names; an empty
    table gives an empty one.

    Two sources differ by |p - q| over all kept terms. It is summed without visiting absent terms: as if no term were shared (from a
    histogram of each source's shares), then corrected by the terms that both have, which tasks stream and sum by pair.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    kept = frequencies(plain, min_docs, memory)
    postings = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("n")
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    of_source = postings.groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
    groups = plain.groupBy("lang", "source").count().drop("count").join(of_source, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["terms", "lang_total", "source_total"]).withColumn("base", _share("0", "source_total"))
    groups = small(groups)

    placed = postings.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "base", _share("n", "source_total").alias("p"), _share("total", "lang_total").alias("q")
    )
    placed = settle(placed)
    above = placed.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))

    found = F.collect_list(F.struct("source", "p", "base")).alias("found")
    shared = placed.groupBy("lang", "term").agg(found).select("lang", "found").mapInArrow(_shared, _PAIR_SQL)
    hist = placed.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    hist = hist.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("hist"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "base")).alias("others"))
    alone = groups.select("lang", "source", "base", "terms").join(hist, ["lang", "source"], "left")
    alone = alone.withColumn("hist", F.coalesce("hist", F.array().cast("array<struct<p:bigint,n:bigint>>"))).join(others, "lang")
    sums = alone.mapInArrow(_alone, _PAIR_SQL).unionByName(shared).groupBy("lang", "low", "high").agg(F.sum("part").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    pairs = sums.select("lang", "value", ends.alias("e")).select("lang", "e.source", "e.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY ALL),
c AS (SELECT w.lang, w.source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(langs.v), 0) AS v FROM d LEFT JOIN langs USING (lang) GROUP BY ALL),
t AS (SELECT g.lang, g.source, g.v, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (t.n + {PRIOR} * t.v) AS p,
    1 + ({SCALE}::HUGEINT * (kept.total + {PRIOR})) // (langs.n + {PRIOR} * langs.v) AS q
  FROM t JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
