"""Quality rules: base counts, and perplexity bands of character models with modified Kneser-Ney smoothing.

The models are of `ORDER` unfolded characters, counted and smoothed by Spark joins and aggregations; they grow with the corpus, and no part of
them is broadcast or held on one machine.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD_TEXT, documents, fresh, scratch, settle, slices, small

MARKS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A band reaches this many interquartile ranges (of at least the given width, in nats a character) beyond the quartiles:
#: Tukey's outer fence.
FENCES = 3.0
LEAST_RANGE = 0.02
#: Characters of a gram, 16 bits each.
ORDER = 4
#: Characters of text that a batch of the text table covers, and that are split into words at once.
BATCH = 6_000_000
PIECE = 500_000
#: Scores are rounded so that neither they nor the quartiles depend on how rows are partitioned.
DIGITS = 5


def language(lang: str) -> F.Column:
    """The language as it stands in the table, in lower case and up to its first hyphen or underscore; `und` for none."""
    found = F.regexp_extract(F.trim(F.lower(F.coalesce(F.col(lang), F.lit("")))), "^[^-_]+", 0)
    return F.when(found == "", F.lit("und")).otherwise(found)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, marks, repeated lines with a word, words inside repeated three-word windows."""
    text = text or ""
    words = WORD_TEXT.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(upto, i)
                upto = i + 3
    lines = [x for x in text.split("\n") if WORD_TEXT.search(x)] if "\n" in text else ()
    return len(words), sum(map(len, words)), sum(map(text.count, MARKS)), len(lines) - len(set(lines)), repeated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_RNG = np.random.default_rng(20_240)
_BYTES = _RNG.integers(0, 2**64, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_BLANKS = np.zeros(256, bool)
_BLANKS[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(texts: list[str | None], tag: str) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in a row, number of words of each text); each language has its own hashes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = _BLANKS[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, stop = edge[::2], edge[1::2]
    power = np.full(len(data) + 1, _STEP, np.uint64)
    power[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * np.cumprod(power)[:-1], out=sums[1:])
    power[1:] = _BACK
    own = np.uint64(int.from_bytes(hashlib.blake2b(tag.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    found = mix((sums[stop] - sums[start]) * np.cumprod(power)[start] + own)
    ends = np.cumsum([len(x) + 1 for x in raw])
    return found, np.diff(np.searchsorted(start, ends), prepend=0)


def halves(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The half of each text, by the smallest hash of its pairs of words: copies are in one, most near copies too."""
    pairs = mix(found + mix(np.roll(found, -1)))
    ends = np.cumsum(sizes)
    pairs[ends[sizes > 0] - 1] = np.uint64(2**64 - 1)  # a text's last word begins none
    out = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = mix(np.minimum.reduceat(pairs, (ends - sizes)[some])) & np.uint64(1)
    return out


def grams(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The gram that ends at each character of the texts in a row; before a text stand characters of number zero.

    `data` has the texts in UTF-8, `sizes` how many characters of each. Characters beyond 16 bits are folded into the room that
    surrogates leave free.
    """
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    wide = points > 0xFFFF
    points[wide] = 0xD800 | (points[wide] & np.uint64(0x7FF))
    before = (ORDER - 1) * (1 + np.repeat(np.arange(len(sizes)), sizes))
    padded = np.zeros(len(points) + (ORDER - 1) * len(sizes), np.uint64)
    place = np.arange(len(points)) + before
    padded[place] = points
    out = np.zeros(len(points), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        out = (out << np.uint64(16)) | padded[place - back]
    return out.view(np.int64)


def _pieces(texts: tuple) -> Iterator[list]:
    """The texts in lists of about `PIECE` characters; a longer one is alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > PIECE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    yield part


BLOBS = ("k1", "k2", "counts", "sizes", "data")


def _batches(docs: DataFrame) -> DataFrame:
    """The text table: a row for each batch of texts of one language and half, with the base counts of its texts.

    `docs` has tag, k1, k2 (which name a text) and text. It is bucketed by batch, so that joins on it don't shuffle the texts.
    """
    names = ["batch", "tag", "half", *BLOBS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        sizes_held: Counter = Counter()

        def out(tag: str) -> Iterator[pa.RecordBatch]:
            k1, k2, texts = zip(*held.pop(tag), strict=True)
            side = np.concatenate([halves(*hash_words(part, tag)) for part in _pieces(texts)])
            del sizes_held[tag]
            for half in (0, 1):
                mine = np.flatnonzero(side == half)
                if len(mine):
                    own = [texts[i] or "" for i in mine]
                    counts = np.array([base_counts(t) for t in own], "<i8")
                    sizes = np.array([len(t) for t in own], "<i8")
                    data = "".join(own).encode("utf-8", "surrogatepass")
                    arrays = [np.array(k1, "<i8")[mine].tobytes(), np.array(k2, "<i8")[mine].tobytes(), counts.tobytes(), sizes.tobytes(), data]
                    values = [uuid.uuid4().int >> 65, tag, half, *arrays]
                    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * len(BLOBS)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in slices(batches, "text"):
            for tag, k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("tag", "k1", "k2", "text")), strict=True):
                held.setdefault(tag, []).append((k1, k2, text))
                sizes_held[tag] += len(text or "") + 1
                if sizes_held[tag] >= BATCH:
                    yield from out(tag)
                elif sizes_held.total() >= 2 * BATCH:  # many languages: the largest one
                    yield from out(sizes_held.most_common(1)[0][0])
        for tag in list(held):
            yield from out(tag)

    rows = docs.mapInArrow(run, "batch long, tag string, half int, " + ", ".join(f"{b} binary" for b in BLOBS))
    spark, name = docs.sparkSession, f"barloom_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.option("path", scratch(spark)).option("compression", "zstd").bucketBy(parts, "batch").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the scan is resolved; the files stay
    return table


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different grams of each batch and how often it has them."""
    for row in _rows(batches):
        g, n = np.unique(grams(row["data"], np.frombuffer(row["sizes"], "<i8")), return_counts=True)
        k = len(g)
        columns = [pa.array(np.full(k, row["batch"])), pa.array([row["tag"]] * k, pa.string()), pa.array(np.full(k, row["half"], np.int32)), pa.array(g), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, ["batch", "tag", "half", "g", "n"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    if min(n1, n2, n3, n4) == 0:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.05, [0.95, 1.9, 2.9])


def _discount(k: int, f: int) -> Column:
    """The same as `discounts`, entry k, from columns m<f>_1 to m<f>_4."""
    n = [F.col(f"m{f}_{j}").cast("double") for j in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    raw = (k + 1) - (k + 2) * y * n[k + 1] / n[k]
    plain, top = ((0.5, 0.95), (0.75, 1.9), (0.9, 2.9))[k]
    return F.when(F.least(*n) == 0, plain).otherwise(F.greatest(F.least(raw, F.lit(top)), F.lit(0.05)))


def model(counted: DataFrame) -> DataFrame:
    """(tag, g, p0, p1): each gram's probability given its context by the model of either half; counted(tag, half, g, n).

    Modified Kneser-Ney, interpolated over all orders down to equal chances: the highest order counts occurrences, a lower one the
    different characters before. A row for a gram holds the counts of both halves, so a gram that one half alone has gets a
    probability from the other half too. A half without texts gives equal chances.
    """
    both = [F.coalesce(F.sum(F.when(F.col("half") == f, F.col("n"))), F.lit(0)).alias(f"c{f}") for f in (0, 1)]
    levels = [settle(counted.groupBy("tag", "g").agg(*both))]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[-1].withColumn("g", F.col("g").bitwiseAND((1 << (16 * order)) - 1))
        levels.append(settle(shorter.groupBy("tag", "g").agg(*(F.count_if(F.col(f"c{f}") > 0).alias(f"c{f}") for f in (0, 1)))))
    below = None
    for order, level in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        rare = [F.count_if(F.col(f"c{f}") == j).alias(f"m{f}_{j}") for f in (0, 1) for j in (1, 2, 3, 4)]
        cut = level.groupBy("tag").agg(*rare).select("tag", *(_discount(k, f).alias(f"d{f}_{k + 1}") for f in (0, 1) for k in range(3)))
        cut = small(cut)
        context = F.shiftrightunsigned("g", 16).alias("context")
        rows = level.select("tag", "g", context, "c0", "c1").join(cut, "tag")
        for f in (0, 1):
            c = F.col(f"c{f}")
            rows = rows.withColumn(f"d{f}", F.when(c == 0, 0.0).when(c == 1, F.col(f"d{f}_1")).when(c == 2, F.col(f"d{f}_2")).otherwise(F.col(f"d{f}_3")))
        rows = rows.select("tag", "g", "context", "c0", "c1", "d0", "d1")
        sums = [F.sum(f"{x}{f}").alias(f"{x}{f}_all") for f in (0, 1) for x in "cd"]
        rows = rows.join(rows.groupBy("tag", "context").agg(*sums), ["tag", "context"])
        if below is None:
            rows = rows.withColumns({"lower0": F.lit(1 / 65536), "lower1": F.lit(1 / 65536)})
        else:
            shorter = below.select("tag", F.col("g").alias("suffix"), F.col("p0").alias("lower0"), F.col("p1").alias("lower1"))
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND((1 << (16 * (order - 1))) - 1)).join(shorter, ["tag", "suffix"])

        def chance(f: int) -> Column:
            whole = F.col(f"c{f}_all")
            mixed = (F.col(f"c{f}") - F.col(f"d{f}") + F.col(f"d{f}_all") * F.col(f"lower{f}")) / F.greatest(whole, F.lit(1))
            return F.when(whole > 0, mixed).otherwise(F.col(f"lower{f}")).alias(f"p{f}")

        below = settle(rows.select("tag", "g", chance(0), chance(1)))
    return below


def score(docs: DataFrame) -> DataFrame:
    """(tag, k1, k2, half, the five counts, log_perplexity) of the texts of docs(tag, k1, k2, text).

    A language has a model of each half of its texts, and a text is scored by the other half's, so neither it nor its copies were
    seen. The score is the mean over a text's characters, 0 without any. A batch of texts meets its own different grams only, as an array
    sorted by gram.
    """
    table = _batches(docs)
    counted = settle(table.mapInArrow(_counted, "batch long, tag string, half int, g long, n long"))
    costs = counted.join(model(counted), ["tag", "g"])
    cost = -F.ln(F.when(F.col("half") == 0, F.col("p1")).otherwise(F.col("p0")))
    costs = costs.select("batch", "g", cost.cast("float").alias("cost"))  # seven digits of each; scores keep five

    def run(texts: pa.Table, costs: pa.Table) -> pa.Table:
        g, cost = costs.column("g").to_numpy(), costs.column("cost").to_numpy().astype(float)
        order = np.argsort(g)
        g, cost = g[order], cost[order]
        parts = []
        for row in _rows(texts.to_batches()):
            sizes, count = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["counts"], "<i8").reshape(-1, len(COUNTS))
            own = grams(row["data"], sizes)
            sums = np.zeros(len(sizes))
            if len(own):
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), cost[np.searchsorted(g, own)], len(sizes))
            k1, k2 = (pa.array(np.frombuffer(row[k], "<i8")) for k in ("k1", "k2"))
            logs = np.round(sums / np.maximum(sizes, 1), DIGITS) + 0.0
            k = len(sizes)
            columns = [pa.array([row["tag"]] * k, pa.string()), k1, k2, pa.array(np.full(k, row["half"], np.int32))]
            columns += [pa.array(np.ascontiguousarray(x)) for x in count.T] + [pa.array(logs)]
            parts.append(pa.table(columns, ["tag", "k1", "k2", "half", *COUNTS, "log_perplexity"]))
        return pa.concat_tables(parts) if parts else OUT.empty_table()

    schema = f"tag string, k1 long, k2 long, half int, {', '.join(f'{c} long' for c in COUNTS)}, log_perplexity double"
    scored = table.groupBy("batch").cogroup(costs.groupBy("batch")).applyInArrow(run, schema)
    rest = [c for c in scored.columns if c not in ("tag", "k1", "k2")]
    return scored.groupBy("tag", "k1", "k2").agg(*(F.max(c).alias(c) for c in rest))


OUT = pa.schema([("tag", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("half", pa.int32()), *((c, pa.int64()) for c in COUNTS), ("log_perplexity", pa.float64())])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Rows (columns `carry`, by default all) with the five counts, log_perplexity, base_failed and kept.

    Texts are dealt into two halves, copies and most near copies into one (`halves`), and scored by the other half's
    model of their language (`score`). A band per language and half is set by the exact quartiles of the scores over all its rows that
    pass the base rules; a text outside the band is rejected. Where a language's texts all fall in one half, their scores are equal per
    character and all that pass the base rules are kept. Null and empty texts have no words, so they fail the
    base rules; a null language is `und`. A text is named by two 64-bit hashes. Columns of the same names are replaced.
    An empty table gives an empty one.
    """
    own = [*COUNTS, "log_perplexity", "base_failed", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in own]
    tag, k1, k2, half = fresh([*docs.columns, *own], "tag", "k1", "k2", "half")
    plain = F.coalesce(F.col(text), F.lit(""))
    named = {tag: language(lang), k1: F.xxhash64(plain), k2: F.xxhash64(F.lit("second"), plain)}
    source = docs.select(*carry, *(c.alias(n) for n, c in named.items()))
    texts = docs.select(*(c.alias(n) for c, n in zip(named.values(), ("tag", "k1", "k2"), strict=True)), F.col(text).alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = score(texts).withColumn("base_failed", failed)
    found = settle(found.toDF(tag, k1, k2, half, *found.columns[4:]))

    low, high, n, upto = fresh([*docs.columns, *own, tag, k1, k2, half], "low", "high", "n", "upto")
    good = found.filter(~F.col("base_failed")).select(tag, k1, k2, half, "log_perplexity")
    counted = source.select(tag, k1, k2).join(good, [tag, k1, k2]).groupBy(tag, half, "log_perplexity").agg(F.count(F.lit(1)).alias(n))
    order = Window.partitionBy(tag, half).orderBy("log_perplexity")
    counted = counted.withColumn(upto, F.sum(n).over(order)).withColumn(n, F.sum(n).over(Window.partitionBy(tag, half)))
    q1, q3 = (F.min(F.when(F.col(upto) >= q * F.col(n), F.col("log_perplexity"))) for q in (0.25, 0.75))
    reach = FENCES * F.greatest(F.col(high) - F.col(low), F.lit(LEAST_RANGE))
    bands = counted.groupBy(tag, half).agg(q1.alias(low), q3.alias(high))
    bands = small(bands.select(tag, half, (F.col(low) - reach).alias(low), (F.col(high) + reach).alias(high)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col(low), F.col(high)), F.lit(False))
    verdict = found.join(bands, [tag, half], "left").withColumn("kept", ~F.col("base_failed") & inside).select(tag, k1, k2, *own)
    return source.join(small(verdict), [tag, k1, k2]).select(*carry, *own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality_rules(docs, carry=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")
