"""Line deduplication within one edit, by a deletion-neighbourhood join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, settle, small

WORD = r"[^\x20\x09-\x0D]"
#: Shorter lines are compared for equality only: one edit makes another word of a short one.
NEAR_CHARS = 20
#: Variants are made of one block of a line at a time, hashed with all that stands around it.
BLOCK = 64


def _lines(content: F.Column) -> F.Column:
    """Array of the lines that have a word: place, text."""
    all_ = F.transform(F.split(content, "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    return F.filter(all_, lambda s: s["line"].rlike(WORD))


def _two(line: F.Column) -> list[F.Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def _half_keys(line: F.Column) -> F.Column:
    """Four hashes; two lines within one edit share one of them.

    With n the length of the shorter one, the edit leaves the first n div 2 characters alone, or the last n - n div 2.
    """
    size = F.length(line)

    def of(n: F.Column, name: str) -> list[F.Column]:
        half = F.floor(n / 2).cast("int")
        head, tail = F.substring(line, F.lit(1), half), F.substring(line, size - (n - half) + 1, n - half)
        return [F.xxhash64(F.lit(name), n, F.lit("head"), head), F.xxhash64(F.lit(name), n, F.lit("tail"), tail)]

    return F.array(*of(size, "half"), *of(size - 1, "half"))


def _block_keys(lines: DataFrame) -> DataFrame:
    """Rows (h1, h2, role, key, mid) for each block: `key` hashes the role's length, the block's place and all around it.

    Role s: lines of one length, one character replaced. Roles x and y: x is one character longer, and its block too.
    """

    def rows(role: str, n: F.Column, width: int, blocks: F.Column) -> DataFrame:
        at = F.explode(F.sequence(F.lit(0), blocks))
        found = lines.select("h1", "h2", "line", n.alias("n"), at.alias("b"))
        first = F.col("b") * BLOCK
        around = [F.substring(F.col("line"), F.lit(1), first), F.substring(F.col("line"), first + width + 1, F.length("line"))]
        kind = F.lit("s" if role == "s" else "d")
        mid = F.substring(F.col("line"), first + 1, F.lit(width))
        return found.select("h1", "h2", F.lit(role).alias("role"), F.xxhash64(kind, "n", "b", *around).alias("key"), mid.alias("mid"))

    size = F.length("line")
    last = F.floor((size - 1) / BLOCK).cast("int")
    out = rows("s", size, BLOCK, last).unionByName(rows("x", size - 1, BLOCK, last))
    return out.unionByName(rows("y", size, BLOCK - 1, F.floor(size / BLOCK).cast("int")))


def _variants(blocks: DataFrame) -> DataFrame:
    """Rows (v, h1, h2, role): hashes of the block with one character deleted (with its place, for role s), or as it is (y)."""
    places = F.when(F.col("role") == "y", F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.length("mid")))
    rows = blocks.filter((F.col("role") == "y") | (F.length("mid") > 0)).withColumn("i", F.explode(places))
    rest = F.concat(F.substring(F.col("mid"), F.lit(1), F.col("i") - 1), F.substring(F.col("mid"), F.col("i") + 1, F.length("mid")))
    variant = F.when(F.col("role") == "y", F.col("mid")).otherwise(rest)
    place = F.when(F.col("role") == "s", F.col("i")).otherwise(F.lit(0))
    return rows.select(F.xxhash64("key", place, variant).alias("v"), F.xxhash64(place, variant, "key").alias("w"), "h1", "h2", "role")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two different lines have."""
    return rows.groupBy(key).agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select(key)


def near_lines(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of lines that have an earlier line within one edit.

    `texts`: one array `lines` of (pos, line) a row; `firsts`: (h1, h2, first) by different line. Candidates share half of
    their text, then all but one block; only then are deletion variants made. Equal variants prove the bound up to hash
    equality, so a group needs its earliest member only, never its pairs; the edit distance is then verified.
    """
    long = texts.select(F.explode("lines.line").alias("line")).filter(F.length("line") >= NEAR_CHARS)
    halves = long.select(*_two(F.col("line")), F.explode(_half_keys(F.col("line"))).alias("k"))
    wanted = small(halves.join(_shared(halves, "k"), "k", "left_semi").select("h1", "h2").distinct())
    lines = long.select(*_two(F.col("line")), "line").join(wanted, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    lines = settle(lines.join(firsts, ["h1", "h2"]))
    blocks = _block_keys(lines)
    blocks = settle(blocks.join(_shared(blocks, "key"), "key", "left_semi"))
    variants = settle(_variants(blocks).distinct().join(lines.select("h1", "h2", "first"), ["h1", "h2"]))

    def least(role: str) -> F.Column:
        return F.min(F.when(F.col("role") == role, F.struct("first", "h1", "h2"))).alias(f"least_{role}")

    groups = variants.groupBy("v", "w").agg(*map(least, "sxy"))
    other = F.when(F.col("role") == "s", F.col("least_s")).when(F.col("role") == "x", F.col("least_y")).otherwise(F.col("least_x"))
    met = variants.join(groups, ["v", "w"]).withColumn("other", other).filter(F.col("other.first") < F.col("first"))
    pairs = met.select("h1", "h2", F.col("other.h1").alias("g1"), F.col("other.h2").alias("g2")).distinct()
    earlier = lines.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("earlier"))
    both = pairs.join(lines.select("h1", "h2", "line"), ["h1", "h2"]).join(earlier, ["g1", "g2"])
    return both.filter(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h1", "h2").distinct()


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", left: str | None = None) -> DataFrame:
    """(id, n_lines, n_kept, kept_chars) of each row; with `left`, that column has the text less the dropped lines.

    Lines are what stands between line feeds; those without a word are kept and not counted. A line is dropped if
    an earlier one (by id, then by row, then by place) is equal, or, from `NEAR_CHARS` characters, within one
    inserted, deleted or replaced character. All is judged on the input, so a dropped line drops others too. Null texts
    have no lines; null ids come first. An empty table gives an empty one.

    A line with a third of all rows is one row per task in every grouping; rows are joined to the different lines by
    sort-merge joins whose large partitions Spark splits.
    """
    rows = docs.select(
        F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("content")
    )
    if left:
        rows = settle(rows)
    found = rows.withColumn("lines", _lines(F.col("content")))
    hashes = F.transform("lines", lambda s: F.struct(s["pos"].alias("pos"), *_two(s["line"]), F.length(s["line"]).alias("chars")))
    placed = settle(found.select("id", "rid", hashes.alias("places")))
    each = placed.select("id", "rid", F.inline("places"))
    firsts = settle(each.groupBy("h1", "h2").agg(F.min(F.struct("id", "rid", "pos")).alias("first")))
    near = near_lines(found.select("lines"), firsts).withColumn("near", F.lit(True))
    status = settle(firsts.join(near, ["h1", "h2"], "left"))  # so that a hot line's side of the next join can be split
    judged = each.join(status, ["h1", "h2"])
    kept = judged.filter((F.col("first.rid") == F.col("rid")) & (F.col("first.pos") == F.col("pos")) & F.col("near").isNull())
    kept = kept.groupBy("rid").agg(F.count("*").alias("n_kept"), F.sum("chars").alias("kept_chars"), *([F.collect_set("pos").alias("kept")] if left else []))
    out = placed.select("id", "rid", F.size("places").cast("long").alias("n_lines")).join(kept, "rid", "left")
    columns = [
        F.col("id").alias(doc_id),
        "n_lines",
        F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"),
        F.coalesce("kept_chars", F.lit(0)).cast("long").alias("kept_chars"),
    ]
    if left:
        out = out.join(rows.select("rid", "content"), "rid")
        numbered = F.transform(F.split("content", "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
        stay = F.filter(numbered, lambda s: ~s["line"].rlike(WORD) | F.array_contains(F.coalesce("kept", F.array()), s["pos"]))
        columns.append(F.array_join(F.transform(stay, lambda s: s["line"]), "\n").alias(left))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


SQL = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
worded AS (SELECT * FROM each WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first, length(line) AS n FROM worded GROUP BY line),
keyed AS (
  SELECT line, first, n, n AS m FROM firsts WHERE n >= 20
  UNION ALL SELECT line, first, n, n - 1 FROM firsts WHERE n >= 20),
halves AS (
  SELECT line, first, n, m, left(line, (m // 2)::INT) AS part, 'head' AS side FROM keyed
  UNION ALL SELECT line, first, n, m, right(line, (m - m // 2)::INT), 'tail' FROM keyed),
pairs AS (
  SELECT DISTINCT a.line AS x, b.line AS y FROM halves a JOIN halves b
  ON a.m = b.m AND a.side = b.side AND a.part = b.part AND a.n = a.m AND a.line <> b.line),
close AS (
  SELECT x, y FROM pairs WHERE len(list_filter(range(1, length(x) + 2), lambda i:
    left(x, (i - 1)::INT) = left(y, (i - 1)::INT)
    AND substr(y, i + 1) = CASE WHEN length(x) = length(y) THEN substr(x, i + 1) ELSE substr(x, i) END)) > 0),
linked AS (SELECT x, y FROM close UNION SELECT y, x FROM close),
near AS (
  SELECT DISTINCT l.x AS line FROM linked l JOIN firsts a ON a.line = l.x JOIN firsts b ON b.line = l.y WHERE b.first < a.first),
kept AS (
  SELECT w.doc_id, count(*) AS n_kept, sum(length(w.line)) AS kept_chars
  FROM worded w JOIN firsts f ON f.line = w.line AND f.first = {'d': w.doc_id, 'p': w.pos}
  WHERE w.line NOT IN (SELECT line FROM near) GROUP BY w.doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_kept, 0)::BIGINT AS n_kept,
  coalesce(k.kept_chars, 0)::BIGINT AS kept_chars
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
