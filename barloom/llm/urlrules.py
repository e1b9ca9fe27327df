"""URL filter: stated host and path rules first, then association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import settle, small

ALLOW, BLOCK = "allow", "block"
#: The stated rules: verdict, then host and path.
RULES = (
    (ALLOW, "org/"),
    (BLOCK, "example.org/es/"),
    (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"),
    (BLOCK, "com/de/"),
)
#: A mined rule holds for this share of the labelled URLs, and its verdict for this share of those that it matches.
SUPPORT = 0.01
CONFIDENCE = 0.8
#: FP-growth lists each frequent subset of a basket. If one has more tokens than this, the rules are searched level by level instead.
WIDEST = 12
_ITEM = "="  # the verdict as an item; tokens start with a letter


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def stated(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (a rule fits its host, all subdomains, and the paths that start with its path), and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK)):  # the last one that fits wins
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Different tokens of a URL: scheme, host and each of its parent domains, path segments by place and by themselves
    (digits as their number), extension, and names of query fields."""
    scheme = F.when(F.instr(url, "://") > 0, F.lower(F.substring_index(url, "://", 1)))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    first = F.when(F.size(labels) > 2, F.concat(F.lit("w:"), F.element_at(labels, 1)))
    shaped = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, r"[0-9]+", "0"))
    placed = F.transform(shaped, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    loose = F.transform(shaped, lambda x: F.concat(F.lit("s:"), x))
    extension = F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fields = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    alone = F.array(F.concat(F.lit("u:"), scheme), first, F.concat(F.lit("x:"), F.lower(extension)))
    every = F.concat(suffixes, placed, loose, fields, F.filter(alone, lambda x: x.isNotNull()))
    return F.coalesce(F.array_sort(F.array_distinct(every)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, widest: int = WIDEST) -> DataFrame:
    """(antecedent, verdict, hits, n): token sets that `n` labelled URLs have, `hits` of them with the verdict.

    `labelled`: tokens and verdict of each URL; repeated ones count each. A rule's hits are at least `support` of all URLs and
    `confidence` of `n`. A rule is dropped if leaving out one token gives another of that verdict that is no less confident: where
    the longer one matches, the shorter one does, so no judgement changes. No labelled URL gives no rule.

    Every token counts. Those in too few URLs for a verdict can be in no rule. Those of all URLs, or of URLs of one verdict only,
    are in no longer rule that is kept, as it would be no more confident without them (or than them); they are rules by themselves
    at most. The other tokens of a URL are its basket. Baskets of at most `widest` tokens are mined by FP-growth; if any is wider, whose
    subsets could be too many to list, `_levels` finds the same rules for all of them.
    """
    spark = labelled.sparkSession
    labelled = settle(labelled.select("tokens", "verdict"))
    total = labelled.count()
    nothing = spark.createDataFrame([], "antecedent array<string>, verdict string, hits long, n long")
    if not total:
        return nothing
    least = max(2, math.ceil(support * total))
    row = F.monotonically_increasing_id().alias("row")
    rows = settle(labelled.select(row, F.array_distinct("tokens").alias("tokens"), "verdict"))
    single = rows.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(*_counts())
    single = settle(single.filter(F.greatest("blocked", F.col("n") - F.col("blocked")) >= least))
    growing = small(single.filter(_mixed(total)).select("token"))
    chosen = rows.select("row", F.explode("tokens").alias("token")).join(growing, "token")
    chosen = chosen.groupBy("row").agg(F.sort_array(F.collect_list("token")).alias("best"))
    alone = single.select(F.array("token").alias("antecedent"), "n", "blocked")
    baskets = settle(rows.join(chosen, "row").select("best", "verdict"))
    if (baskets.agg(F.max(F.size("best"))).first()[0] or 0) <= widest:
        longer = _grown(baskets, least)
    else:
        longer = _levels(baskets, least, total)
    counted = alone.unionByName(longer)

    said = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), c.alias("hits")) for v, c in ((BLOCK, F.col("blocked")), (ALLOW, F.col("n") - F.col("blocked")))]))
    rules = counted.select("antecedent", "n", said.alias("s")).select("antecedent", "s.verdict", "s.hits", "n")
    rules = rules.filter((F.col("hits") >= least) & (F.col("hits") >= confidence * F.col("n") * (1 - 1e-12)))
    rules = settle(rules)
    shorter = rules.select("antecedent", "verdict", "hits", "n", F.explode("antecedent").alias("out")).select(
        F.array_remove("antecedent", F.col("out")).alias("less"), "antecedent", "verdict", "hits", "n"
    )
    met = rules.select(F.col("antecedent").alias("less"), "verdict", F.col("hits").alias("less_hits"), F.col("n").alias("less_n"))
    exact = [F.col(c).cast("decimal(19,0)") for c in ("less_hits", "n", "hits", "less_n")]
    beaten = shorter.join(met, ["less", "verdict"]).filter(exact[0] * exact[1] >= exact[2] * exact[3])
    return settle(rules.join(beaten.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti"))


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if(F.col("verdict") == BLOCK).alias("blocked")]


def _mixed(total: int) -> Column:
    """Whether a token set has URLs of both verdicts, and not all URLs."""
    return (F.col("blocked") > 0) & (F.col("blocked") < F.col("n")) & (F.col("n") < total)


def _grown(baskets: DataFrame, least: int) -> DataFrame:
    """(antecedent, n, blocked) of the sets of two tokens or more that are in `least` baskets (best, verdict) of a verdict, by FP-growth."""
    total = baskets.count()
    if not total:
        return baskets.select(F.col("best").alias("antecedent"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("blocked"))
    items = baskets.select(F.concat("best", F.array(F.concat(F.lit(_ITEM), "verdict"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / total) * (1 - 1e-9), minConfidence=1.0).fit(items).freqItemsets
    found = settle(found.select(F.array_sort("items").alias("items"), "freq"))
    verdicts = F.filter("items", lambda x: x.startswith(_ITEM))
    split = found.select(F.filter("items", lambda x: ~x.startswith(_ITEM)).alias("antecedent"), verdicts.alias("said"), "freq")
    split = split.filter(F.size("antecedent") > 1)
    whole = split.filter(F.size("said") == 0).select("antecedent", F.col("freq").alias("n"))
    # of a set with too few URLs of one verdict, only the other's number is listed
    said = split.filter(F.size("said") == 1).groupBy("antecedent").agg(
        F.max(F.when(F.col("said")[0] == _ITEM + BLOCK, F.col("freq"))).alias("_blocked"), F.max(F.when(F.col("said")[0] == _ITEM + ALLOW, F.col("freq"))).alias("_allowed")
    )
    blocked = F.coalesce("_blocked", F.col("n") - F.col("_allowed"))
    return whole.join(said, "antecedent").select("antecedent", "n", blocked.alias("blocked"))


def _levels(baskets: DataFrame, least: int, total: int) -> DataFrame:
    """As `_grown`, but only the sets that a kept rule can have, so that a URL with very many frequent tokens doesn't list all its subsets.

    A set grows if it has both verdicts and fewer URLs than each of its subsets with a token less (else that token adds nothing to
    it, nor to any set around it). A set of k + 1 tokens is met in a basket that holds two growing sets of k which differ in
    their last token, and counted if all its subsets of k grow. Equal baskets are one row with a number.
    """
    baskets = baskets.groupBy("best").agg(*_counts()).withColumn("row", F.monotonically_increasing_id())
    baskets = settle(baskets)
    held = baskets.select("row", F.col("n").alias("w"), F.col("blocked").alias("b"), F.explode("best").alias("t"))
    held = settle(held.select("row", "w", "b", F.array("t").alias("antecedent")))
    counts = [F.sum("w").alias("n"), F.sum("b").alias("blocked")]
    grows = settle(held.groupBy("antecedent").agg(*counts))
    found, size = None, 1
    while True:
        head, last = F.slice("antecedent", 1, size - 1), F.element_at("antecedent", -1)
        left = held.select("row", "w", "b", head.alias("head"), last.alias("l"))
        right = held.select("row", head.alias("head"), last.alias("r"))
        met = left.join(right, ["row", "head"]).filter(F.col("l") < F.col("r"))
        met = settle(met.select("row", "w", "b", F.concat("head", F.array("l", "r")).alias("antecedent")))
        counted = met.groupBy("antecedent").agg(*counts).filter(F.greatest("blocked", F.col("n") - F.col("blocked")) >= least)
        less = F.transform(F.col("antecedent"), lambda t: F.array_remove(F.col("antecedent"), t))
        parts = counted.select("antecedent", "n", "blocked", F.explode(less).alias("less"))
        parts = parts.join(grows.select(F.col("antecedent").alias("less"), F.col("n").alias("less_n")), "less")
        whole = parts.groupBy("antecedent", "n", "blocked").agg(F.count("*").alias("k"), F.min("less_n").alias("fewest"))
        level = settle(whole.filter((F.col("k") == size + 1) & (F.col("n") < F.col("fewest"))).select("antecedent", "n", "blocked"))
        found = level if found is None else found.unionByName(level)
        grows = settle(level.filter(_mixed(total)))
        if grows.isEmpty():
            return found
        held = settle(met.join(grows.select("antecedent"), "antecedent", "left_semi").select(*held.columns))
        size += 1


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, best) of the URLs (row, tokens) that a rule matches; best is its confidence, hits, verdict and antecedent.

    The rules are posted under their rarest token, so a URL meets only the rules whose rarest token it has. The most confident one
    wins, then the one with more hits, then `block`, then the later antecedent.
    """
    alone = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("rules"))
    known = urls.select(F.explode("tokens").alias("token")).join(small(alone.select("token")), "token", "left_semi")
    counted = small(known.groupBy("token").agg(F.count("*").alias("urls")))
    exploded = rules.withColumn("token", F.explode("antecedent")).join(counted, "token", "left")
    rarest = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest")
    index = exploded.groupBy("antecedent", "verdict", "hits", "n").agg(rarest).select(F.col("rarest.token").alias("token"), "*").drop("rarest")
    met = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(small(index), "token")
    met = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct((F.col("hits") / F.col("n")).alias("confidence"), "hits", "verdict", "antecedent", "n")).alias("best")
    return met.groupBy("row").agg(best)


def url_filter(
    pages: DataFrame,
    url: str = "url",
    page_id: str = "page_id",
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence) of each row.

    `rule` is the longest stated rule that fits, or null; its verdict holds. Other URLs get the verdict of their best mined rule
    (columns mined and confidence), or `allow` if none matches. `labelled` has the columns url and verdict to learn from; rows
    with a null in either are ignored. Without it, the URLs that a stated rule decides are learned from: the mined rules carry the
    list's decisions over to hosts that it doesn't name. A null URL, or one without `://`, has an empty host and path, no
    tokens of them, and is allowed. Repeated rows are judged each, ties are broken as in `match`. Other columns are ignored, whatever
    their names; an empty table gives an empty one.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    made = tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    row = F.monotonically_increasing_id().alias("row")
    rows = settle(rows.select(row, "id", "host", "path", rule.alias("rule"), verdict.alias("stated"), made))
    if labelled is None:
        known = rows.filter("stated is not null").select("tokens", F.col("stated").alias("verdict"))
    else:
        host, path = parts(F.col("url"))
        known = labelled.select("url", "verdict").dropna().select(tokens(F.col("url"), host, path).alias("tokens"), "verdict")
    best = match(rows.filter("stated is null").select("row", "tokens"), mine(known, support, confidence))
    out = rows.join(best, "row", "left")
    return out.select(
        F.col("id").alias(page_id),
        "host",
        "path",
        "rule",
        F.coalesce("stated", "best.verdict", F.lit(ALLOW)).alias("verdict"),
        F.array_join("best.antecedent", " ").alias("mined"),
        F.col("best.confidence").alias("confidence"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")
