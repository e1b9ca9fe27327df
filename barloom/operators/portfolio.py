"""Risk reports for any number of portfolios.

Portfolio-level figures never form pairs: variance, risk contributions and the mean correlation follow from the
portfolio's own return series. Only the covariance matrix, whose output is the pairs, joins all holdings with each
other, and that join is cut into blocks so that one large book spreads over many tasks. Pairs above a correlation are
found by a bound from reference series first.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import clip, running, spread
from ..functions.lineage import settle
from ..functions.skew import salted_join
from ..settings import DEFAULTS, Settings
from .performance import sharpe, sortino

BOOK = ("portfolio_id",)
LEAST_DAYS = 30
LARGE_BOOK = 1000  # holdings from which a book's years are put together in different tasks
PAIR_BLOCK = 64
REFERENCES = 32  # reference series of a threshold join on correlation
NEW_AXIS = 0.01  # squared length that a reference must add to the span of those before it
MARGIN = 1e-6  # of the bound on a correlation, for rounding


def weigh(holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid holdings with `weight`, `total_value`, `n_holdings`; rejected portfolios).

    A portfolio with a missing or non-positive amount is rejected whole. Totals are aggregated and joined back,
    so a very large portfolio is never one window partition.
    """
    totals = holdings.groupBy(*BOOK).agg(
        F.sum("amount").alias("total_value"),
        F.count("*").alias("n_holdings"),
        F.count_if(F.col("amount").isNull() | (F.col("amount") <= 0)).alias("bad_amounts"),
    )
    good = totals.filter(F.col("bad_amounts") == 0).drop("bad_amounts")
    weighted = holdings.join(good, list(BOOK)).withColumn("weight", F.col("amount") / F.col("total_value"))
    return weighted, totals.filter(F.col("bad_amounts") > 0).select(*BOOK, "bad_amounts")


def not_in_panel(holdings: DataFrame, panel: DataFrame) -> DataFrame:
    return holdings.join(panel.select("instrument").distinct(), "instrument", "left_anti")


def _held_returns(weighted: DataFrame, returns: DataFrame) -> DataFrame:
    """A row per holding and day with a return, partitioned by book and `_part` (the year in large books, else 0).

    Holdings travel with arrays of a year's days and are unfolded where their book is put together, so that a day costs
    twelve bytes on the way. What groups by book, `_part` and day then needs no other exchange.
    """
    cols = weighted.select(*BOOK, "instrument", "weight", "n_holdings", "total_value")
    known = returns.select("instrument", "date", F.col("Adj_Return").alias("r")).filter(F.col("r").isNotNull())
    years = known.groupBy("instrument", F.year("date").alias("_year")).agg(F.sort_array(F.collect_list(F.struct("date", "r"))).alias("_all"))
    years = years.select("instrument", "_year", F.transform("_all", lambda x: x["date"]).alias("_dates"), F.transform("_all", lambda x: x["r"]).alias("_r"))
    # A holding meets every year of its instrument, so a name held by very many books is salted.
    rows = salted_join(cols, years, "instrument", "portfolio_id")
    rows = rows.withColumn("_part", F.when(F.col("n_holdings") > LARGE_BOOK, F.col("_year")).otherwise(0))
    rows = spread(rows.drop("_year"), *BOOK, "_part")
    rows = rows.select(*cols.columns, "_part", "_r", F.posexplode("_dates").alias("_k", "date"))
    return rows.select(*cols.columns, "_part", "date", F.get("_r", F.col("_k")).alias("r"))


def aligned_panel(weighted: DataFrame, returns: DataFrame) -> DataFrame:
    """Log returns on the days every holding has one: (portfolio_id, date, instrument, weight, r, port_log).

    The window holds one portfolio on one day. The 30-day minimum is tested where rows are next aggregated
    (every holding of a book has the same number of aligned days); `long_enough` applies it to raw rows. Rows stay where
    `_held_returns` put them together and keep its `_part`; n_holdings is a book's own, so a condition on it is met before.
    """
    day = Window.partitionBy(*BOOK, "n_holdings", "_part", "date")
    rows = _held_returns(weighted, returns).withColumns(
        {"_n": F.count("*").over(day), "port_log": F.sum(F.col("weight") * F.col("r")).over(day)}
    )
    return rows.filter(F.col("_n") == F.col("n_holdings")).drop("_n")


def long_enough(aligned: DataFrame) -> DataFrame:
    """Only portfolios with at least 30 aligned days."""
    days = aligned.groupBy(*BOOK).agg((F.count("*") / F.first("n_holdings")).alias("_days"))
    return aligned.join(days.filter(F.col("_days") >= LEAST_DAYS).select(*BOOK), list(BOOK), "left_semi")


def book_series(weighted: DataFrame, returns: DataFrame) -> DataFrame:
    """(portfolio_id, date, port_log, port_simple, …): weighted log return on fully covered days."""
    days = _held_returns(weighted, returns).groupBy(*BOOK, "_part", "date").agg(
        F.count("*").alias("_n"),
        F.sum(F.col("weight") * F.col("r")).alias("port_log"),
        F.first("n_holdings").alias("n_holdings"),
        F.first("total_value").alias("total_value"),
    )
    days = days.filter(F.col("_n") == F.col("n_holdings")).drop("_n", "_part")
    return days.withColumn("port_simple", F.expm1("port_log"))


def aligned_closes(panel: DataFrame) -> DataFrame:
    """Closes on the days every instrument of the panel has one."""
    n = panel.filter(F.col("close").isNotNull()).agg(F.count_distinct("instrument")).scalar()
    known = panel.filter(F.col("close").isNotNull()).select("date", "instrument", "close")
    days = known.groupBy("date").agg(F.count("*").alias("_n")).filter(F.col("_n") == n).select("date")
    return known.join(F.broadcast(days), "date", "left_semi")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _once(value: Column, use) -> Column:
    """`use(value)`, with `value` worked out once although `use` names it inside a fold over other elements."""
    return F.transform(F.array(value), use)[0]


def held_series(aligned: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per holding of a book with at least 30 aligned days: its statistics and its returns, one value per day.

    `_days` names the set of days: books with the same days share their series. `_block` of `_blocks` deals the names
    of a book into blocks of 64.
    """
    held = aligned.groupBy(*BOOK, "instrument").agg(
        F.sort_array(F.collect_list(F.struct("date", "r"))).alias("all"),
        F.avg("r").alias("_mean"),
        F.first("n_holdings").alias("n"),
        *_holding_columns(cfg),
    )
    days = F.transform("all", lambda x: x["date"])
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    return held.filter(F.size("all") >= LEAST_DAYS).select(
        *BOOK, "instrument", "days", "weight", "vol", "cov_with_book",
        F.struct(F.xxhash64(days), F.hash(days), F.size("all")).alias("_days"),
        F.transform("all", lambda x: x["r"] - F.col("_mean")).alias("v"),
        blocks.alias("_blocks"), F.pmod(F.xxhash64("instrument"), blocks).cast("int").alias("_block"),
    )


def _shared_series(held: DataFrame) -> DataFrame:
    """(_days, instrument, v, ss): centred returns and their sum of squares, once for all books with these days."""
    return held.groupBy("_days", "instrument").agg(F.first("v").alias("v")).withColumn("ss", _dot(F.col("v"), F.col("v")))


def _book_pairs(held: DataFrame, carried: tuple[str, ...] = (), keep=None) -> DataFrame:
    """(portfolio_id, _days, i, j) with i <= j, listed block by block: each pair of blocks is its own join key.

    `keep(left, right)` is a condition on the `carried` columns of both sides; it is tested inside the join.
    """
    left = held.select(
        *BOOK, "_days", F.col("instrument").alias("i"), F.col("_block").alias("_lo"), *[F.col(c).alias(f"_l{c}") for c in carried],
        F.explode(F.sequence("_block", F.col("_blocks") - 1)).alias("_hi"),
    )
    right = held.select(
        *BOOK, F.col("instrument").alias("j"), F.col("_block").alias("_hi"), *[F.col(c).alias(f"_r{c}") for c in carried],
        F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_lo"),
    )
    pairs = left.join(right, [*BOOK, "_lo", "_hi"]).filter((F.col("_lo") < F.col("_hi")) | (F.col("i") <= F.col("j")))
    if keep is not None:
        pairs = pairs.filter(keep([F.col(f"_l{c}") for c in carried], [F.col(f"_r{c}") for c in carried]))
    return pairs.select(*BOOK, "_days", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def _measured(pairs: DataFrame, series: DataFrame, cfg: Settings) -> DataFrame:
    """(portfolio_id, i, j, cov, corr): a pair is worked out once for a set of days, then joined to all books that hold it."""
    a = series.select("_days", F.col("instrument").alias("i"), F.col("v").alias("_a"), F.col("ss").alias("_aa"))
    b = series.select("_days", F.col("instrument").alias("j"), F.col("v").alias("_b"), F.col("ss").alias("_bb"))
    once = pairs.select("_days", "i", "j").distinct().join(a, ["_days", "i"]).join(b, ["_days", "j"])
    once = once.withColumn("_xy", _dot(F.col("_a"), F.col("_b"))).select(
        "_days",
        "i",
        "j",
        (F.col("_xy") / (F.size("_a") - 1) * cfg.trading_days).alias("cov"),
        (F.col("_xy") / F.nullif(F.sqrt(F.col("_aa") * F.col("_bb")), F.lit(0.0))).alias("corr"),
    )
    return pairs.join(once, ["_days", "i", "j"]).select(*BOOK, "i", "j", "cov", "corr")


def matrices(aligned: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(portfolio_id, i, j, cov, corr) for i <= j, annualised covariance; here the pairs are the output."""
    # Pairs and series both read the holdings, whose days are put together once.
    held = settle(held_series(aligned, cfg).select(*BOOK, "instrument", "_days", "v", "_blocks", "_block"))
    return _measured(_book_pairs(held), _shared_series(held), cfg)


def _with_angles(series: DataFrame, references: int) -> DataFrame:
    """Adds `p`, the coordinates of the unit series in the span of some reference series, and `rest`, the length outside it.

    The references of a set of days are its names of smallest hash. They are made orthonormal by array folds (modified
    Gram-Schmidt); one that lies almost in the span of those before it is left out, as it would say nothing new.
    """
    unit = series.filter(F.col("ss") > 0).withColumn("v", F.transform("v", lambda x: x / F.sqrt("ss")))
    order = Window.partitionBy("_days").orderBy(F.xxhash64("instrument"), "instrument")  # limited per task before the shuffle
    chosen = unit.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= references)
    chosen = chosen.groupBy("_days").agg(F.sort_array(F.collect_list(F.struct("_k", "v"))).alias("_refs"))

    def less(vector: Column, axis: Column) -> Column:
        return _once(_dot(vector, axis), lambda c: F.zip_with(vector, axis, lambda x, y: x - c * y))

    def widened(axes: Column, ref: Column) -> Column:
        outside = F.aggregate(axes, ref["v"], less)
        return _once(outside, lambda o: _once(_dot(o, o), lambda s: F.when(s < NEW_AXIS, axes).otherwise(
            F.concat(axes, F.array(F.transform(o, lambda x: x / F.sqrt(s))))
        )))

    axes = F.aggregate("_refs", F.array().cast("array<array<double>>"), widened)
    spans = chosen.select("_days", axes.alias("_axes"))
    placed = unit.join(spans, "_days").withColumn("p", F.transform("_axes", lambda axis: _dot(F.col("v"), axis)))
    rest = F.sqrt(F.greatest(1 - _dot(F.col("p"), F.col("p")), F.lit(0.0)))
    return placed.select("_days", "instrument", "p", rest.alias("rest"))


def close_pairs(held: DataFrame, least: float, references: int = REFERENCES) -> DataFrame:
    """(portfolio_id, _days, i, j), i < j: a superset of the pairs of `held_series` whose correlation exceeds `least`.

    With unit series split into a part p in the span of the references and a rest r, the correlation is p.p' + r.r',
    and r.r' is at most |r||r'|. A pair whose bound stays below `least` is dropped inside the join, before its series
    are looked at. Nothing is lost: the margin is far wider than rounding, and the bound holds for any references.
    """
    placed = held.join(_with_angles(_shared_series(held), references), ["_days", "instrument"])

    def keep(left, right):
        (p, rest), (q, other) = left, right
        return (F.col("i") != F.col("j")) & (_dot(p, q) + rest * other > least - MARGIN)

    return _book_pairs(placed, ("p", "rest"), keep)


def correlated_pairs(held: DataFrame, least: float, cfg: Settings = DEFAULTS, references: int = REFERENCES) -> DataFrame:
    """(portfolio_id, i, j, cov, corr) of all pairs i < j of `held_series` with a correlation above `least`."""
    return _measured(close_pairs(held, least, references), _shared_series(held), cfg).filter(F.col("corr") > least)


def rejected_books(weighted: DataFrame, returns: DataFrame) -> DataFrame:
    """(portfolio_id, reason, unknown_names, common_days) of the books that the risk reports leave out, and why.

    Either a name isn't in the panel at all, or the names share fewer than 30 days with a return.
    """
    names = returns.select("instrument").distinct().withColumn("_known", F.lit(1))
    known = weighted.join(names, "instrument", "left").groupBy(*BOOK).agg(
        F.count_if(F.col("_known").isNull()).alias("unknown_names")
    )
    days = book_series(weighted, returns).groupBy(*BOOK).agg(F.count("*").alias("common_days"))
    both = known.join(days, list(BOOK), "left").withColumn("common_days", F.coalesce("common_days", F.lit(0)).cast("long"))
    reason = F.when(F.col("unknown_names") > 0, "unknown name").when(F.col("common_days") < LEAST_DAYS, "too few common days")
    return both.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*BOOK, "reason", "unknown_names", "common_days")


def _holding_columns(cfg: Settings) -> list[Column]:
    return [
        F.count("*").alias("days"),
        F.first("weight").alias("weight"),
        (F.stddev_samp("r") * sqrt(cfg.trading_days)).alias("vol"),
        (F.covar_samp("r", "port_log") * cfg.trading_days).alias("cov_with_book"),
    ]


def holding_stats(aligned: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Per holding on the aligned panel: sigma and covariance with the portfolio, both annualised."""
    stats = aligned.groupBy(*BOOK, "instrument").agg(*_holding_columns(cfg))
    return stats.filter(F.col("days") >= LEAST_DAYS)


def book_metrics(weighted: DataFrame, returns: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Return, volatility, diversification benefit, Sharpe, Sortino, max drawdown per portfolio."""
    alone = holding_stats(aligned_panel(weighted, returns), cfg).groupBy(*BOOK).agg(F.sum(F.col("weight") * F.col("vol")).alias("weighted_avg_individual_vol"))
    days = book_series(weighted, returns)
    days = days.withColumn("_log", F.sum("port_log").over(running(BOOK)))
    days = days.withColumn("_dd", F.exp(F.col("_log") - F.max("_log").over(running(BOOK))) - 1)
    out = days.groupBy(*BOOK).agg(
        F.count("*").alias("days"),
        (F.avg("port_log") * cfg.trading_days).alias("ann_return"),
        (F.stddev_samp("port_log") * sqrt(cfg.trading_days)).alias("ann_vol"),
        sharpe(F.col("port_simple"), cfg).alias("sharpe"),
        sortino(F.col("port_simple"), cfg).alias("sortino"),
        F.min("_dd").alias("max_drawdown"),
        F.first("total_value").alias("total_value"),
        F.first("n_holdings").alias("n_holdings"),
    )
    out = out.filter(F.col("days") >= LEAST_DAYS).join(alone, list(BOOK))
    return out.withColumn("diversification_benefit", F.col("weighted_avg_individual_vol") - F.col("ann_vol"))


def instrument_stats(returns: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Stand-alone statistics on the full history, once per instrument however many portfolios hold it."""
    df = returns.filter(F.col("Adj_Return").isNotNull()).select("instrument", "date", "Adj_Return")
    df = df.withColumn("_log", F.sum("Adj_Return").over(running()))
    # The curve starts after the first return, as a compounded product does.
    df = df.withColumn("_dd", F.exp(F.col("_log") - F.max("_log").over(running())) - 1)
    return df.groupBy("instrument").agg(
        (F.avg("Adj_Return") * cfg.trading_days).alias("ann_return"),
        (F.stddev_samp("Adj_Return") * sqrt(cfg.trading_days)).alias("ann_vol"),
        sharpe(F.expm1("Adj_Return"), cfg).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"),
        F.count("*").alias("history"),
    )


def with_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    return df.join(sectors.select("instrument", "sector"), "instrument", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Other"))
    )


def stock_table(weighted: DataFrame, returns: DataFrame, sectors: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    held = weighted.select(*BOOK, "instrument", "weight", F.col("amount").alias("value"))
    return with_sector(held.join(instrument_stats(returns, cfg), "instrument"), sectors)


def risk_contributions(parts: DataFrame) -> DataFrame:
    """From `holding_stats`: weight * cov(holding, book) / sigma(book); the parts add up to sigma. Empty for a riskless book."""
    var = parts.groupBy(*BOOK).agg(F.sum(F.col("weight") * F.col("cov_with_book")).alias("_var"))
    df = parts.join(var.filter(F.col("_var") > 0), list(BOOK))
    risk = F.col("weight") * F.col("cov_with_book")
    return df.select(
        *BOOK,
        "instrument",
        "weight",
        (risk / F.sqrt("_var")).alias("risk_contribution"),
        (risk / F.col("_var")).alias("risk_contribution_pct"),
        (F.col("cov_with_book") / F.col("_var")).alias("risk_vs_weight"),
    )


def mean_correlation(aligned: DataFrame) -> DataFrame:
    """Mean off-diagonal correlation from the variance of the summed standardised returns.

    A book that is one part has all its rows in one task, so names and days are summed up there and only a row per book travels.
    The years of a large book are brought together by name, then by day.
    """
    large = F.col("n_holdings") > LARGE_BOOK
    whole, parted = _mean_correlation(aligned.filter(~large), (*BOOK, "_part")), _mean_correlation(aligned.filter(large), BOOK)
    return whole.unionByName(parted)


def _mean_correlation(aligned: DataFrame, together) -> DataFrame:
    """`mean_correlation` of books whose rows are together by the columns `together`."""
    own = Window.partitionBy(*together, "instrument")
    z = aligned.withColumns({"_m": F.avg("r").over(own), "_s": F.stddev_samp("r").over(own)}).filter(F.col("_s") > 0)
    days = z.groupBy(*together, "date").agg(
        F.sum((F.col("r") - F.col("_m")) / F.col("_s")).alias("_z"), F.count("*").alias("_n")
    )
    n = F.max("_n")
    out = days.groupBy(*BOOK).agg(
        F.count("*").alias("_days"),
        ((F.var_samp("_z") - n) / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0))).alias("mean_pairwise_correlation"),
    )
    return out.filter(F.col("_days") >= LEAST_DAYS).drop("_days")


def sector_exposure(weighted: DataFrame, sectors: DataFrame) -> DataFrame:
    return with_sector(weighted, sectors).groupBy(*BOOK, "sector").agg(
        F.sum("weight").alias("weight"), F.sum("amount").alias("value"), F.count("*").alias("n")
    )


def diversification(weighted: DataFrame, aligned: DataFrame, sectors: DataFrame) -> DataFrame:
    """Score 0..100 out of correlation, sector entropy and effective number of names."""
    p = F.col("weight")
    sectored = sector_exposure(weighted, sectors).groupBy(*BOOK).agg(
        (-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))).alias("sector_entropy"), F.count("*").alias("_k")
    )
    hhi = weighted.groupBy(*BOOK).agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"))
    df = mean_correlation(aligned).join(sectored, list(BOOK)).join(hhi, list(BOOK))
    df = df.withColumns(
        {
            "effective_n": 1 / F.col("hhi"),
            "correlation_score": clip((1 - F.col("mean_pairwise_correlation")) * 100, 0.0, 100.0),
            "sector_score": F.least(F.col("sector_entropy") / F.ln(F.greatest(F.col("_k"), F.lit(2))) * 100, F.lit(100.0)),
        }
    )
    df = df.withColumn("weight_score", clip((F.col("effective_n") - 1) / 9 * 100, 0.0, 100.0))
    score = 0.50 * F.col("correlation_score") + 0.25 * F.col("sector_score") + 0.25 * F.col("weight_score")
    label = (
        F.when(F.col("score") >= 75, "Well Diversified")
        .when(F.col("score") >= 50, "Moderately Diversified")
        .when(F.col("score") >= 25, "Poorly Diversified")
        .otherwise("Highly Concentrated")
    )
    return df.withColumn("score", score).withColumn("label", label).drop("_k")


def value_at_risk(weighted: DataFrame, returns: DataFrame) -> DataFrame:
    """One-day historical VaR 95/99 and CVaR 95, as fractions and amounts."""
    days = book_series(weighted, returns)
    book = Window.partitionBy(*BOOK)  # one row per day
    x = F.col("port_simple")
    days = days.withColumns(
        {"var_95_pct": F.percentile(x, F.lit(0.05)).over(book), "var_99_pct": F.percentile(x, F.lit(0.01)).over(book)}
    )
    out = days.groupBy(*BOOK).agg(
        F.first("var_95_pct").alias("var_95_pct"),
        F.first("var_99_pct").alias("var_99_pct"),
        F.avg(F.when(x <= F.col("var_95_pct"), x)).alias("cvar_95_pct"),
        F.first("total_value").alias("_total"),
        F.count("*").alias("_days"),
    ).filter(F.col("_days") >= LEAST_DAYS)
    return out.withColumns(
        {f"{c}_amount": F.col(f"{c}_pct") * F.col("_total") for c in ("var_95", "var_99", "cvar_95")}
    ).drop("_total", "_days")


def hierarchy(stocks: DataFrame) -> DataFrame:
    """Weight and weight-averaged return of portfolio, sector and stock levels (0, 1, 2)."""
    sets = [
        [F.col("portfolio_id")],
        [F.col("portfolio_id"), F.col("sector")],
        [F.col("portfolio_id"), F.col("sector"), F.col("instrument")],
    ]
    g = stocks.groupingSets(sets, "portfolio_id", "sector", "instrument").agg(
        (2 - F.grouping("sector") - F.grouping("instrument")).cast("int").alias("level"),
        F.sum("weight").alias("weight"),
        (F.sum(F.col("weight") * F.col("ann_return")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("ann_return"),
    )
    return g


def warnings(weighted: DataFrame, aligned: DataFrame, returns: DataFrame, sectors: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(portfolio_id, type, severity, subject, value, message) of all five checks.

    One aggregate per book and name, written once, feeds the checks on histories, risk and correlation.
    """
    pct = lambda c: F.format_string("%.1f%%", c * 100)
    w = F.col("weight")

    def rows(df: DataFrame, kind: str, severity: Column | str, subject: Column, value: Column, message: Column) -> DataFrame:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return df.select(
            *BOOK,
            F.lit(kind).alias("type"),
            level.alias("severity"),
            subject.alias("subject"),
            value.cast("double").alias("value"),
            message.alias("message"),
        )

    # Histories per instrument, then per book: the longest, and who is below 60 % of it.
    history = returns.filter(F.col("Adj_Return").isNotNull()).groupBy("instrument").agg(F.count("*").alias("history"))
    lengths = weighted.select(*BOOK, "instrument").join(history, "instrument")
    longest = lengths.groupBy(*BOOK).agg(F.max("history").alias("_max"))
    held = settle(held_series(aligned, cfg))
    stats = held.select(*BOOK, "instrument", "days", "weight", "vol", "cov_with_book")
    common = stats.groupBy(*BOOK).agg(F.first("days").cast("double").alias("_common"))
    short = (
        lengths.join(longest, list(BOOK))
        .filter(F.col("history") < 0.6 * F.col("_max"))
        .join(common, list(BOOK))
        .filter(F.col("_common") < 0.6 * F.col("_max"))
        .groupBy(*BOOK)
        .agg(F.array_join(F.array_sort(F.collect_list("instrument")), ", ").alias("names"), F.count("*").alias("n"), F.first("_common").alias("_common"))
    )
    verb = F.when(F.col("n") == 1, "has").otherwise("have")
    short_text = F.format_string(
        "%s %s limited price history — portfolio-level return/risk are measured over the ~%.1f-yr common window. Per-stock figures use full history.",
        F.col("names"), verb, F.col("_common") / cfg.trading_days,
    )
    c = F.col("corr")
    pairs = correlated_pairs(held, 0.75, cfg)
    rvw = F.col("risk_vs_weight")
    hogs = risk_contributions(stats).filter(rvw > 1.5)
    heavy = sector_exposure(weighted, sectors).filter(w > 0.50).join(common, list(BOOK), "left_semi")
    kept = weighted.join(common, list(BOOK), "left_semi")
    parts = [
        rows(short, "SHORT_HISTORY", "MEDIUM", F.col("names"), F.col("_common"), short_text),
        rows(
            kept.filter(w > 0.30), "CONCENTRATION", "HIGH", F.col("instrument"), w,
            F.concat(F.col("instrument"), F.lit(" is "), pct(w), F.lit(" of the book (>30%).")),
        ),
        rows(
            pairs, "HIGH_CORR", F.when(c > 0.90, "HIGH").otherwise("MEDIUM"), F.concat_ws("↔", "i", "j"), c,
            F.format_string("%s↔%s correlation %.2f (>0.75).", F.col("i"), F.col("j"), c),
        ),
        rows(
            hogs, "RISK_HOG", F.when(rvw > 2.0, "HIGH").otherwise("MEDIUM"), F.col("instrument"), rvw,
            F.concat(
                F.col("instrument"), F.lit(" contributes "), pct(F.col("risk_contribution_pct")), F.lit(" of risk on a "), pct(w),
                F.format_string(" weight (×%.2f).", rvw),
            ),
        ),
        rows(
            heavy, "SECTOR_CONC", "HIGH", F.col("sector"), w,
            F.concat(F.col("sector"), F.lit(" sector is "), pct(w), F.lit(" (>50%).")),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mark_to_market(holdings: DataFrame, quotes: DataFrame, closes: DataFrame) -> DataFrame:
    """Per holding `live_value` and whether a fresh quote produced it.

    Shares times last price; without shares the amount is scaled by last price over last close; without a fresh
    quote or a usable close the amount stands.
    """
    q = quotes.select("instrument", "last_price", F.coalesce("stale", F.lit(False)).alias("stale"))
    df = holdings.join(q, "instrument", "left").join(closes.select("instrument", F.col("close").alias("last_close")), "instrument", "left")
    usable = F.col("last_price").isNotNull() & ~F.col("stale")
    exact = usable & (F.col("quantity") > 0)
    implied = usable & (F.col("last_close") > 0)
    value = (
        F.when(exact, F.col("quantity") * F.col("last_price"))
        .when(implied, F.col("amount") / F.nullif(F.col("last_close"), F.lit(0.0)) * F.col("last_price"))
        .otherwise(F.col("amount"))
    )
    return df.withColumn("live_value", value).withColumn("fresh", F.coalesce(exact | implied, F.lit(False)))


def live_value(marked: DataFrame) -> DataFrame:
    """Per portfolio the live total and the gain over what was invested (else over the amounts); NULL when nothing is fresh."""
    cost = F.coalesce("invested", "amount") if "invested" in marked.columns else F.col("amount")
    df = marked.groupBy(*BOOK).agg(
        F.sum("live_value").alias("_live"), F.sum(cost).alias("baseline"), F.bool_or("fresh").alias("_fresh")
    )
    gain = F.col("_live") - F.col("baseline")
    return df.select(
        *BOOK,
        "baseline",
        F.when(F.col("_fresh"), F.col("_live")).alias("live_value"),
        F.when(F.col("_fresh"), gain).otherwise(0.0).alias("delta"),
        F.when(F.col("_fresh") & (F.col("baseline") > 0), gain / F.nullif(F.col("baseline"), F.lit(0.0))).otherwise(0.0).alias("delta_pct"),
    )
