"""Registered queries: portfolio risk on weekly brand bars; portfolios are customers."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import functions as F

from ..functions.lineage import settle
from ..operators import portfolio as pf
from ..operators.returns import with_returns
from ..settings import DEFAULTS
from ..sources import panels
from . import price_sql  # noqa: F401
from .common import big, cte, r, rnd, sql
from .price_sql import returns_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RF = DEFAULTS.rf_daily
YEAR = sqrt(252)


def register(name, oracle=None):
    def keep(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return run

    return keep


def returns(spark, sf):
    return with_returns(panels.weekly_bars(spark, sf))


def weighted(spark, sf):
    """One row per holding; read by several branches of a report, hence settled."""
    return settle(pf.weigh(panels.holdings(spark, sf))[0])


def aligned(spark, sf):
    return pf.aligned_panel(weighted(spark, sf), returns(spark, sf))


def sectors(spark, sf):
    parts = panels.table(spark, sf, "part").select(F.col("p_brand").alias("instrument"))
    return panels.brand_sectors(parts)


cte("wret", returns_sql("wbars"))
cte("wsectors", "SELECT DISTINCT p_brand AS instrument, 'S' || CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 5 AS sector FROM part")
cte(
    "weighted",
    "SELECT *, amount / total_value AS weight FROM (SELECT *, sum(amount) OVER (PARTITION BY portfolio_id) AS total_value, count(*) OVER (PARTITION BY portfolio_id) AS n_holdings FROM holdings)",
)


def panel_ctes(p: str, ret: str) -> None:
    cte(
        f"{p}al",
        f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS rows_ FROM (SELECT w.*, date, Adj_Return AS rr, count(*) OVER (PARTITION BY portfolio_id, date) AS nn, sum(weight * Adj_Return) OVER (PARTITION BY portfolio_id, date) AS port_log
FROM weighted w JOIN {ret} x ON w.instrument = x.instrument WHERE Adj_Return IS NOT NULL) WHERE nn = n_holdings) WHERE rows_ >= 30 * n_holdings""",
    )
    cte(
        f"{p}mat",
        f"""SELECT a.portfolio_id, a.instrument AS i, b.instrument AS j, covar_samp(a.rr, b.rr) * 252 AS cov, corr(a.rr, b.rr) AS corr_
FROM {p}al a JOIN {p}al b ON a.portfolio_id = b.portfolio_id AND a.date = b.date AND a.instrument <= b.instrument GROUP BY 1, 2, 3""",
    )
    cte(
        f"{p}risk",
        f"""SELECT portfolio_id, instrument, weight, weight * sw / sqrt(var) AS rc, weight * sw / var AS rcp, sw / var AS rvw FROM (SELECT *, sum(weight * sw) OVER (PARTITION BY portfolio_id) AS var FROM (
SELECT m.portfolio_id, w.instrument, w.weight, sum(cov * o.weight) AS sw FROM (SELECT portfolio_id, i, j, cov FROM {p}mat UNION ALL SELECT portfolio_id, j, i, cov FROM {p}mat WHERE i < j) m
JOIN weighted w ON m.portfolio_id = w.portfolio_id AND m.i = w.instrument JOIN weighted o ON m.portfolio_id = o.portfolio_id AND m.j = o.instrument GROUP BY 1, 2, 3)) WHERE var > 0""",
    )


panel_ctes("", "wret")
cte("pser", "SELECT portfolio_id, date, any_value(port_log) AS pl, exp(any_value(port_log)) - 1 AS ps, any_value(total_value) AS total_value, any_value(n_holdings) AS n_holdings FROM al GROUP BY 1, 2")
cte("pvol", "SELECT portfolio_id, instrument, any_value(weight) AS weight, stddev_samp(rr) AS sd FROM al GROUP BY 1, 2")
cte(
    "pmetrics",
    f"""SELECT *, wiv - ann_vol AS benefit FROM (SELECT portfolio_id, avg(pl) * 252 AS ann_return, stddev_samp(pl) * {YEAR!r} AS ann_vol, coalesce((avg(ps) - {RF!r}) / nullif(stddev_samp(ps), 0) * {YEAR!r}, 0) AS sharpe,
coalesce(CASE WHEN count(*) FILTER (ps < 0) > 1 THEN (avg(ps) - {RF!r}) / nullif(stddev_samp(ps) FILTER (ps < 0), 0) * {YEAR!r} END, 0) AS sortino, min(exp(cl - top) - 1) AS max_drawdown, any_value(total_value) AS total_value, any_value(n_holdings) AS n_holdings
FROM (SELECT *, max(cl) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT *, sum(pl) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS cl FROM pser)) GROUP BY portfolio_id)
JOIN (SELECT portfolio_id, sum(weight * sd) * {YEAR!r} AS wiv FROM pvol GROUP BY 1) USING (portfolio_id)""",
)
_bad = "CASE WHEN CAST(portfolio_id AS BIGINT) % 5 = 2 AND instrument LIKE '%1' THEN -amount ELSE amount END"
cte("planted", f"SELECT portfolio_id, instrument, {_bad} AS amount FROM holdings")


def planted(spark, sf):
    bad = (F.col("portfolio_id").cast("bigint") % 5 == 2) & F.col("instrument").endswith("1")
    return panels.holdings(spark, sf).withColumn("amount", F.when(bad, -F.col("amount")).otherwise(F.col("amount")))


@register(
    "PF1_weights",
    f"SELECT portfolio_id, instrument, {r('amount', 2)}, {r('amount / sum(amount) OVER (PARTITION BY portfolio_id)', 8, 'weight')} FROM planted WHERE portfolio_id NOT IN (SELECT portfolio_id FROM planted WHERE amount <= 0)",
)
def _(spark, sf):
    return pf.weigh(planted(spark, sf))[0].select("portfolio_id", "instrument", rnd("amount", 2), rnd("weight", 8))


@register("PF1_rejected_portfolios", "SELECT portfolio_id, count(*) AS bad_amounts FROM planted WHERE amount <= 0 GROUP BY 1")
def _(spark, sf):
    return pf.weigh(planted(spark, sf))[1]



@register("PF2_unknown_holdings", "SELECT portfolio_id, instrument FROM holdings WHERE instrument NOT IN (SELECT instrument FROM wbars WHERE date = (SELECT max(date) FROM wbars) AND volume >= 150)")
def _(spark, sf):
    bars = panels.weekly_bars(spark, sf)
    traded = bars.filter((F.col("date") == bars.agg(F.max("date")).scalar()) & (F.col("volume") >= 150))
    return pf.not_in_panel(panels.holdings(spark, sf), traded).select("portfolio_id", "instrument")


cte(
    "short_books",
    """SELECT portfolio_id, CASE WHEN unknown_names > 0 THEN 'unknown name' ELSE 'too few common days' END AS reason, unknown_names, coalesce(common_days, 0) AS common_days
FROM (SELECT portfolio_id, count(*) FILTER (instrument NOT IN (SELECT instrument FROM early)) AS unknown_names FROM weighted GROUP BY 1)
LEFT JOIN (SELECT portfolio_id, count(*) AS common_days FROM (SELECT portfolio_id, date, count(*) AS k, any_value(n_holdings) AS n FROM weighted JOIN early USING (instrument) WHERE Adj_Return IS NOT NULL GROUP BY 1, 2) WHERE k = n GROUP BY 1) USING (portfolio_id)
WHERE unknown_names > 0 OR coalesce(common_days, 0) < 30""",
)
cte(
    "early",
    "SELECT * FROM wret WHERE CAST(regexp_extract(instrument, '(\\d+)', 1) AS INT) <> 13 AND (CAST(regexp_extract(instrument, '(\\d+)', 1) AS INT) <> 24 OR date < DATE '1992-06-01')",
)


@register("PF_rejected_books", "SELECT portfolio_id, reason, unknown_names, common_days FROM short_books")
def _(spark, sf):
    """Defects are planted in the panel: brand 13 has no bars, brand 24 none after its first months."""
    number = F.regexp_extract("instrument", r"(\d+)", 1).cast("int")
    panel = returns(spark, sf).filter((number != 13) & ((number != 24) | (F.col("date") < F.lit("1992-06-01").cast("date"))))
    return pf.rejected_books(weighted(spark, sf), panel)


@register("PF3_aligned_returns", f"SELECT portfolio_id, date, instrument, {r('rr', 8, 'r')} FROM al")
def _(spark, sf):
    return pf.long_enough(aligned(spark, sf)).select("portfolio_id", "date", "instrument", rnd("r", 8))


@register("PF4_aligned_closes", f"SELECT date, instrument, {r('close', 5)} FROM wbars QUALIFY count(*) OVER (PARTITION BY date) = (SELECT count(DISTINCT instrument) FROM wbars)")
def _(spark, sf):
    return pf.aligned_closes(panels.weekly_bars(spark, sf)).select("date", "instrument", rnd("close", 5))


@register("PF5_covariance", f"SELECT portfolio_id, i, j, {r('cov', 6)} FROM mat")
def _(spark, sf):
    return pf.matrices(aligned(spark, sf)).select("portfolio_id", "i", "j", rnd("cov", 6))


@register("PF6_correlation", f"SELECT portfolio_id, i, j, {r('corr_', 6, 'corr')} FROM mat")
def _(spark, sf):
    return pf.matrices(aligned(spark, sf)).select("portfolio_id", "i", "j", rnd("corr", 6))


@register("PF7_portfolio_returns", f"SELECT portfolio_id, date, {r('pl', 8, 'port_log')}, {r('ps', 8, 'port_simple')} FROM pser")
def _(spark, sf):
    return pf.book_series(weighted(spark, sf), returns(spark, sf)).select("portfolio_id", "date", rnd("port_log", 8), rnd("port_simple", 8))


@register(
    "PF8_portfolio_metrics",
    f"SELECT portfolio_id, n_holdings, {r('total_value', 2)}, "
    + ", ".join(r(c, 6) for c in ("ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown"))
    + f", {r('wiv', 6, 'weighted_avg_individual_vol')}, {r('benefit', 6, 'diversification_benefit')} FROM pmetrics",
)
def _(spark, sf):
    cols = ("ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "weighted_avg_individual_vol", "diversification_benefit")
    return pf.book_metrics(weighted(spark, sf), returns(spark, sf)).select("portfolio_id", "n_holdings", rnd("total_value", 2), *[rnd(c, 6) for c in cols])


cte(
    "istats",
    f"""SELECT instrument, avg(x) * 252 AS ann_return, stddev_samp(x) * {YEAR!r} AS ann_vol, coalesce((avg(exp(x) - 1) - {RF!r}) / nullif(stddev_samp(exp(x) - 1), 0) * {YEAR!r}, 0) AS sharpe, min(exp(cl - top) - 1) AS max_drawdown, count(*) AS history
FROM (SELECT *, max(cl) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT instrument, date, Adj_Return AS x, sum(Adj_Return) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING) AS cl FROM wret WHERE Adj_Return IS NOT NULL)) GROUP BY 1""",
)
cte("stocks", "SELECT portfolio_id, instrument, weight, amount AS value, sector, ann_return, ann_vol, sharpe, max_drawdown FROM weighted JOIN istats USING (instrument) JOIN wsectors USING (instrument)")


@register(
    "PF9_stock_metrics",
    f"SELECT portfolio_id, instrument, sector, {r('weight', 8)}, {r('value', 2)}, " + ", ".join(r(c, 6) for c in ("ann_return", "ann_vol", "sharpe", "max_drawdown")) + " FROM stocks",
)
def _(spark, sf):
    df = pf.stock_table(weighted(spark, sf), returns(spark, sf), sectors(spark, sf))
    return df.select("portfolio_id", "instrument", "sector", rnd("weight", 8), rnd("value", 2), *[rnd(c, 6) for c in ("ann_return", "ann_vol", "sharpe", "max_drawdown")])


@register(
    "PF10_risk_contributions",
    f"SELECT portfolio_id, instrument, {r('weight', 8)}, {r('rc', 6, 'risk_contribution')}, {r('rcp', 6, 'risk_contribution_pct')}, {r('rvw', 6, 'risk_vs_weight')} FROM risk",
)
def _(spark, sf):
    df = pf.risk_contributions(pf.holding_stats(aligned(spark, sf)))
    return df.select("portfolio_id", "instrument", rnd("weight", 8), *[rnd(c, 6) for c in ("risk_contribution", "risk_contribution_pct", "risk_vs_weight")])


cte(
    "divers",
    """SELECT *, 0.5::DOUBLE * cs + 0.25::DOUBLE * ss + 0.25::DOUBLE * ws AS score FROM (SELECT *, least(greatest((1 - mc) * 100, 0), 100) AS cs, least(entropy / ln(greatest(k, 2)) * 100, 100) AS ss, least(greatest((1 / hhi - 1) / 9 * 100, 0), 100) AS ws
FROM (SELECT portfolio_id, avg(corr_) AS mc FROM mat WHERE i < j GROUP BY 1) JOIN (SELECT portfolio_id, -sum(p * ln(p)) AS entropy, count(*) AS k FROM (SELECT portfolio_id, sector, sum(weight) AS p FROM weighted JOIN wsectors USING (instrument) GROUP BY 1, 2) GROUP BY 1) USING (portfolio_id)
JOIN (SELECT portfolio_id, sum(weight * weight) AS hhi FROM weighted GROUP BY 1) USING (portfolio_id))""",
)


@register(
    "PF11_diversification",
    f"""SELECT portfolio_id, {r('mc', 6, 'mean_pairwise_correlation')}, CASE WHEN abs(entropy) < 1e-9 THEN 0.0 ELSE round(entropy, 6) END AS sector_entropy, {r('hhi', 6)}, {r('1 / hhi', 6, 'effective_n')}, {r('score', 4)},
CASE WHEN score >= 75 THEN 'Well Diversified' WHEN score >= 50 THEN 'Moderately Diversified' WHEN score >= 25 THEN 'Poorly Diversified' ELSE 'Highly Concentrated' END AS label FROM divers""",
)
def _(spark, sf):
    held = weighted(spark, sf)
    df = pf.diversification(held, pf.aligned_panel(held, returns(spark, sf)), sectors(spark, sf))
    return df.select("portfolio_id", *[rnd(c, 6) for c in ("mean_pairwise_correlation", "sector_entropy", "hhi", "effective_n")], rnd("score", 4), "label")


cte("pvar", "SELECT portfolio_id, quantile_cont(ps, 0.05) AS v95, quantile_cont(ps, 0.01) AS v99, any_value(total_value) AS total_value FROM pser GROUP BY 1")


@register(
    "PF12_value_at_risk",
    f"""SELECT portfolio_id, {r('v95', 6, 'var_95_pct')}, {r('v99', 6, 'var_99_pct')}, {r('c95', 6, 'cvar_95_pct')}, {r('v95 * tv', 2, 'var_95_amount')}, {r('v99 * tv', 2, 'var_99_amount')}, {r('c95 * tv', 2, 'cvar_95_amount')}
FROM (SELECT portfolio_id, any_value(v95) AS v95, any_value(v99) AS v99, any_value(v.total_value) AS tv, avg(ps) FILTER (ps <= v95) AS c95 FROM pser JOIN pvar v USING (portfolio_id) GROUP BY 1)""",
)
def _(spark, sf):
    df = pf.value_at_risk(weighted(spark, sf), returns(spark, sf))
    return df.select("portfolio_id", *[rnd(f"{c}_pct", 6) for c in ("var_95", "var_99", "cvar_95")], *[rnd(f"{c}_amount", 2) for c in ("var_95", "var_99", "cvar_95")])


@register(
    "PF13_sector_exposure",
    f"SELECT portfolio_id, sector, {r('sum(weight)', 8, 'weight')}, {r('sum(amount)', 2, 'value')}, count(*) AS n FROM weighted JOIN wsectors USING (instrument) GROUP BY 1, 2",
)
def _(spark, sf):
    df = pf.sector_exposure(weighted(spark, sf), sectors(spark, sf))
    return df.select("portfolio_id", "sector", rnd("weight", 8), rnd("value", 2), "n")


@register(
    "PF14_hierarchy",
    f"SELECT portfolio_id, sector, instrument, 2 - grouping(sector) - grouping(instrument) AS level, {r('sum(weight)', 8, 'weight')}, {r('sum(weight * ann_return) / sum(weight)', 6, 'ann_return')} FROM stocks GROUP BY GROUPING SETS ((portfolio_id), (portfolio_id, sector), (portfolio_id, sector, instrument))",
)
def _(spark, sf):
    stocks = pf.stock_table(weighted(spark, sf), returns(spark, sf), sectors(spark, sf))
    return pf.hierarchy(stocks).select("portfolio_id", "sector", "instrument", big("level"), rnd("weight", 8), rnd("ann_return", 6))


# Two brands listed late, so that short histories occur.
LATE = "2000-06-01"
_late = f"NOT (instrument IN ('Brand#7', 'Brand#13') AND date < DATE '{LATE}')"
cte("lret", f"SELECT * FROM wret WHERE {_late}")
panel_ctes("l_", "lret")
cte("hist", "SELECT instrument, count(*) AS history FROM lret WHERE Adj_Return IS NOT NULL GROUP BY 1")
cte("common_len", "SELECT portfolio_id, count(*)::DOUBLE / any_value(n_holdings) AS common FROM l_al GROUP BY 1")
cte(
    "short_names",
    """SELECT portfolio_id, string_agg(instrument, ', ' ORDER BY instrument) AS names, count(*) AS n, any_value(common) AS common FROM (SELECT portfolio_id, instrument, history, max(history) OVER (PARTITION BY portfolio_id) AS longest FROM weighted JOIN hist USING (instrument))
JOIN common_len USING (portfolio_id) WHERE history < 0.6 * longest AND common < 0.6 * longest GROUP BY 1""",
)


@register(
    "PF15_warnings",
    f"""SELECT portfolio_id, type, severity, subject, {r('value', 6)}, message FROM (
SELECT portfolio_id, 'SHORT_HISTORY' AS type, 'MEDIUM' AS severity, names AS subject, common AS value, names || CASE WHEN n = 1 THEN ' has' ELSE ' have' END || printf(' limited price history — portfolio-level return/risk are measured over the ~%.1f-yr common window. Per-stock figures use full history.', common / 252) AS message FROM short_names
UNION ALL SELECT portfolio_id, 'CONCENTRATION', 'HIGH', instrument, weight, instrument || ' is ' || printf('%.1f%%', weight * 100) || ' of the book (>30%).' FROM weighted JOIN common_len USING (portfolio_id) WHERE weight > 0.3
UNION ALL SELECT portfolio_id, 'HIGH_CORR', CASE WHEN corr_ > 0.9 THEN 'HIGH' ELSE 'MEDIUM' END, i || '↔' || j, corr_, i || '↔' || j || printf(' correlation %.2f (>0.75).', corr_) FROM l_mat WHERE i < j AND corr_ > 0.75
UNION ALL SELECT portfolio_id, 'RISK_HOG', CASE WHEN rvw > 2 THEN 'HIGH' ELSE 'MEDIUM' END, instrument, rvw, instrument || ' contributes ' || printf('%.1f%%', rcp * 100) || ' of risk on a ' || printf('%.1f%%', weight * 100) || printf(' weight (×%.2f).', rvw) FROM l_risk WHERE rvw > 1.5
UNION ALL SELECT portfolio_id, 'SECTOR_CONC', 'HIGH', sector, p, sector || ' sector is ' || printf('%.1f%%', p * 100) || ' (>50%).' FROM (SELECT portfolio_id, sector, sum(weight) AS p FROM weighted JOIN wsectors USING (instrument) GROUP BY 1, 2) JOIN common_len USING (portfolio_id) WHERE p > 0.5)""",
)
def _(spark, sf):
    late = F.col("instrument").isin("Brand#7", "Brand#13") & (F.col("date") < F.lit(LATE).cast("date"))
    ret = returns(spark, sf).filter(~late)
    book = weighted(spark, sf)
    df = pf.warnings(book, pf.aligned_panel(book, ret), ret, sectors(spark, sf))
    return df.select("portfolio_id", "type", "severity", "subject", rnd("value", 6), "message")


@register("PF15_correlated_pairs", f"SELECT portfolio_id, i, j, {r('cov', 6)}, {r('corr_', 6, 'corr')} FROM mat WHERE i < j AND corr_ > 0.1")
def _(spark, sf):
    """The warnings' threshold join at 0.1: the brands of the tables move almost apart, none of their pairs reaches 0.75."""
    df = pf.correlated_pairs(settle(pf.held_series(aligned(spark, sf))), 0.1)
    return df.select("portfolio_id", "i", "j", rnd("cov", 6), rnd("corr", 6))


# Quotes one percent above the last close, some stale; every other portfolio knows its share counts.
cte("last_closes", "SELECT instrument, max_by(close, date) AS close FROM wbars GROUP BY 1")
cte("brand_quotes", "SELECT instrument, close * 1.01::DOUBLE AS last_price, CAST(regexp_extract(instrument, '(\\d+)', 1) AS INT) % 4 = 0 AS stale FROM last_closes")
cte(
    "marked",
    """SELECT *, CASE WHEN NOT stale AND q > 0 THEN q * last_price WHEN NOT stale AND close > 0 THEN amount / close * last_price ELSE amount END AS live, NOT stale AS fresh
FROM (SELECT h.*, CASE WHEN CAST(portfolio_id AS BIGINT) % 2 = 0 THEN quantity END AS q, CASE WHEN CAST(portfolio_id AS BIGINT) % 3 = 0 THEN amount * 0.9::DOUBLE END AS invested, c.close, last_price, stale FROM holdings h JOIN last_closes c USING (instrument) JOIN brand_quotes USING (instrument))""",
)


def marked(spark, sf):
    k = F.col("portfolio_id").cast("bigint")
    held = panels.holdings(spark, sf).withColumns(
        {"quantity": F.when(k % 2 == 0, F.col("quantity")), "invested": F.when(k % 3 == 0, F.col("amount") * 0.9)}
    )
    closes = panels.weekly_bars(spark, sf).groupBy("instrument").agg(F.max_by("close", "date").alias("close"))
    number = F.regexp_extract("instrument", r"(\d+)", 1).cast("int")
    quotes = closes.select("instrument", (F.col("close") * 1.01).alias("last_price"), (number % 4 == 0).alias("stale"))
    return pf.mark_to_market(held, quotes, closes)


@register("PF16_mark_to_market", f"SELECT portfolio_id, instrument, {r('live', 6, 'live_value')}, fresh FROM marked")
def _(spark, sf):
    return marked(spark, sf).select("portfolio_id", "instrument", rnd("live_value", 6), "fresh")


@register(
    "PF17_profit_and_loss",
    f"""SELECT portfolio_id, {r('base', 6, 'baseline')}, {r('CASE WHEN f THEN live END', 6, 'live_value')}, {r('CASE WHEN f THEN live - base ELSE 0 END', 6, 'delta')}, {r('CASE WHEN f THEN (live - base) / base ELSE 0 END', 6, 'delta_pct')}
FROM (SELECT portfolio_id, sum(live) AS live, sum(coalesce(invested, amount)) AS base, bool_or(fresh) AS f FROM marked GROUP BY 1)""",
)
def _(spark, sf):
    df = pf.live_value(marked(spark, sf))
    return df.select("portfolio_id", rnd("baseline", 6), rnd("live_value", 6), rnd("delta", 6), rnd("delta_pct", 6))
