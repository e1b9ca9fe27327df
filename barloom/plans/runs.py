"""Registered queries: equity curves, significance and factors. Runs are suppliers with the close as equity."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import functions as F

from ..functions.numeric import TAIL_DENOMINATOR, TAIL_NUMERATOR, expected_max_factor
from ..operators import factors as fac
from ..operators import performance as perf
from ..operators import significance as sigf
from ..settings import DEFAULTS
from ..sources import panels
from . import price_sql  # noqa: F401
from .common import big, cte, pick_sql, r, rnd, sql
from .ideas import LOG_DIGITS, trades
from .price_sql import LINE, bars_sql

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


def equity(spark, sf):
    return panels.daily_bars(spark, sf).select(
        F.col("instrument").alias("run_id"), "date", F.col("close").alias("equity")
    )


def returns(spark, sf):
    return perf.with_returns(equity(spark, sf))


def market(spark, sf):
    return panels.benchmark_bars(spark, sf)


P = "PARTITION BY run_id ORDER BY date"
cte(
    "eq",
    f"""SELECT *, CASE WHEN equity / peak - 1 = 0 THEN 0 ELSE equity / peak - 1 END AS dd FROM (SELECT *, coalesce(equity / lag(equity) OVER ({P}) - 1, 0) AS ret, max(equity) OVER ({P} ROWS UNBOUNDED PRECEDING) AS peak
FROM (SELECT instrument AS run_id, date, close AS equity FROM bars))""",
)


def metric_sql(source: str, by: str = "run_id") -> str:
    return f"""SELECT *, final / initial - 1 AS total_return, pow(final / initial, 1 / years) - 1 AS cagr,
CASE WHEN max_drawdown < 0 THEN (pow(final / initial, 1 / years) - 1) / abs(max_drawdown) ELSE 0 END AS calmar
FROM (SELECT *, greatest(date_diff('day', a, b) / 365.25::DOUBLE, 1e-9) AS years FROM (
 SELECT {by}, count(*) AS n, min(date) AS a, max(date) AS b, min_by(equity, date) AS initial, max_by(equity, date) AS final,
 stddev_samp(ret) * {YEAR!r} AS ann_vol, coalesce((avg(ret) - {RF!r}) / nullif(stddev_samp(ret), 0) * {YEAR!r}, 0) AS sharpe,
 coalesce(CASE WHEN count(*) FILTER (ret < 0) > 1 THEN (avg(ret) - {RF!r}) / nullif(stddev_samp(ret) FILTER (ret < 0), 0) * {YEAR!r} END, 0) AS sortino,
 min(dd) AS max_drawdown, min(struct_pack(dd := dd, date := date)).date AS max_drawdown_date FROM {source} GROUP BY {by} HAVING count(*) >= 2))"""


cte("metrics", metric_sql("eq"))

RATIO = {"total_return": 6, "cagr": 6, "ann_vol": 6, "sharpe": 6, "sortino": 6, "max_drawdown": 6, "calmar": 6}


@register("PERF1_daily_returns", f"SELECT run_id, date, {r('ret', 8)} FROM eq")
def _(spark, sf):
    return returns(spark, sf).select("run_id", "date", rnd("ret", 8))


def _metrics(name, **digits):
    @register(name, "SELECT run_id, " + ", ".join(r(c, n) for c, n in digits.items()) + " FROM metrics")
    def _(spark, sf):
        return perf.metrics(equity(spark, sf)).select("run_id", *[rnd(c, n) for c, n in digits.items()])


_metrics("PERF2_growth", total_return=6, years=6, cagr=6)
_metrics("PERF3_volatility", ann_vol=6)
_metrics("PERF4_sharpe", sharpe=6)
_metrics("PERF5_sortino", sortino=6)


@register("PERF6_drawdown_series", f"SELECT run_id, date, {r('dd', 8, 'drawdown')} FROM eq")
def _(spark, sf):
    return perf.with_drawdown(equity(spark, sf)).select("run_id", "date", rnd("drawdown", 8))


@register("PERF7_max_drawdown", f"SELECT run_id, {r('max_drawdown', 8)}, max_drawdown_date, {r('calmar', 6)} FROM metrics")
def _(spark, sf):
    return perf.metrics(equity(spark, sf)).select("run_id", rnd("max_drawdown", 8), "max_drawdown_date", rnd("calmar", 6))


_f126 = f"({P} ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"


@register(
    "PERF8_rolling_sharpe",
    f"SELECT run_id, date, {r('rolling_sharpe', 6)} FROM (SELECT run_id, date, CASE WHEN count(ret) OVER {_f126} >= 126 THEN (avg(ret) OVER {_f126} - {RF!r}) / nullif(stddev_samp(ret) OVER {_f126}, 0) * {YEAR!r} END AS rolling_sharpe FROM eq)",
)
def _(spark, sf):
    return perf.rolling_sharpe(returns(spark, sf)).select("run_id", "date", rnd("rolling_sharpe", 6))


cte(
    "aligned",
    f"""SELECT *, coalesce(bench / lag(bench) OVER ({P}) - 1, 0) AS bench_ret FROM (
SELECT e.*, last_value(b.close IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY e.date ROWS UNBOUNDED PRECEDING) AS bench FROM eq e LEFT JOIN (SELECT date, close FROM bench) b ON e.date = b.date)""",
)
cte(
    "versus",
    f"""SELECT run_id, CASE WHEN n > 30 THEN alpha END AS alpha, CASE WHEN n > 30 THEN beta END AS beta, CASE WHEN n > 30 THEN r2 END AS r_squared, CASE WHEN n > 30 THEN total - bench_total END AS outperformance
FROM (SELECT run_id, count(*) AS n, regr_slope(ret - {RF!r}, bench_ret - {RF!r}) AS beta, regr_intercept(ret - {RF!r}, bench_ret - {RF!r}) * 252 AS alpha, regr_r2(ret - {RF!r}, bench_ret - {RF!r}) AS r2,
 max_by(equity, date) / min_by(equity, date) - 1 AS total, product(1 + bench_ret) - 1 AS bench_total FROM aligned GROUP BY run_id)""",
)


def aligned(spark, sf):
    return perf.with_returns(perf.align_benchmark(equity(spark, sf), market(spark, sf)))


@register("PERF9_alpha_beta", f"SELECT run_id, {r('alpha', 6)}, {r('beta', 6)}, {r('r_squared', 6)} FROM versus")
def _(spark, sf):
    return perf.versus_benchmark(aligned(spark, sf)).select("run_id", *[rnd(c, 6) for c in ("alpha", "beta", "r_squared")])


@register("PERF10_outperformance", f"SELECT run_id, {r('outperformance', 6)} FROM versus")
def _(spark, sf):
    return perf.versus_benchmark(aligned(spark, sf)).select("run_id", rnd("outperformance", 6))


@register("PERF11_aligned_benchmark", f"SELECT run_id, date, {r('bench', 5)}, {r('bench_ret', 8)} FROM aligned")
def _(spark, sf):
    return perf.align_benchmark(equity(spark, sf), market(spark, sf)).select("run_id", "date", rnd("bench", 5), rnd("bench_ret", 8))


_firsts = "(PARTITION BY run_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@register(
    "PERF12_growth_of_one",
    f"""SELECT run_id, date, {r('equity / f', 7, 'growth')}, {r('coalesce(bench, fb) / fb', 7, 'bench_growth')} FROM (
SELECT *, first_value(equity) OVER {_firsts} AS f, first_value(bench IGNORE NULLS) OVER {_firsts} AS fb FROM aligned)""",
)
def _(spark, sf):
    return perf.growth_of_one(aligned(spark, sf)).select("run_id", "date", rnd("growth", 7), rnd("bench_growth", 7))


@register(
    "PERF13_drawdown_episode",
    f"""SELECT run_id, min(date) FILTER (date <= trough AND equity = pk) AS peak, any_value(trough) AS trough, coalesce(min(date) FILTER (date >= trough AND equity >= pk), max(date)) AS recovery, {r('min(dd)', 8, 'max_drawdown')}
FROM (SELECT e.*, t.trough, max(CASE WHEN date <= t.trough THEN equity END) OVER (PARTITION BY run_id) AS pk FROM eq e JOIN (SELECT run_id, max_drawdown_date AS trough FROM metrics) t USING (run_id)) GROUP BY run_id""",
)
def _(spark, sf):
    return perf.drawdown_episode(equity(spark, sf)).withColumn("max_drawdown", rnd("max_drawdown", 8))


@register(
    "PERF14_monthly_grid",
    "SELECT run_id, CAST(year(month) AS BIGINT) AS year, "
    + ", ".join(r(f"max(CASE WHEN month(month) = {m} THEN coalesce(x, 0) * 100 END)", 6, f"m{m}") for m in range(1, 13))
    + """ FROM (SELECT run_id, CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT run_id, date_trunc('month', date) AS m FROM eq) GROUP BY run_id)
LEFT JOIN (SELECT run_id, CAST(date_trunc('month', date) AS DATE) AS month, product(1 + ret) - 1 AS x FROM eq GROUP BY 1, 2) USING (run_id, month) GROUP BY run_id, year""",
)
def _(spark, sf):
    grid = perf.monthly_grid(returns(spark, sf))
    return grid.select("run_id", big("year"), *[rnd(f"m{m}", 6) for m in range(1, 13)])


@register(
    "PERF15_return_histogram",
    f"""SELECT run_id, CAST(bin AS BIGINT) AS bin, count(*) AS n, {r('any_value(lo + bin * (hi - lo) / 60)', 6, 'low')}, {r('any_value(mu)', 6, 'mean')}, {r('any_value(sd)', 6, 'sigma')}
FROM (SELECT *, least(floor((x - lo) / (hi - lo) * 60), 59) AS bin FROM (SELECT run_id, ret * 100 AS x, min(ret * 100) OVER q AS lo, max(ret * 100) OVER q AS hi, avg(ret * 100) OVER q AS mu, stddev_samp(ret * 100) OVER q AS sd FROM eq WINDOW q AS (PARTITION BY run_id))) GROUP BY run_id, bin""",
)
def _(spark, sf):
    percent = returns(spark, sf).withColumn("x", F.col("ret") * 100)
    return perf.histogram(percent, "x").select("run_id", big("bin"), "n", *[rnd(c, 6) for c in ("low", "mean", "sigma")])


SPLIT = "1999-01-01"
cte(
    "eq_split",
    f"""SELECT *, equity / peak - 1 AS dd FROM (SELECT *, coalesce(equity / lag(equity) OVER (PARTITION BY run_id, later ORDER BY date) - 1, 0) AS ret, max(equity) OVER (PARTITION BY run_id, later ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak
FROM (SELECT instrument AS run_id, date, close AS equity, date >= DATE '{SPLIT}' AS later FROM bars))""",
)
cte("m_split", metric_sql("eq_split", "run_id, later"))
cte("m_long", "UNPIVOT (SELECT run_id, later, sharpe, cagr, max_drawdown, ann_vol FROM m_split) ON sharpe, cagr, max_drawdown, ann_vol INTO NAME metric VALUE v")


@register(
    "PERF16_in_vs_out_of_sample",
    f"""SELECT a.run_id, a.metric, {r('a.v', 6, 'in_sample')}, {r('b.v', 6, 'out_of_sample')}, {r('CASE WHEN a.v <> 0 THEN b.v - a.v END', 6, 'delta')}
FROM (FROM m_long WHERE NOT later) a JOIN (FROM m_long WHERE later) b ON a.run_id = b.run_id AND a.metric = b.metric""",
)
def _(spark, sf):
    cut = F.lit(SPLIT).cast("date")
    df = equity(spark, sf)
    both = perf.compare(perf.metrics(df.filter(F.col("date") < cut)), perf.metrics(df.filter(F.col("date") >= cut)))
    return both.select("run_id", "metric", *[rnd(c, 6) for c in ("in_sample", "out_of_sample", "delta")])


_SHEET = {"years": 6, "initial_capital": 5, "final_nav": 5, **RATIO, **LOG_DIGITS, "alpha": 6, "beta": 6, "r_squared": 6, "outperformance": 6}


@register(
    "PERF17_tear_sheet",
    """SELECT m.run_id, a AS start, b AS "end", max_drawdown_date, coalesce(n_trades, 0) AS n_trades, coalesce(n_wins, 0) AS n_wins, CAST(coalesce(max_consecutive_losses, 0) AS BIGINT) AS max_consecutive_losses, """
    + ", ".join(
        r({"initial_capital": "initial", "final_nav": "final"}.get(c, f"coalesce({c}, 0)" if c in LOG_DIGITS else c), n, c) for c, n in _SHEET.items()
    )
    + " FROM metrics m JOIN versus USING (run_id) LEFT JOIN log_stats USING (run_id) LEFT JOIN streaks USING (run_id)",
)
def _(spark, sf):
    sheet = perf.tear_sheet(equity(spark, sf), trades(spark, sf), market(spark, sf))
    return sheet.select(
        "run_id", "start", "end", "max_drawdown_date", *[big(c) for c in ("n_trades", "n_wins", "max_consecutive_losses")], *[rnd(c, n) for c, n in _SHEET.items()]
    )


# ---- significance ----

cte(
    "mom",
    f"""SELECT run_id, n, CASE WHEN n >= 2 THEN coalesce((mu - {RF!r}) / nullif(sd, 0) * {YEAR!r}, 0) ELSE 0 END AS sharpe,
m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2) AS skew, ((n + 1) * (m4 / (m2 * m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) AS ekurt
FROM (SELECT run_id, count(*)::DOUBLE AS n, any_value(mu) AS mu, stddev_samp(ret) AS sd, avg(pow(ret - mu, 2)) AS m2, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4
 FROM (SELECT *, avg(ret) OVER (PARTITION BY run_id) AS mu FROM eq) GROUP BY run_id)""",
)


def _poly(coefficients, x):
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {_poly(TAIL_NUMERATOR, a)}::DOUBLE / {_poly(TAIL_DENOMINATOR, a)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631"
    tail = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


_E_MAX = f"(sqrt(252 / (n - 1)) * {expected_max_factor(10)!r})"
cte(
    "psr",
    f"""SELECT *, CASE WHEN var <= 0 THEN 0.5 ELSE {cdf_sql('z0')} END AS psr, CASE WHEN var <= 0 THEN 0.5 ELSE {cdf_sql('z1')} END AS dsr FROM (
SELECT *, s / sqrt(greatest(var, 1e-300)) AS z0, (s - e_max / {YEAR!r}) / sqrt(greatest(var, 1e-300)) AS z1 FROM (
SELECT *, (1 - skew * s + ekurt / 4 * s * s) / (n - 1) AS var FROM (SELECT *, sharpe / {YEAR!r} AS s, {_E_MAX} AS e_max FROM mom WHERE n >= 30)))""",
)


@register("STAT1_annualised_sharpe", f"SELECT run_id, {r('sharpe', 6)} FROM mom")
def _(spark, sf):
    return sigf.moments(returns(spark, sf), rf=RF).select("run_id", rnd("sharpe", 6))


cte(
    "powers",
    f"""--recursive
SELECT 0 AS place, 1::BIGINT AS power UNION ALL SELECT place + 1, power * {sigf.STEP} % {sigf.PRIME} FROM powers WHERE place < 4000""",
)
cte("placed", "SELECT run_id, ret, row_number() OVER (PARTITION BY run_id ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY run_id) AS n FROM eq WHERE ret IS NOT NULL")
cte(
    "states",
    f"""SELECT run_id, n, sample, 1 + xor(m, m >> 15) * {sigf.SPREAD_RUN} % {sigf.PRIME - 1} AS state FROM (
SELECT run_id, n, sample, (((number + 42) % {sigf.PRIME} + 1) * {sigf.SPREAD_RUN} % {sigf.PRIME} + sample + 1) * {sigf.SPREAD_SAMPLE} % {sigf.PRIME} AS m
FROM (SELECT run_id, any_value(n) AS n, ('0x' || left(md5(run_id), 7))::BIGINT AS number FROM placed WHERE n >= 30 GROUP BY run_id), range(5000) AS s(sample))""",
)
cte(
    "resampled",
    f"""SELECT run_id, sample, CASE WHEN v > {sigf.EQUAL_DRAWS!r} * q / n THEN (mean - {RF!r}) / sqrt(v) * {YEAR!r} ELSE 0 END AS sharpe FROM (
SELECT *, (q - n * mean * mean) / (n - 1) AS v FROM (SELECT s.run_id, sample, any_value(s.n) AS n, avg(ret) AS mean, sum(ret * ret) AS q
FROM states s JOIN powers p ON p.place < s.n JOIN placed r ON r.run_id = s.run_id AND r.place = (state * power % {sigf.PRIME}) * s.n >> 31 GROUP BY s.run_id, sample))""",
)
cte(
    "interval",
    "SELECT run_id, quantile_cont(sharpe, 0.025) AS ci_low, quantile_cont(sharpe, 0.975) AS ci_high, count(*) AS n_resamples FROM resampled GROUP BY run_id",
)


@register("STAT2_bootstrap_interval", f"SELECT run_id, {r('ci_low', 6)}, {r('ci_high', 6)}, n_resamples FROM interval")
def _(spark, sf):
    samples = sigf.bootstrap(returns(spark, sf), 5000, RF)
    return sigf.bootstrap_interval(samples).select("run_id", rnd("ci_low", 6), rnd("ci_high", 6), "n_resamples")


@register(
    "STAT3_bootstrap_histogram",
    f"""SELECT run_id, CAST(bin AS BIGINT) AS bin, count(*) AS n, {r('any_value(lo + bin * (hi - lo) / 50)', 6, 'low')} FROM (
SELECT *, least(coalesce(floor((sharpe - lo) / nullif(hi - lo, 0) * 50), 0), 49) AS bin FROM (
SELECT *, min(sharpe) OVER (PARTITION BY run_id) AS lo, max(sharpe) OVER (PARTITION BY run_id) AS hi FROM resampled)) GROUP BY run_id, bin""",
)
def _(spark, sf):
    samples = sigf.bootstrap(returns(spark, sf), 5000, RF)
    return sigf.bootstrap_histogram(samples).select("run_id", big("bin"), "n", rnd("low", 6))


@register("STAT4_skewness_kurtosis", f"SELECT run_id, {r('skew', 6)}, {r('ekurt', 6, 'excess_kurtosis')} FROM mom")
def _(spark, sf):
    return sigf.moments(returns(spark, sf)).select("run_id", rnd("skew", 6), rnd("excess_kurtosis", 6))


@register("STAT5_probabilistic_sharpe", f"SELECT run_id, {r('psr', 6)} FROM psr")
def _(spark, sf):
    return sigf.probabilistic_sharpe(returns(spark, sf), 0.0, RF).select("run_id", rnd("psr", 6))


@register("STAT6_expected_max_sharpe", f"SELECT run_id, {r('e_max', 6, 'expected_max_sharpe')} FROM psr")
def _(spark, sf):
    return sigf.deflated_sharpe(returns(spark, sf), 10, RF).select("run_id", rnd("expected_max_sharpe", 6))


@register("STAT7_deflated_sharpe", f"SELECT run_id, {r('dsr', 6)} FROM psr")
def _(spark, sf):
    return sigf.deflated_sharpe(returns(spark, sf), 10, RF).select("run_id", rnd("dsr", 6))


cte("bench_eq", "SELECT date, coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0) AS bret FROM bench")
cte("pairs", f"SELECT run_id, date, ret - {RF!r} AS y, bret - {RF!r} AS x FROM eq JOIN bench_eq USING (date)")


def bench_returns(spark, sf):
    series = market(spark, sf).select(F.col("instrument").alias("run_id"), "date", F.col("close").alias("equity"))
    return perf.with_returns(series).select("date", "ret")


@register("STAT8_date_alignment", f"SELECT run_id, date, {r(f'y + {RF!r}', 8, 'ret')}, {r(f'x + {RF!r}', 8, 'bench_ret')} FROM pairs")
def _(spark, sf):
    both = sigf.join_dates(returns(spark, sf).select("run_id", "date", "ret"), bench_returns(spark, sf).withColumnRenamed("ret", "bench_ret"))
    return both.select("run_id", "date", rnd("ret", 8), rnd("bench_ret", 8))


cte(
    "hac_fit",
    "SELECT run_id, count(*) AS n, greatest(floor(4 * pow(count(*) / 100, 2.0::DOUBLE / 9)), 1) AS L, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM pairs GROUP BY run_id HAVING count(*) >= 30",
)
cte(
    "hac_rows",
    "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY date) AS t, x, y - alpha - beta * x AS e, L FROM pairs JOIN hac_fit USING (run_id)",
)
cte(
    "hac_omega",
    """SELECT run_id, sum(o00) AS o00, sum(o01) AS o01, sum(o11) AS o11 FROM (
SELECT run_id, sum(e * e) AS o00, sum(x * e * e) AS o01, sum(x * x * e * e) AS o11 FROM hac_rows GROUP BY run_id
UNION ALL SELECT a.run_id, sum(w * 2 * a.e * b.e), sum(w * (a.e * b.e * b.x + a.x * a.e * b.e)), sum(w * 2 * a.x * a.e * b.x * b.e)
 FROM (SELECT *, unnest(range(1, CAST(L AS INT) + 1)) AS lag_, 1 - lag_ / (L + 1) AS w FROM hac_rows) a JOIN hac_rows b ON a.run_id = b.run_id AND b.t = a.t - a.lag_ GROUP BY a.run_id) GROUP BY run_id""",
)
cte(
    "hac",
    f"""SELECT *, CASE WHEN se > 0 THEN alpha / se ELSE 0 END AS t_stat FROM (SELECT run_id, n, L, alpha, beta, sqrt(sxx / d * (sxx / d * o00 - sx / d * o01) - sx / d * (sxx / d * o01 - sx / d * o11)) AS se
FROM (SELECT *, n * sxx - sx * sx AS d FROM hac_fit JOIN hac_omega USING (run_id)))""",
)


@register(
    "STAT9_alpha_newey_west",
    f"""SELECT run_id, {r('alpha * 252', 6, 'alpha_annual')}, {r('beta', 6)}, {r('se', 8, 'se_alpha_daily')}, {r('t_stat', 5)}, {r('p', 5, 'p_value')}, n AS n_obs, CAST(L AS BIGINT) AS hac_lags, p < 0.05 AS significant_5pct, p < 0.01 AS significant_1pct
FROM (SELECT *, 2 * (1 - {cdf_sql('abs(t_stat)')}) AS p FROM hac)""",
)
def _(spark, sf):
    df = sigf.alpha_test(returns(spark, sf), bench_returns(spark, sf), RF)
    return df.select(
        "run_id", rnd("alpha_annual", 6), rnd("beta", 6), rnd("se_alpha_daily", 8), rnd("t_stat", 5), rnd("p_value", 5), "n_obs", big("hac_lags"), "significant_5pct", "significant_1pct"
    )


@register(
    "STAT10_full_report",
    f"""SELECT run_id, {pick_sql(sharpe=6, ci_low=6, ci_high=6, psr=6, dsr=6, expected_max_sharpe=6, alpha_annual=6, t_stat=6, p_value=6)},
CASE WHEN dsr >= 0.95 THEN 'strong' WHEN dsr >= 0.8 THEN 'borderline' ELSE 'weak' END AS dsr_verdict
FROM (SELECT run_id, sharpe, ci_low, ci_high, psr, dsr, e_max AS expected_max_sharpe FROM interval JOIN psr USING (run_id)) LEFT JOIN
(SELECT run_id, alpha * 252 AS alpha_annual, t_stat, 2 * (1 - {cdf_sql('abs(t_stat)')}) AS p_value FROM hac WHERE n > 30) USING (run_id)""",
)
def _(spark, sf):
    df = sigf.full_report(returns(spark, sf), bench_returns(spark, sf), rf=RF)
    return df.select("run_id", *[rnd(c, 6) for c in ("sharpe", "ci_low", "ci_high", "psr", "dsr", "expected_max_sharpe", "alpha_annual", "t_stat", "p_value")], "dsr_verdict")


@register(
    "STAT11_verdict",
    "SELECT run_id, CASE WHEN psr >= 0.95 THEN 'strong' WHEN psr >= 0.8 THEN 'borderline' ELSE 'weak' END AS psr_verdict, CASE WHEN dsr >= 0.95 THEN 'strong' WHEN dsr >= 0.8 THEN 'borderline' ELSE 'weak' END AS dsr_verdict FROM psr",
)
def _(spark, sf):
    ret = returns(spark, sf)
    psr = sigf.probabilistic_sharpe(ret, 0.0, RF).select("run_id", sigf.verdict(F.col("psr")).alias("psr_verdict"))
    dsr = sigf.deflated_sharpe(ret, 10, RF).select("run_id", sigf.verdict(F.col("dsr")).alias("dsr_verdict"))
    return psr.join(dsr, "run_id")


# ---- factors: bars of the market and of supplier groups, in two sets that differ in the groups ----

MEMBERS = {
    "first": {"Market": "TRUE", "Size": "l_suppkey % 2 = 0", "IT": "l_suppkey % 5 = 1", "Banking": "l_suppkey % 5 = 2"},
    "second": {"Market": "TRUE", "Size": "l_suppkey % 2 = 1", "IT": "l_suppkey % 5 = 3", "Banking": "l_suppkey % 5 = 4"},
}


def factor_prices(spark, sf):
    groups = [F.when(F.expr(c), f"{name}:{f}") for name, of in MEMBERS.items() for f, c in of.items()]
    lines = panels.table(spark, sf, "lineitem").select(
        F.explode(F.array_compact(F.array(*groups))).alias("instrument"), F.to_date("l_shipdate").alias("date"), *panels.LINE
    )
    bars = panels._bars(lines, 0.3)
    parts = F.split("instrument", ":")
    return bars.select(parts[0].alias("factor_set"), "date", parts[1].alias("factor"), "close")


_bars_of = " UNION ALL ".join(
    f"SELECT '{name}:{f}' AS instrument, CAST(l_shipdate AS DATE) AS date, {LINE} FROM lineitem WHERE {c}" for name, of in MEMBERS.items() for f, c in of.items()
)
cte("factor_bars", bars_sql(_bars_of, 0.3))
cte("factor_prices", "SELECT split_part(instrument, ':', 1) AS factor_set, split_part(instrument, ':', 2) AS factor, date, close FROM factor_bars")
_over = "OVER (PARTITION BY factor_set ORDER BY date"
_ff = lambda f: f"last_value({f} IGNORE NULLS) {_over} ROWS UNBOUNDED PRECEDING) AS {f}"


def raw_sql(factors) -> str:
    """Returns of the given factors on the days from which all of them have a price."""
    return (
        "SELECT * FROM (SELECT factor_set, date, "
        + ", ".join(f"{f} / lag({f}) {_over}) - 1 AS {f}" for f in factors)
        + " FROM (SELECT factor_set, date, "
        + ", ".join(_ff(f) for f in factors)
        + " FROM (SELECT factor_set, date, "
        + ", ".join(f"max(close) FILTER (factor = '{f}') AS {f}" for f in factors)
        + " FROM factor_prices GROUP BY factor_set, date)) WHERE "
        + " AND ".join(f"{f} IS NOT NULL" for f in factors)
        + ") WHERE Market IS NOT NULL"
    )


cte("factor_raw", raw_sql(fac.FACTORS))
cte("factor_rets", "SELECT factor_set, date, Market, Size - Market AS Size, IT, Banking FROM factor_raw")
_four = ", ".join(r(f, 8) for f in fac.FACTORS)


@register("FAC1_factor_returns", f"SELECT factor_set, date, {_four} FROM factor_raw")
def _(spark, sf):
    plain = dict.fromkeys(fac.FACTORS, "excess")
    return fac.factor_returns(factor_prices(spark, sf), plain).select("factor_set", "date", *[rnd(f, 8) for f in fac.FACTORS])


@register("FAC2_spread_factor", f"SELECT factor_set, date, {_four} FROM factor_rets")
def _(spark, sf):
    return fac.factor_returns(factor_prices(spark, sf)).select("factor_set", "date", *[rnd(f, 8) for f in fac.FACTORS])


@register("FAC3_missing_factors", "SELECT DISTINCT r_name AS factor FROM region WHERE r_name NOT IN (SELECT factor FROM factor_prices) UNION ALL SELECT DISTINCT 'Value'")
def _(spark, sf):
    asked = panels.table(spark, sf, "region").select(F.col("r_name").alias("factor"))
    asked = asked.unionByName(spark.createDataFrame([("Market",), ("Value",)], "factor string"))
    return fac.missing_factors(asked, factor_prices(spark, sf))


@register(
    "FAC4_excess_returns",
    f"SELECT factor_set, date, {r(f'Market - {RF!r}', 8, 'Market')}, {r('Size', 8)}, {r(f'IT - {RF!r}', 8, 'IT')}, {r(f'Banking - {RF!r}', 8, 'Banking')} FROM factor_rets",
)
def _(spark, sf):
    return fac.excess(fac.factor_returns(factor_prices(spark, sf))).select("factor_set", "date", *[rnd(f, 8) for f in fac.FACTORS])


TWO = {"Market": "excess", "Size": "smb"}
cte("factor_rets2", f"SELECT factor_set, date, Market, Size - Market AS Size FROM ({raw_sql(TWO)})")
cte(
    "ols2",
    f"""SELECT run_id, factor_set, n, (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) AS b1, (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2, syy,
sy1, sy2 FROM (SELECT run_id, factor_set, count(*) AS n, covar_pop(y, x1) * count(*) AS sy1, covar_pop(y, x2) * count(*) AS sy2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12, var_pop(y) * count(*) AS syy,
 avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM (SELECT run_id, factor_set, ret - {RF!r} AS y, Market - {RF!r} AS x1, Size AS x2 FROM eq JOIN factor_rets2 USING (date)) GROUP BY run_id, factor_set HAVING count(*) >= 50)""",
)


def result(spark, sf, factors=fac.FACTORS):
    rets = fac.factor_returns(factor_prices(spark, sf), factors)
    return fac.attribution(returns(spark, sf), rets, factors)


@register(
    "FAC5_two_factor_ols",
    f"SELECT run_id, factor_set, n AS n_obs, {r('(my - b1 * m1 - b2 * m2) * 252', 6, 'alpha_annual')}, {r('b1', 6, 'beta_market')}, {r('b2', 6, 'beta_size')}, {r('(b1 * sy1 + b2 * sy2) / syy', 6, 'r_squared')} FROM ols2",
)
def _(spark, sf):
    df = result(spark, sf, TWO)
    beta = F.col("loadings")
    return df.select(
        "run_id", "factor_set", "n_obs", rnd("alpha_annual", 6), rnd(beta[0]["beta"], 6, "beta_market"), rnd(beta[1]["beta"], 6, "beta_size"), rnd("r_squared", 6)
    )


# The four-factor regression in SQL: normal equations, their inverse by elimination, and the lagged products.
_K = range(5)
_X = ["1.0::DOUBLE", f"(Market - {RF!r})", "Size", f"(IT - {RF!r})", f"(Banking - {RF!r})"]
_NAMES = list(fac.FACTORS)
_KEY = "run_id, factor_set"
cte("fac_x", f"SELECT {_KEY}, date, ret - {RF!r} AS y, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(_X)) + " FROM eq JOIN factor_rets USING (date)")
cte(
    "fac_s0",
    f"SELECT {_KEY}, count(*) AS n, greatest(floor(4 * pow(count(*) / 100, 2.0::DOUBLE / 9)), 1) AS L, avg(y) AS my, "
    + ", ".join(f"sum(x{i} * x{j}) AS m{i}_{j}" for i in _K for j in _K)
    + ", "
    + ", ".join(f"{float(i == j)}::DOUBLE AS m{i}_{j + 5}" for i in _K for j in _K)
    + ", "
    + ", ".join(f"sum(x{i} * y) AS c{i}, avg(x{i}) AS a{i}" for i in _K)
    + f" FROM fac_x GROUP BY {_KEY} HAVING count(*) >= 50",
)
for _p in _K:
    _cells = [f"m{i}_{j} / m{i}_{i} AS m{i}_{j}" if i == _p else f"m{i}_{j} - m{i}_{_p} / m{_p}_{_p} * m{_p}_{j} AS m{i}_{j}" for i in _K for j in range(10)]
    cte(f"fac_s{_p + 1}", f"SELECT {_KEY}, n, L, my, " + ", ".join(_cells) + ", " + ", ".join(f"c{i}, a{i}" for i in _K) + f" FROM fac_s{_p}")
cte(
    "fac_coef",
    f"SELECT {_KEY}, n, L, my, " + ", ".join(f"a{i}, " + " + ".join(f"m{i}_{j + 5} * c{j}" for j in _K) + f" AS b{i}" for i in _K) + ", " + ", ".join(f"m{i}_{j + 5} AS v{i}_{j}" for i in _K for j in _K) + " FROM fac_s5",
)
cte(
    "fac_rows",
    f"SELECT {_KEY}, L, y, my, t, e, " + ", ".join(f"x{i} * e AS u{i}" for i in _K) + f" FROM (SELECT {_KEY}, L, y, my, row_number() OVER (PARTITION BY {_KEY} ORDER BY date) AS t, "
    + ", ".join(f"x{i}" for i in _K) + ", y - " + " - ".join(f"b{i} * x{i}" for i in _K) + f" AS e FROM fac_x JOIN fac_coef USING ({_KEY}))",
)
cte(
    "fac_omega",
    f"SELECT {_KEY}, " + ", ".join(f"sum(o{i}_{j}) AS o{i}_{j}" for i in _K for j in _K) + f" FROM (SELECT {_KEY}, " + ", ".join(f"sum(u{i} * u{j}) AS o{i}_{j}" for i in _K for j in _K)
    + f" FROM fac_rows GROUP BY {_KEY} UNION ALL SELECT a.run_id, a.factor_set, " + ", ".join(f"sum(w * (a.u{i} * b.u{j} + a.u{j} * b.u{i}))" for i in _K for j in _K)
    + f" FROM (SELECT *, unnest(range(1, CAST(L AS INT) + 1)) AS lag_, 1 - lag_ / (L + 1) AS w FROM fac_rows) a JOIN fac_rows b ON a.run_id = b.run_id AND a.factor_set = b.factor_set AND b.t = a.t - a.lag_ GROUP BY 1, 2) GROUP BY {_KEY}",
)
_se = lambda i: "sqrt(greatest(0, " + " + ".join(f"v{i}_{j} * o{j}_{k} * v{k}_{i}" for j in _K for k in _K) + "))"
cte("fac_fit", f"SELECT *, 1 - rss / tss AS r2, " + ", ".join(f"coalesce(b{i} / nullif(se{i}, 0), 0) AS t{i}" for i in _K) + f" FROM (SELECT *, " + ", ".join(f"{_se(i)} AS se{i}" for i in _K)
    + f" FROM fac_coef JOIN fac_omega USING ({_KEY}) JOIN (SELECT {_KEY}, sum(e * e) AS rss, sum((y - my) * (y - my)) AS tss, avg(e) AS me FROM fac_rows GROUP BY {_KEY}) USING ({_KEY}))")
cte(
    "fac_long",
    " UNION ALL ".join(
        f"SELECT {_KEY}, {i} AS place, '{f}' AS factor, b{i + 1} AS beta, se{i + 1} AS se, t{i + 1} AS t_stat, 2 * (1 - {cdf_sql(f'abs(t{i + 1})')}) AS p_value, b{i + 1} * a{i + 1} * 252 AS contribution FROM fac_fit"
        for i, f in enumerate(_NAMES)
    ),
)


@register("FAC6_newey_west_errors", f"SELECT {_KEY}, factor, {r('se', 6)} FROM fac_long")
def _(spark, sf):
    return fac.loadings(result(spark, sf)).select("run_id", "factor_set", "factor", rnd("se", 6))


@register(
    "FAC7_factor_regression",
    f"SELECT {_KEY}, n AS n_obs, CAST(L AS BIGINT) AS hac_lags, {r('b0 * 252', 6, 'alpha_annual')}, {r('t0', 6, 'alpha_t')}, {r('2 * (1 - ' + cdf_sql('abs(t0)') + ')', 6, 'alpha_p')}, {r('r2', 6, 'r_squared')}, {r('1 - (1 - r2) * (n - 1) / greatest(n - 5, 1)', 6, 'adj_r_squared')} FROM fac_fit",
)
def _(spark, sf):
    df = result(spark, sf)
    return df.select("run_id", "factor_set", "n_obs", big("hac_lags"), *[rnd(c, 6) for c in ("alpha_annual", "alpha_t", "alpha_p", "r_squared", "adj_r_squared")])


@register(
    "FAC8_attribution",
    f"SELECT {_KEY}, {r('my * 252', 6, 'strategy_mean_annual')}, {r('me * 252', 6, 'unexplained_annual')}, factor, {r('contribution', 6)} FROM fac_fit JOIN fac_long USING ({_KEY})",
)
def _(spark, sf):
    df = result(spark, sf)
    head = df.select("run_id", "factor_set", rnd("strategy_mean_annual", 6), rnd("unexplained_annual", 6), "loadings")
    rows = head.select("run_id", "factor_set", "strategy_mean_annual", "unexplained_annual", F.explode("loadings").alias("f"))
    return rows.select("run_id", "factor_set", "strategy_mean_annual", "unexplained_annual", F.col("f.factor").alias("factor"), rnd(F.col("f.contribution"), 6, "contribution"))


_mark = "CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' ELSE 'n.s.' END AS significance"


@register(
    "FAC9_coefficient_table",
    f"""SELECT {_KEY}, factor, loading, {r('t_stat', 4)}, {r('p_value', 5)}, {r('contribution', 6)}, {_mark} FROM (
SELECT {_KEY}, 'α (pure alpha)' AS factor, printf('%+.2f%% / yr', b0 * 252 * 100) AS loading, t0 AS t_stat, 2 * (1 - {cdf_sql('abs(t0)')}) AS p_value, b0 * 252 AS contribution FROM fac_fit
UNION ALL SELECT {_KEY}, factor, printf('%+.3f', beta), t_stat, p_value, contribution FROM fac_long)""",
)
def _(spark, sf):
    return fac.coefficient_table(result(spark, sf)).select("run_id", "factor_set", "factor", "loading", rnd("t_stat", 4), rnd("p_value", 5), rnd("contribution", 6), "significance")


@register(
    "FAC10_largest_contributor",
    f"SELECT {_KEY}, factor, {r('contribution', 6)} FROM fac_long QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY abs(contribution) DESC, place) = 1",
)
def _(spark, sf):
    return fac.largest_contributor(result(spark, sf)).select("run_id", "factor_set", "factor", rnd("contribution", 6))


@register(
    "FAC11_attribution_verdict",
    f"SELECT {_KEY}, CASE WHEN b0 > 0 AND 2 * (1 - {cdf_sql('abs(t0)')}) < 0.05 THEN 'significant' WHEN b0 > 0 THEN 'positive, not significant' ELSE 'not positive' END AS verdict, r2 > 0.85 AS factor_like FROM fac_fit",
)
def _(spark, sf):
    return fac.attribution_verdict(result(spark, sf))
