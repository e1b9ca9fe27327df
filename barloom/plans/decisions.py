"""Registered queries: regimes and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch, settle
from ..operators import regime as rg
from ..operators import regime_models as rm
from ..operators import signals as sg
from ..operators.indicators import indicators
from ..operators.returns import prepare
from ..sources import panels
from ..sources.bars import cluster_bars
from . import decision_sql  # noqa: F401
from . import regime_sql as rs
from .common import big, r, rnd, sql
from .decision_sql import NAME, USABLE
from .prices import features

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ("instrument", "date")


def register(name, oracle=None):
    def keep(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return run

    return keep


def ruled(spark, sf):
    return rg.rule_regime(features(spark, sf))


def signalled(spark, sf):
    return sg.signals(ruled(spark, sf))


def given_states(spark, sf):
    """Rows with states and posteriors that are plain functions of RSI."""
    rsi = F.col("RSI_14")
    rows = rg.usable(features(spark, sf), rg.KMEANS_FEATURES)
    return rows.select(
        *KEY,
        "close",
        "Return_5d",
        F.when(rsi < 45, 2).when(rsi < 55, 0).otherwise(1).alias("state"),
        (rsi / 200).alias("p0"),
        (0.5 - rsi / 400).alias("p1"),
        (0.5 - rsi / 400).alias("p2"),
    )


# ---- regimes ----


@register("REG1_trend_rule", "SELECT instrument, date, CAST(trend AS BIGINT) AS regime FROM rule0")
def _(spark, sf):
    return features(spark, sf).select(*KEY, rg.trend_rule().cast("bigint").alias("regime"))


@register("REG2_squeeze_override", "SELECT instrument, date, CAST(Regime AS BIGINT) AS Regime, Regime_Label FROM reg")
def _(spark, sf):
    return ruled(spark, sf).select(*KEY, big("Regime"), "Regime_Label")


@register(
    "REG3_standardised_features",
    "SELECT instrument, date, "
    + ", ".join(
        r(f"({c} - avg({c}) OVER (PARTITION BY instrument)) / stddev_pop({c}) OVER (PARTITION BY instrument)", 6, f"z_{c}")
        for c in rg.KMEANS_FEATURES
    )
    + f" FROM feat WHERE {USABLE}",
)
def _(spark, sf):
    rows = rg.usable(features(spark, sf), rg.KMEANS_FEATURES)
    return rg.standardise(rows, rg.KMEANS_FEATURES).select(*KEY, *[rnd(f"z_{c}", 6) for c in rg.KMEANS_FEATURES])


rs.kmeans_ctes("k_", "feat")
rs.kmeans_ctes("kt_", "feat", "date < DATE '1999-06-01'")
rs.hmm_ctes("h_", "feat")
rs.hmm_ctes("ht_", "feat", "date < DATE '1999-06-01'")
rs.hmm_ctes("dh_", "d_feat")
rs.hmm_ctes("bh_", "b_feat")
rs.marked("m_", "feat", rg.HMM_FEATURES, 1)
rs.em_ctes("m_", 3)
GIVEN = {"start": rs.START, "trans": rs.TRANS, "mean": rs.MEAN, "cov": rs.COV}
_named = "SELECT instrument, date, CAST(Regime AS BIGINT) AS Regime, Regime_Label"


@register("REG4_kmeans_regime", f"{_named} FROM k_kmeans")
def _(spark, sf):
    return rg.kmeans_regime(features(spark, sf)).select(*KEY, big("Regime"), "Regime_Label")


@register("REG5_cluster_order", "SELECT instrument, date, CAST(Regime AS BIGINT) AS Regime FROM ordered")
def _(spark, sf):
    return rg.order_states(given_states(spark, sf)).select(*KEY, big("Regime"))


@register("REG6_label_smoothing", "SELECT instrument, date, CAST(Regime AS BIGINT) AS Regime FROM smoothed")
def _(spark, sf):
    return rg.smooth_labels(rg.order_states(given_states(spark, sf))).select(*KEY, big("Regime"))


@register(
    "REG7_label_spread",
    """SELECT instrument, date, CAST(coalesce(last_value(s.Regime IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING), 1) AS BIGINT) AS Regime
FROM feat LEFT JOIN smoothed s USING (instrument, date)""",
)
def _(spark, sf):
    labels = rg.smooth_labels(rg.order_states(given_states(spark, sf))).select(*KEY, "Regime")
    bars = panels.daily_bars(spark, sf).select(*KEY)
    return rg.spread_forward(bars.join(labels, list(KEY), "left")).select(*KEY, big("Regime"))


@register("REG8_hmm_fit")
def _(spark, sf):
    rows = rg.usable(features(spark, sf), rg.HMM_FEATURES)
    return rm.fit_hmm(rows, rg.HMM_FEATURES).select(
        "instrument", big("state"), rnd("start", 6), "trans", "mean", "cov", rnd("log_likelihood", 4), big("steps")
    )


@register(
    "REG8_three_em_steps",
    f"""SELECT instrument, CAST(k AS BIGINT) AS state, {r('s[k + 1]', 6, 'start')}, {', '.join(r(f't[3 * k + {j + 1}]', 6, f'to_{j}') for j in range(3))}, {', '.join(r(f'u[{j + 1}]', 6, f'mean_{j}') for j in range(3))},
{', '.join(r(f'v[{j + 1}]', 6, f'cov_{j}') for j in range(9))}, {r('like_', 4, 'log_likelihood')}, CAST(steps AS BIGINT) AS steps
FROM ({' UNION ALL '.join(f'SELECT instrument, {k} AS k, s, t, u{k} AS u, v{k} AS v, like_, steps FROM m_fit3' for k in range(3))})""",
)
def _(spark, sf):
    rows = rg.usable(features(spark, sf), rg.HMM_FEATURES)
    flat = lambda name, n: [rnd(F.col(name)[j], 6, f"{label}_{j}") for j in range(n) for label in ({"trans": "to"}.get(name, name),)]
    return rm.fit_hmm(rows, rg.HMM_FEATURES, steps=3).select(
        "instrument", big("state"), rnd("start", 6), *flat("trans", 3), *flat("mean", 3), *flat("cov", 9), rnd("log_likelihood", 4), big("steps")
    )


@register("REG9_given_model_decode", f"SELECT instrument, date, CAST(state AS BIGINT) AS state, {r('p0', 6)}, {r('p1', 6)}, {r('p2', 6)} FROM h_dec")
def _(spark, sf):
    _, decoded = rg.decode_hmm(features(spark, sf), parameters=GIVEN)
    return decoded.filter("_use").select(*KEY, big("state"), *[rnd(f"p{k}", 6) for k in range(3)])


@register("REG9_hmm_decode")
def _(spark, sf):
    _, decoded = rg.decode_hmm(features(spark, sf))
    return decoded.filter("_use").select(*KEY, big("state"), *[rnd(f"p{k}", 6) for k in range(3)])


@register(
    "REG10_state_order",
    f"SELECT instrument, date, CAST(Regime AS BIGINT) AS Regime, {r('Regime_Prob_Bear', 6)}, {r('Regime_Prob_Bull', 6)} FROM ordered",
)
def _(spark, sf):
    rows = rg.order_posteriors(rg.order_states(given_states(spark, sf)))
    return rows.select(*KEY, big("Regime"), rnd("Regime_Prob_Bear", 6), rnd("Regime_Prob_Bull", 6))


_both = lambda c: (
    f"coalesce(last_value(o.{c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING), "
    f"first_value(o.{c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
)


@register(
    "REG11_fill_both_ways",
    f"SELECT instrument, date, CAST({_both('Regime')} AS BIGINT) AS Regime, {r(_both('Regime_Prob_Bear'), 6, 'Regime_Prob_Bear')}, "
    f"{r(_both('Regime_Prob_Bull'), 6, 'Regime_Prob_Bull')} FROM feat LEFT JOIN ordered o USING (instrument, date)",
)
def _(spark, sf):
    labels = rg.order_posteriors(rg.order_states(given_states(spark, sf)))
    labels = labels.select(*KEY, "Regime", "Regime_Prob_Bear", "Regime_Prob_Bull")
    bars = panels.daily_bars(spark, sf).select(*KEY)
    full = rg.spread_both(bars.join(labels, list(KEY), "left"))
    return full.select(*KEY, big("Regime"), rnd("Regime_Prob_Bear", 6), rnd("Regime_Prob_Bull", 6))


@register(
    "REG12_transition_matrix",
    f"""SELECT instrument, {NAME.format('a')} AS from_regime, {NAME.format('b')} AS to_regime, count(*) AS n,
{r('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY instrument, a)', 8, 'probability')}
FROM (SELECT instrument, lag(Regime) OVER (PARTITION BY instrument ORDER BY date) AS a, Regime AS b FROM reg) WHERE a IS NOT NULL GROUP BY instrument, a, b""",
)
def _(spark, sf):
    return rg.transitions(ruled(spark, sf)).withColumn("probability", rnd("probability", 8))


@register("REG12_fitted_transition_matrix")
def _(spark, sf):
    model, decoded = rg.decode_hmm(features(spark, sf))
    return rg.model_transitions(model, decoded).withColumn("probability", rnd("probability", 6))


_ranks = "SELECT DISTINCT instrument, r0, r1, r2 FROM h_ord"
_cells = " UNION ALL ".join(
    f"SELECT instrument, r{a} AS a, r{b} AS b, {rs.TRANS[3 * a + b] / sum(rs.TRANS[3 * a : 3 * a + 3])!r}::DOUBLE AS p FROM ({_ranks})" for a in range(3) for b in range(3)
)


@register("REG12_given_transition_matrix", f"SELECT instrument, {NAME.format('a')} AS from_regime, {NAME.format('b')} AS to_regime, {r('p', 6, 'probability')} FROM ({_cells})")
def _(spark, sf):
    model, decoded = rg.decode_hmm(features(spark, sf), parameters=GIVEN)
    return rg.model_transitions(model, decoded).withColumn("probability", rnd("probability", 6))


@register("REG13_given_model_train_label_all", f"{_named}, {r('Regime_Prob_Bear', 6)}, {r('Regime_Prob_Bull', 6)} FROM ht_hmm")
def _(spark, sf):
    df = features(spark, sf).withColumn("is_train", F.col("date") < F.lit("1999-06-01").cast("date"))
    out = rg.hmm_regime(df, train=F.col("is_train"), parameters=GIVEN)
    return out.select(*KEY, big("Regime"), "Regime_Label", rnd("Regime_Prob_Bear", 6), rnd("Regime_Prob_Bull", 6))


@register("REG14_given_model_short_history", "SELECT instrument, date, CAST(Regime AS BIGINT) AS Regime, Regime_Prob_Bull IS NOT NULL AS fitted FROM dh_hmm")
def _(spark, sf):
    out = rg.hmm_regime(indicators(prepare(panels.defective_bars(spark, sf))), parameters=GIVEN)
    return out.select(*KEY, big("Regime"), F.col("Regime_Prob_Bull").isNotNull().alias("fitted"))


@register("REG15_given_model_benchmark", "SELECT instrument, max(date) AS as_of, max_by(Regime_Label, date) AS Regime_Label FROM bh_hmm WHERE Regime_Label IS NOT NULL GROUP BY instrument")
def _(spark, sf):
    return rg.latest_label(rg.hmm_regime(indicators(prepare(panels.benchmark_bars(spark, sf))), parameters=GIVEN))


@register("REG13_fit_train_label_all")
def _(spark, sf):
    df = features(spark, sf).withColumn("is_train", F.col("date") < F.lit("1999-06-01").cast("date"))
    out = rg.hmm_regime(df, train=F.col("is_train"))
    return out.select(*KEY, big("Regime"), "Regime_Label", rnd("Regime_Prob_Bear", 6), rnd("Regime_Prob_Bull", 6))


@register("REG13_kmeans_fit_train_label_all", f"{_named} FROM kt_kmeans")
def _(spark, sf):
    df = features(spark, sf).withColumn("is_train", F.col("date") < F.lit("1999-06-01").cast("date"))
    return rg.kmeans_regime(df, train=F.col("is_train")).select(*KEY, big("Regime"), "Regime_Label")


@register("REG14_short_history_fallback")
def _(spark, sf):
    # Planted short series (90 bars) have no fitted states and show the rule instead.
    df = indicators(prepare(panels.defective_bars(spark, sf)))
    out = rg.hmm_regime(df)
    return out.select(*KEY, big("Regime"), F.col("Regime_Prob_Bull").isNotNull().alias("fitted"))


def _paths(name: str, method: str, columns, least: int) -> None:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)

    @register(
        name,
        f"SELECT instrument, usable_rows, CASE WHEN usable_rows >= {least} THEN '{method}' ELSE 'rule' END AS path "
        f"FROM (SELECT instrument, count(*) FILTER ({complete}) AS usable_rows FROM d_feat GROUP BY instrument)",
    )
    def _(spark, sf):
        return rg.fitted_or_rule(indicators(prepare(panels.defective_bars(spark, sf))), method)


_paths("REG14_hmm_path", "hmm", rg.HMM_FEATURES, rg.HMM_LEAST)
_paths("REG14_kmeans_path", "kmeans", rg.KMEANS_FEATURES, rg.KMEANS_LEAST)


@register("REG15_benchmark_regime")
def _(spark, sf):
    bench = indicators(prepare(panels.benchmark_bars(spark, sf)))
    return rg.latest_label(rg.hmm_regime(bench))


@register("REG_hmm_regime")
def _(spark, sf):
    out = rg.hmm_regime(features(spark, sf))
    return out.select(*KEY, big("Regime"), "Regime_Label", rnd("Regime_Prob_Bear", 6), rnd("Regime_Prob_Bull", 6))


# ---- signals ----


def _scores(name: str, column: str) -> None:
    @register(name, f"SELECT instrument, date, {r(column, 6)} FROM sig")
    def _(spark, sf):
        return sg.composite(sg.votes(ruled(spark, sf))).select(*KEY, rnd(column, 6))


_scores("SIG1_trend_vote", "Score_Trend")
_scores("SIG2_momentum_vote", "Score_Momentum")
_scores("SIG3_mean_reversion_vote", "Score_MeanRev")
_scores("SIG4_volume_vote", "Score_Volume")
_scores("SIG5_composite_score", "Score_Raw")


@register("SIG6_regime_gate", "SELECT instrument, date, Regime_Label, CAST(Signal AS BIGINT) AS Signal FROM sig")
def _(spark, sf):
    return signalled(spark, sf).select(*KEY, "Regime_Label", big("Signal"))


@register("SIG6_soft_gate", f"SELECT instrument, date, CAST(Signal AS BIGINT) AS Signal, {r('Size_Mult', 4)} FROM t_sig")
def _(spark, sf):
    df = sg.signals(ruled(spark, sf).withColumn("Regime_Prob_Bull", F.col("BB_Pct")))
    return df.select(*KEY, big("Signal"), rnd("Size_Mult", 4))


@register("SIG7_confidence_and_size", f"SELECT instrument, date, {r('Confidence', 6)}, {r('Size_Mult', 4)}, Signal_Strength FROM sig")
def _(spark, sf):
    return signalled(spark, sf).select(*KEY, rnd("Confidence", 6), rnd("Size_Mult", 4), "Signal_Strength")


_LEVELS = ("Entry_Price", "Stop_Loss", "Target_1", "Target_2")


@register(
    "SIG8_trade_levels",
    f"SELECT instrument, date, {', '.join(r(c, 5) for c in _LEVELS)}, {r('Risk_Reward', 5)} FROM sig",
)
def _(spark, sf):
    return signalled(spark, sf).select(*KEY, *[rnd(c, 5) for c in (*_LEVELS, "Risk_Reward")])


decision_sql.cte("newest_sig", "SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY date DESC) = 1")


@register(
    "SIG9_latest_buys",
    f"SELECT instrument, date, {r('close', 5)}, {r('Confidence', 6)}, Signal_Strength, Regime_Label, {r('Stop_Loss', 5)}, {r('Target_1', 5)}, {r('Target_2', 5)}, {r('Risk_Reward', 5)} "
    "FROM (SELECT * FROM newest_sig WHERE Signal = 1 ORDER BY Confidence DESC, instrument LIMIT 10)",
)
def _(spark, sf):
    return sg.buy_list(signalled(spark, sf)).select(
        *KEY,
        rnd("close", 5),
        rnd("Confidence", 6),
        "Signal_Strength",
        "Regime_Label",
        *[rnd(c, 5) for c in ("Stop_Loss", "Target_1", "Target_2", "Risk_Reward")],
    )


@register(
    "SIG9_latest_signals",
    f"SELECT instrument, date, CAST(Signal AS BIGINT) AS Signal, {r('Confidence', 6)}, Signal_Strength, Regime_Label FROM newest_sig",
)
def latest_signals(spark, sf):
    return sg.latest(signalled(spark, sf)).select(
        *KEY, big("Signal"), rnd("Confidence", 6), "Signal_Strength", "Regime_Label"
    )


@register(
    "SRC1_bucketed_latest_signals",
    f"SELECT instrument, date, CAST(Signal AS BIGINT) AS Signal, {r('Confidence', 6)}, Signal_Strength, Regime_Label FROM newest_sig",
)
def bucketed_latest_signals(spark, sf):
    """From bars written in buckets by instrument: indicators, regimes and signals need no exchange."""
    bars = cluster_bars(panels.daily_bars(spark, sf), scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    signals = sg.signals(rg.rule_regime(indicators(prepare(bars))))
    return sg.latest(signals).select(*KEY, big("Signal"), rnd("Confidence", 6), "Signal_Strength", "Regime_Label")


_carry = lambda c: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
decision_sql.cte("recent_days", "SELECT DISTINCT date FROM sig ORDER BY date DESC LIMIT 30")


@register(
    "SIG10_signal_grid",
    f"""SELECT instrument, date, CAST({_carry('Signal')} AS BIGINT) AS Signal, {r(_carry('Confidence'), 6, 'Confidence')}, coalesce({_carry('Signal_Strength')}, '—') AS Signal_Strength
FROM (SELECT DISTINCT instrument FROM sig WHERE date IN (SELECT date FROM recent_days)) CROSS JOIN recent_days LEFT JOIN (SELECT instrument, date, Signal, Confidence, Signal_Strength FROM sig) USING (instrument, date)""",
)
def _(spark, sf):
    signals = settle(signalled(spark, sf).select(*KEY, "Signal", "Confidence", "Signal_Strength"))
    return sg.signal_grid(signals).select(*KEY, big("Signal"), rnd("Confidence", 6), "Signal_Strength")


_age = "row_number() OVER (PARTITION BY instrument ORDER BY date DESC)"


@register(
    "SIG11_view_slices",
    "SELECT instrument, date, list_aggregate(list_filter(["
    + ", ".join(f"CASE WHEN age <= {n} THEN '{v}' END" for v, n in sg.VIEWS.items())
    + ", CASE WHEN year(date) = year(newest) THEN 'YTD' END, 'MAX'], lambda x: x IS NOT NULL), 'string_agg', ' ') AS views "
    + f"FROM (SELECT instrument, date, {_age} AS age, max(date) OVER (PARTITION BY instrument) AS newest FROM bars)",
)
def _(spark, sf):
    df = sg.view_slices(panels.daily_bars(spark, sf).select(*KEY))
    return df.select(*KEY, F.array_join("views", " ").alias("views"))
