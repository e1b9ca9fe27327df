"""Market-regime labels per series: rules, and the relational part of the fitted models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, filled, series, trailing
from ..functions.lineage import settle
from ..settings import BEAR, BULL, SIDEWAYS
from . import regime_models as models

KMEANS_FEATURES = ("Return_5d", "Return_20d", "Volatility_20", "Dist_from_MA200_pct", "RSI_14", "BB_Width")
HMM_FEATURES = ("Return_5d", "Volatility_20", "BB_Width")
SMOOTHING = 5
HMM_LEAST, KMEANS_LEAST = 100, 60
SQUEEZE_BARS, SQUEEZE_LEAST, SQUEEZE_QUANTILE = 252, 60, 0.20


def label_name(code: Column) -> Column:
    return F.when(code == BEAR, "BEAR").when(code == SIDEWAYS, "SIDEWAYS").when(code == BULL, "BULL")


def trend_rule() -> Column:
    """Moving-average rule; an unknown average compares false and so reads BEAR."""
    above = F.col("close") > F.col("MA_200")
    return (
        F.when(above & (F.col("MA_50") > F.col("MA_200")), BULL).when(above, SIDEWAYS).otherwise(BEAR).cast("int")
    )


def with_widths(df: DataFrame, keys=KEYS) -> DataFrame:
    """Add `_width`, the rounded band width, and `_widths`, those of the last 252 rows that have one."""
    # Twelve decimals: two windows holding the same closes tie, whatever order they were summed in.
    df = df.withColumn("_width", F.round("BB_Width", 12))
    return df.withColumn("_widths", F.collect_list("_width").over(trailing(SQUEEZE_BARS, keys)))  # at most 252 values


def with_squeeze(df: DataFrame) -> DataFrame:
    """Replace `_width` and `_widths` by `squeezed`: width below the 20 % quantile of the widths (60 at least).

    The width is one of those values, so comparing it with two of them in order settles it: with the (interpolated)
    quantile at position p, width < quantile iff the value at floor(p) is larger, or is the width itself while the next
    one is larger and p lies between them.
    """
    df = df.withColumn("_widths", F.sort_array("_widths"))
    place = SQUEEZE_QUANTILE * (F.size("_widths") - 1)
    low = F.get("_widths", F.floor(place).cast("int"))
    high = F.get("_widths", F.floor(place).cast("int") + 1)
    under = (low > F.col("_width")) | ((low == F.col("_width")) & (high > F.col("_width")) & (place > F.floor(place)))
    enough = F.col("BB_Width").isNotNull() & (F.size("_widths") >= SQUEEZE_LEAST)
    return df.withColumn("squeezed", enough & under).drop("_width", "_widths")


def squeezed(df: DataFrame, keys=KEYS) -> DataFrame:
    """Add `squeezed`: band width below the 20 % quantile of its last 252 values (60 at least)."""
    return with_squeeze(with_widths(df, keys))


def by_rule(squeezed: DataFrame) -> DataFrame:
    """`Regime` and its label by rule, `squeezed` consumed."""
    df = squeezed.withColumn("Regime", F.when(F.col("squeezed"), SIDEWAYS).otherwise(trend_rule()).cast("int")).drop("squeezed")
    return df.withColumn("Regime_Label", label_name(F.col("Regime")))


def rule_regime(features: DataFrame, keys=KEYS) -> DataFrame:
    return by_rule(squeezed(features, keys))


def usable(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def standardise(rows: DataFrame, columns, keys=KEYS, train: Column | None = None) -> DataFrame:
    """z_<column> with population sigma per key (a zero sigma counts as 1), fitted on `train` rows."""
    w = Window.partitionBy(*keys)
    out = {}
    for c in columns:
        x = F.col(c) if train is None else F.when(train, F.col(c))
        sd = F.stddev_pop(x).over(w)
        out[f"z_{c}"] = (F.col(c) - F.avg(x).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    return rows.withColumns(out)


def order_states(rows: DataFrame, state="state", keys=KEYS, train: Column | None = None) -> DataFrame:
    """Add `Regime`: state codes 0..2 ranked by their mean Return_5d, lowest first; states without rows rank last."""
    w = Window.partitionBy(*keys)
    known = F.lit(True) if train is None else train
    df = rows.withColumns(
        {f"_m{s}": F.avg(F.when(known & (F.col(state) == s), F.col("Return_5d"))).over(w) for s in range(3)}
    )
    return order_by_means(df, state)


def order_by_means(df: DataFrame, state="state") -> DataFrame:
    """`order_states` where `_m0`..`_m2`, the mean returns of the states, are known; they are consumed."""
    mean = [F.coalesce(F.col(f"_m{s}"), F.lit(float("inf"))) for s in range(3)]

    def place(s: int) -> Column:
        below = F.lit(0)
        for u in range(3):
            if u != s:
                lower = (mean[u] < mean[s]) | ((mean[u] == mean[s]) & F.lit(u < s))
                below = below + lower.cast("int")
        return below

    df = df.withColumns({f"_r{s}": place(s) for s in range(3)})
    code = F.when(F.col(state) == 0, F.col("_r0")).when(F.col(state) == 1, F.col("_r1")).otherwise(F.col("_r2"))
    return df.withColumn("Regime", F.when(F.col(state).isNotNull(), code).cast("int")).drop("_m0", "_m1", "_m2")


def order_posteriors(df: DataFrame, prefix="p") -> DataFrame:
    """Regime_Prob_Bear / Regime_Prob_Bull out of p0..p2 and the state ranks left by `order_states`."""

    def of(code: int) -> Column:
        # Rows without a state have NULL posteriors and stay NULL.
        return (
            F.when(F.col("_r0") == code, F.col(f"{prefix}0"))
            .when(F.col("_r1") == code, F.col(f"{prefix}1"))
            .otherwise(F.col(f"{prefix}2"))
        )

    return df.withColumn("Regime_Prob_Bear", of(BEAR)).withColumn("Regime_Prob_Bull", of(BULL))


def smooth_labels(labels: DataFrame, window: int = SMOOTHING, keys=KEYS) -> DataFrame:
    """Rolling mode over the last rows; a tie goes to the smallest code."""
    frame = trailing(window, keys)
    df = labels.withColumns(
        {f"_n{k}": F.sum((F.col("Regime") == k).cast("int")).over(frame) for k in (BEAR, SIDEWAYS, BULL)}
    )
    n0, n1, n2 = F.col("_n0"), F.col("_n1"), F.col("_n2")
    mode = F.when((n0 >= n1) & (n0 >= n2), BEAR).when(n1 >= n2, SIDEWAYS).otherwise(BULL)
    return df.withColumn("Regime", mode.cast("int")).drop("_n0", "_n1", "_n2")


def spread_forward(df: DataFrame, keys=KEYS) -> DataFrame:
    """Carry labels to every later bar; bars before the first label read SIDEWAYS."""
    return df.withColumn("Regime", F.coalesce(filled("Regime", None, keys), F.lit(SIDEWAYS)).cast("int"))


def spread_both(df: DataFrame, columns=("Regime", "Regime_Prob_Bear", "Regime_Prob_Bull"), causal=False, keys=KEYS) -> DataFrame:
    """Carry values forward and then back over the warm-up bars (`causal` leaves those NULL)."""
    df = df.withColumns({c: filled(c, None, keys) for c in columns})
    if causal:
        return df
    # After the forward fill only leading rows are NULL, so the first value of the key fills them.
    whole = series(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(whole)) for c in columns})


def transitions(labelled: DataFrame, keys=KEYS) -> DataFrame:
    """Empirical transition matrix: (keys, from_regime, to_regime, n, probability)."""
    steps = (
        labelled.select(*keys, F.lag("Regime").over(series(keys)).alias("a"), F.col("Regime").alias("b"))
        .filter(F.col("a").isNotNull())
        .groupBy(*keys, "a", "b")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*keys, "a"))
    return steps.select(
        *keys,
        label_name(F.col("a")).alias("from_regime"),
        label_name(F.col("b")).alias("to_regime"),
        "n",
        (F.col("n") / total).alias("probability"),
    )


def known(columns) -> Column:
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return complete


def mark(features: DataFrame, columns, least: int, keys, train: Column | None) -> DataFrame:
    """Features with the rule's code in `_rule`, and `_use` / `_fit`: rows a model can label / may learn from.

    Keys with fewer than `least` learnable rows get neither and so keep the rule.
    """
    complete = known(columns)
    df = rule_regime(features, keys).withColumnRenamed("Regime", "_rule").drop("Regime_Label")
    df = df.withColumn("_use", complete).withColumn("_fit", complete if train is None else complete & train)
    enough = F.count_if("_fit").over(Window.partitionBy(*keys)) >= least
    return df.withColumn("_enough", enough).withColumns(
        {"_use": F.col("_use") & F.col("_enough"), "_fit": F.col("_fit") & F.col("_enough")}
    )


def model_or_rule(df: DataFrame) -> DataFrame:
    """The spread model label for fitted keys, the rule for the others."""
    code = F.when(F.col("_enough"), F.col("Regime")).otherwise(F.col("_rule")).cast("int")
    internal = [c for c in df.columns if c.startswith("_")]
    return df.withColumn("Regime", code).withColumn("Regime_Label", label_name(F.col("Regime"))).drop(*internal)


def fitted_or_rule(features: DataFrame, method: str = "hmm", keys=KEYS) -> DataFrame:
    """Per key the number of rows a model could learn from, and whether it is fitted or keeps the rule."""
    columns, least = (HMM_FEATURES, HMM_LEAST) if method == "hmm" else (KMEANS_FEATURES, KMEANS_LEAST)
    complete = known(columns)
    counts = features.groupBy(*keys).agg(F.count_if(complete).alias("usable_rows"))
    return counts.withColumn("path", F.when(F.col("usable_rows") >= least, method).otherwise("rule"))


def kmeans_regime(features: DataFrame, keys=KEYS, train: Column | None = None) -> DataFrame:
    """Clusters of six standardised features, ordered by return, smoothed and carried to every bar."""
    df = mark(features, KMEANS_FEATURES, KMEANS_LEAST, keys, train)
    df = standardise(df, KMEANS_FEATURES, keys, F.col("_fit"))
    z = [f"z_{c}" for c in KMEANS_FEATURES]
    df = models.cluster_states(df, z, keys).drop(*z)
    df = order_states(df, "state", keys, F.col("_fit"))
    df = smooth_labels(df, SMOOTHING, (*keys, "_use"))
    df = df.withColumn("Regime", F.when(F.col("_use"), F.col("Regime"))).drop("state")
    return model_or_rule(spread_forward(df, keys))


def decode_hmm(features: DataFrame, keys=KEYS, train: Column | None = None, parameters: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(model table, all rows with state and posteriors p0..p2 where the key has a model). With `parameters` the model is stated."""
    # The fit and the decoding read the features' few columns again, from the same exchange; no whole row is written for them.
    df = mark(features, HMM_FEATURES, HMM_LEAST, keys, train)
    if parameters is None:
        model = settle(models.fit_hmm(df.filter("_fit"), HMM_FEATURES, keys))  # read by the decoding and by the caller
    else:
        model = models.stated_model(df, HMM_FEATURES, parameters, keys)
    return model, models.decode(df, model, HMM_FEATURES, keys)


def hmm_regime(features: DataFrame, keys=KEYS, train: Column | None = None, causal=False, parameters: dict | None = None) -> DataFrame:
    """Three-state Gaussian HMM labels with posteriors. `train` (a condition on the rows) restricts fitting.

    With `parameters` (start, trans, mean, cov) nothing is fitted but the standardisation. Fit, best path and posteriors are worked
    out in one pass over a series' arrays; `decode_hmm` gives the same by way of a model table.
    """
    df = mark(features, HMM_FEATURES, HMM_LEAST, keys, train)
    found = models.label_series(df.filter("_use"), HMM_FEATURES, "Return_5d", keys, parameters)
    df = models.placed(df, found, keys, models.M)
    return model_or_rule(spread_both(ordered_labels(df), causal=causal, keys=keys))


def ordered_labels(df: DataFrame) -> DataFrame:
    """Regime and its probabilities out of states, posteriors and mean returns, which are consumed."""
    return order_posteriors(order_by_means(df)).drop("state", *models.P)


def model_transitions(model: DataFrame, decoded: DataFrame, keys=KEYS) -> DataFrame:
    """The fitted transition matrix re-ordered to BEAR, SIDEWAYS, BULL, rows normalised."""
    ranks = (
        order_states(decoded.filter("_fit"), "state", keys)
        .groupBy(*keys)
        .agg(*[F.first(f"_r{s}").alias(f"_r{s}") for s in range(3)])
    )
    rank_of = lambda c: F.element_at(F.array("_r0", "_r1", "_r2"), c + 1)
    cells = (
        model.select(*keys, "state", F.posexplode("trans").alias("to_state", "probability"))
        .join(ranks, list(keys))
        .select(
            *keys,
            rank_of(F.col("state")).alias("a"),
            rank_of(F.col("to_state")).alias("b"),
            "probability",
        )
    )
    total = F.sum("probability").over(Window.partitionBy(*keys, "a"))
    return cells.select(
        *keys,
        label_name(F.col("a")).alias("from_regime"),
        label_name(F.col("b")).alias("to_regime"),
        (F.col("probability") / total).alias("probability"),
    )


def label(features: DataFrame, method: str = "hmm", keys=KEYS, train: Column | None = None, parameters: dict | None = None) -> DataFrame:
    if method == "ma_crossover":
        return rule_regime(features, keys)
    if method == "kmeans":
        return kmeans_regime(features, keys, train)
    if method == "hmm":
        return hmm_regime(features, keys, train, parameters=parameters)
    raise ValueError(f"unknown regime method: {method}")


def latest_label(labelled: DataFrame, keys=KEYS) -> DataFrame:
    """Newest labelled bar per key."""
    return (
        labelled.filter(F.col("Regime_Label").isNotNull())
        .groupBy(*keys)
        .agg(F.max("date").alias("as_of"), F.max_by("Regime_Label", "date").alias("Regime_Label"))
    )
