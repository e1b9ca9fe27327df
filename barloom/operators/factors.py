"""Factor returns and return attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import change, filled
from ..settings import DEFAULTS, Settings
from .performance import RUN
from .significance import join_dates, regress

SET = ("factor_set",)
KEY = (*RUN, *SET)
LEAST = 50
# Factor name -> transform: "smb" is a spread over the market, "excess" a plain return.
FACTORS = {"Market": "excess", "Size": "smb", "IT": "excess", "Banking": "excess"}


def missing_factors(requested: DataFrame, prices: DataFrame) -> DataFrame:
    """Requested factors without any price."""
    return requested.join(prices.select("factor").distinct(), "factor", "left_anti")


def factor_returns(prices: DataFrame, factors: dict[str, str] = FACTORS) -> DataFrame:
    """(factor_set, date, one column per factor) from long prices (factor_set, date, factor, close).

    Days are the union over factors; closes are carried forward and incomplete days dropped before differencing.
    """
    names = list(factors)
    wide = prices.groupBy(*SET, "date").agg(
        *[F.max(F.when(F.col("factor") == f, F.col("close"))).alias(f"_{f}") for f in names]
    )
    wide = wide.withColumns({f"_{f}": filled(f"_{f}", None, SET) for f in names}).dropna(subset=[f"_{f}" for f in names])
    rets = wide.withColumns({f: change(F.col(f"_{f}"), 1, SET) for f in names}).dropna(subset=names)
    if "Market" in names:
        spreads = {f: F.col(f) - F.col("Market") for f, kind in factors.items() if kind == "smb"}
        rets = rets.withColumns(spreads) if spreads else rets
    return rets.select(*SET, "date", *names)


def excess(returns: DataFrame, factors: dict[str, str] = FACTORS, cfg: Settings = DEFAULTS) -> DataFrame:
    """Factor returns over the risk-free rate; spreads already are."""
    return returns.withColumns({f: F.col(f) - cfg.rf_daily for f, kind in factors.items() if kind != "smb"})


def attribution(returns: DataFrame, factor_rets: DataFrame, factors: dict[str, str] = FACTORS, lags: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per run and factor set: alpha, R2 and an array of per-factor results (`loadings`)."""
    f = excess(factor_rets, factors, cfg)
    rows = join_dates(returns.select(*RUN, "date", (F.col("ret") - cfg.rf_daily).alias("y")), f)
    fit = regress(rows, "y", list(factors), lags, KEY, LEAST)
    k = len(factors)
    r2 = F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.nullif(F.col("ss_tot"), F.lit(0.0))).otherwise(0.0)
    loadings = [
        F.struct(
            F.lit(name).alias("factor"),
            F.col("coef")[i + 1].alias("beta"),
            F.col("se")[i + 1].alias("se"),
            F.col("t")[i + 1].alias("t_stat"),
            F.col("p")[i + 1].alias("p_value"),
            (F.col("coef")[i + 1] * F.col("means")[i] * cfg.trading_days).alias("contribution"),
        )
        for i, name in enumerate(factors)
    ]
    df = fit.select(
        *KEY,
        F.col("n").alias("n_obs"),
        F.col("lags").alias("hac_lags"),
        F.col("coef")[0].alias("alpha_daily"),
        (F.col("coef")[0] * cfg.trading_days).alias("alpha_annual"),
        F.col("se")[0].alias("alpha_se"),
        F.col("t")[0].alias("alpha_t"),
        F.col("p")[0].alias("alpha_p"),
        r2.alias("r_squared"),
        (F.col("mean_y") * cfg.trading_days).alias("strategy_mean_annual"),
        (F.col("mean_resid") * cfg.trading_days).alias("unexplained_annual"),
        F.array(*loadings).alias("loadings"),
    )
    n = F.col("n_obs")
    return df.withColumn(
        "adj_r_squared", 1 - (1 - F.col("r_squared")) * (n - 1) / F.greatest(n - k - 1, F.lit(1))
    )


def loadings(result: DataFrame) -> DataFrame:
    """Long form: (run_id, factor_set, factor, beta, se, t_stat, p_value, contribution)."""
    return result.select(*KEY, F.explode("loadings").alias("f")).select(*KEY, "f.*")


def _mark(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").otherwise("n.s.")


def coefficient_table(result: DataFrame) -> DataFrame:
    """Alpha and factors as table rows with formatted loadings and significance marks."""
    alpha = result.select(
        *KEY,
        F.lit("α (pure alpha)").alias("factor"),
        F.format_string("%+.2f%% / yr", F.col("alpha_annual") * 100).alias("loading"),
        F.col("alpha_t").alias("t_stat"),
        F.col("alpha_p").alias("p_value"),
        F.col("alpha_annual").alias("contribution"),
    )
    rest = loadings(result).select(
        *KEY, "factor", F.format_string("%+.3f", F.col("beta")).alias("loading"), "t_stat", "p_value", "contribution"
    )
    return alpha.unionByName(rest).withColumn("significance", _mark(F.col("p_value")))


def largest_contributor(result: DataFrame) -> DataFrame:
    """Factor with the largest absolute contribution; the first listed wins a tie."""
    best = F.reduce(
        F.col("loadings"),
        F.col("loadings")[0],
        lambda acc, x: F.when(F.abs(x["contribution"]) > F.abs(acc["contribution"]), x).otherwise(acc),
    )
    return result.select(*KEY, best["factor"].alias("factor"), best["contribution"].alias("contribution"))


def attribution_verdict(result: DataFrame) -> DataFrame:
    up = F.col("alpha_annual") > 0
    kind = F.when(up & (F.col("alpha_p") < 0.05), "significant").when(up, "positive, not significant").otherwise("not positive")
    return result.select(*KEY, kind.alias("verdict"), (F.col("r_squared") > 0.85).alias("factor_like"))
