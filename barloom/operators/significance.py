"""Is the result luck? Sharpe inference and robust regressions per run."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import series, spread
from ..functions.lineage import settle
from ..functions.numeric import coefficients, expected_max_factor, inverse, normal_cdf, sandwich_errors, two_sided_p
from ..settings import DEFAULTS, Settings
from .performance import RUN

LEAST = 30
#: Resamples of a run that one row of work covers.
SAMPLE_BLOCK = 250
#: Draws that are worked out at a time, in the same few buffers.
DRAWN = 65_536


def moments(returns: DataFrame, cfg: Settings = DEFAULTS, rf: float = 0.0) -> DataFrame:
    """n, annualised Sharpe, bias-corrected skewness and excess kurtosis per run."""
    r = F.col("ret")
    df = returns.filter(r.isNotNull()).groupBy(*RUN).agg(
        F.count("*").cast("double").alias("n"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_sd"),
        F.skewness(r).alias("_g1"),
        F.kurtosis(r).alias("_g2"),
    )
    n = F.col("n")
    value = (F.col("_mean") - rf) / F.nullif(F.col("_sd"), F.lit(0.0)) * sqrt(cfg.trading_days)
    return df.select(
        *RUN,
        "n",
        F.when(n >= 2, F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias("sharpe"),
        F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skew"),
        F.when(
            n > 3, ((n + 1) * F.col("_g2") + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
        ).alias("excess_kurtosis"),
    )


def _psr(benchmark: Column, cfg: Settings) -> Column:
    s = F.col("sharpe") / sqrt(cfg.trading_days)
    var = (1 - F.col("skew") * s + F.col("excess_kurtosis") / 4 * s * s) / (F.col("n") - 1)
    z = (s - benchmark / sqrt(cfg.trading_days)) / F.sqrt(F.greatest(var, F.lit(1e-300)))
    return F.when(var <= 0, 0.5).otherwise(normal_cdf(z))


def probabilistic_sharpe(returns: DataFrame, benchmark: float = 0.0, rf: float = 0.0, cfg: Settings = DEFAULTS) -> DataFrame:
    """P(true Sharpe > benchmark) for runs of at least 30 returns."""
    return moments(returns, cfg, rf).filter(F.col("n") >= LEAST).withColumn("psr", _psr(F.lit(benchmark), cfg))


def deflated_sharpe(returns: DataFrame, n_trials: int = 10, rf: float = 0.0, cfg: Settings = DEFAULTS) -> DataFrame:
    """PSR against the best Sharpe expected from n_trials worthless strategies."""
    df = moments(returns, cfg, rf).filter(F.col("n") >= LEAST)
    best = F.sqrt(cfg.trading_days / (F.col("n") - 1)) * expected_max_factor(n_trials)
    return df.withColumn("expected_max_sharpe", best).withColumn("dsr", _psr(F.col("expected_max_sharpe"), cfg))


#: The prime modulus and the multipliers of the draws.
PRIME, STEP, SPREAD_RUN, SPREAD_SAMPLE = 2**31 - 1, 48271, 742938285, 1226874159
#: A variance below this share of the mean square is rounding: all draws were equal.
EQUAL_DRAWS = 1e-14


def run_number(run: Column) -> Column:
    """28 bits that stand for a run: the first seven hex digits of its name's MD5."""
    return F.conv(F.substring(F.md5(run.cast("string")), 1, 7), 16, 10).cast("long")


def first_state(run: np.ndarray, sample: np.ndarray, seed: int) -> np.ndarray:
    """Where the draws of a sample start: never zero, and not linear in the sample."""
    mixed = (((run + seed) % PRIME + 1) * SPREAD_RUN) % PRIME
    mixed = ((mixed + sample + 1) * SPREAD_SAMPLE) % PRIME
    mixed = mixed ^ (mixed >> 15)
    return 1 + (mixed * SPREAD_RUN) % (PRIME - 1)


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for k in range(1, n):
        out[k] = out[k - 1] * STEP % PRIME
    return out


def drawn_sums(r: np.ndarray, state: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squares of the returns that each state draws; known: the powers of `STEP`, one for each return.

    A product's remainder by the prime 2^31 - 1 is its upper bits added to its lower 31 ones, twice: neither state nor power is
    a multiple of it, so the second sum is below the prime.
    """
    n = len(r)
    slab = max(1, DRAWN // n)
    place, high, picked = np.empty((slab, n), np.int64), np.empty((slab, n), np.int64), np.empty((slab, n))
    mean, square = np.empty(len(state)), np.empty(len(state))
    for at in range(0, len(state), slab):
        some = state[at : at + slab, None]
        x, up, p = place[: len(some)], high[: len(some)], picked[: len(some)]
        np.multiply(some, known[None, :n], out=x)
        for _ in range(2):
            np.right_shift(x, 31, out=up)
            np.bitwise_and(x, PRIME, out=x)
            np.add(x, up, out=x)
        np.multiply(x, n, out=x)
        np.right_shift(x, 31, out=x)
        np.take(r, x, out=p, mode="clip")  # places are below n; other modes copy the buffer
        mean[at : at + slab] = p.mean(axis=1)
        square[at : at + slab] = np.einsum("ij,ij->i", p, p)
    return mean, square


def bootstrap(returns: DataFrame, resamples: int = 5000, rf: float = 0.0, seed: int = 42, cfg: Settings = DEFAULTS) -> DataFrame:
    """(run_id, sample, sharpe): resampled Sharpe ratios.

    Draw k of a sample is the place state * STEP^k mod PRIME * n div 2^31 among the run's n returns in order of date, with the
    state of `first_state`: plain integers, which any engine repeats. A run's returns (one a day) form one array, its samples
    are dealt to tasks in blocks of `SAMPLE_BLOCK`; a task draws one block at a time and keeps two sums of each sample.
    """
    item = F.struct("date", "ret")
    packed = (
        returns.filter(F.col("ret").isNotNull())
        .groupBy(*RUN)
        .agg(F.sort_array(F.collect_list(item)).alias("all"))
        .filter(F.size("all") >= LEAST)
        .select(*RUN, F.transform("all", lambda x: x["ret"]).alias("r"), run_number(F.col(RUN[0])).alias("number"))
    )
    blocks = F.sequence(F.lit(0).cast("long"), F.lit((resamples - 1) // SAMPLE_BLOCK).cast("long"))
    rows = spread(packed.withColumn("block", F.explode(blocks)), *RUN, "block")
    scale = sqrt(cfg.trading_days)

    def draw(batches):
        known = powers(1)
        for batch in batches:
            run, number, block = batch.column(RUN[0]), batch.column("number").to_numpy(), batch.column("block").to_numpy()
            values = batch.column("r")
            for k in range(batch.num_rows):
                r = values[k].values.to_numpy()
                n = len(r)
                if len(known) < n:
                    known = powers(n)
                sample = np.arange(block[k] * SAMPLE_BLOCK, min((block[k] + 1) * SAMPLE_BLOCK, resamples))
                state = first_state(number[k], sample, seed)
                mean, square = drawn_sums(r, state, known)
                variance = (square - n * mean * mean) / (n - 1)
                some = variance > EQUAL_DRAWS * square / n
                sharpe = np.where(some, (mean - rf) / np.sqrt(np.where(some, variance, 1.0)) * scale, 0.0)
                of = run.take(pa.array(np.full(len(sample), k)))
                yield pa.RecordBatch.from_arrays([of, pa.array(sample), pa.array(sharpe)], [RUN[0], "sample", "sharpe"])

    return rows.mapInArrow(draw, f"{RUN[0]} {dict(returns.dtypes)[RUN[0]]}, sample long, sharpe double")


def bootstrap_interval(samples: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval per run."""
    tail = (1 - level) / 2
    return samples.groupBy(*RUN).agg(
        F.percentile("sharpe", F.lit(tail)).alias("ci_low"),
        F.percentile("sharpe", F.lit(1 - tail)).alias("ci_high"),
        F.count("*").alias("n_resamples"),
    )


def bootstrap_histogram(samples: DataFrame, bins: int = 50) -> DataFrame:
    """`histogram` of each run's samples. They are drawn once: a run's samples, as many as were asked for, form one array."""
    known = samples.filter(F.col("sharpe").isNotNull()).groupBy(*RUN).agg(F.collect_list("sharpe").alias("_all"))
    known = known.withColumns({"_lo": F.array_min("_all"), "_hi": F.array_max("_all")})
    value = F.col("_value")
    rows = known.select(*RUN, "_lo", "_hi", F.explode("_all").alias("_value"))
    place = F.floor((value - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    width = (F.col("_hi") - F.col("_lo")) / bins
    counted = rows.groupBy(*RUN, F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.first(F.col("_lo")).alias("_lo"), F.first(width).alias("_width"),
        F.sum(value).alias("_sum"), F.var_pop(value).alias("_spread"),
    )
    whole = Window.partitionBy(*RUN)  # a row for each bin
    total, mean = F.sum("n").over(whole), F.sum("_sum").over(whole) / F.sum("n").over(whole)
    counted = counted.withColumns({"mean": mean, "_n": total})
    off = F.col("n") * (F.col("_spread") + (F.col("_sum") / F.col("n") - F.col("mean")) ** 2)
    sigma = F.when(F.col("_n") > 1, F.sqrt(F.sum(off).over(whole) / F.nullif(F.col("_n") - 1, F.lit(0))))
    return counted.select(*RUN, "bin", "n", (F.col("_lo") + F.col("bin") * F.col("_width")).alias("low"), "mean", sigma.alias("sigma"))


def join_dates(left: DataFrame, right: DataFrame, on=("date",)) -> DataFrame:
    """Inner alignment of two return tables. Spark broadcasts a side that it finds small enough."""
    return left.join(right, list(on))


# ---- regression with Newey-West errors ----


def regress(rows: DataFrame, y: str, xs: list[str], lags: int | None = None, keys=RUN, least: int = LEAST) -> DataFrame:
    """OLS of y on a constant and `xs` per key, with heteroskedasticity- and autocorrelation-robust errors.

    Returns arrays `coef`, `se`, `t`, `p` (constant first) plus n, lags, ss_res, ss_tot, mean_y, mean_resid, means.
    Cross products are ordinary sums combined map-side, the k x k matrix of a key is solved by array folds. The aligned rows
    and the fits are written to the shared folder once, as each is read several times.
    """
    k = len(xs) + 1
    data = rows.select(*keys, "date", F.col(y).alias("_y"), *[F.col(x).alias(f"_x{i + 1}") for i, x in enumerate(xs)])
    data = settle(data.dropna()).withColumn("_x0", F.lit(1.0))
    x = [F.col(f"_x{i}") for i in range(k)]
    fit = data.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(k) for j in range(k)]).alias("_xx"),
        F.array(*[F.sum(x[i] * F.col("_y")) for i in range(k)]).alias("_xy"),
        F.avg("_y").alias("mean_y"),
        F.array(*[F.avg(x[i]) for i in range(1, k)]).alias("means"),
    )
    rule = F.greatest(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2.0 / 9))), F.lit(1))
    fit = fit.filter(F.col("n") >= least).withColumns(
        {"lags": (F.lit(lags) if lags else rule).cast("int"), "inv": inverse(F.col("_xx"), k)}
    )
    fit = fit.withColumn("coef", coefficients(F.col("inv"), F.col("_xy"))).drop("_xx", "_xy").filter(F.col("coef").isNotNull())
    fit = settle(fit)

    df = spread(data, *keys).join(fit.select(*keys, "coef", "lags", "mean_y"), list(keys))
    df = df.withColumn("_e", F.col("_y") - sum((F.col("coef")[i] * x[i] for i in range(k)), F.lit(0.0)))
    df = df.withColumns({f"_u{i}": x[i] * F.col("_e") for i in range(k)})
    # Each row meets its predecessors at lags 1 to the number of its own key, whatever that is: the longest number is the number of lags looked up.
    most = fit.agg(F.max("lags")).first()[0] or 1
    df = df.withColumn("_now", F.struct(*[f"_u{i}" for i in range(k)]))
    df = df.withColumns({f"_back{g}": F.lag("_now", g).over(series(keys)) for g in range(1, most + 1)})
    share = lambda g, i: F.when(F.col("lags") >= g, (1 - F.lit(g) / (F.col("lags") + 1)) * F.col(f"_back{g}._u{i}"))
    df = df.withColumns({f"_v{i}": sum((F.coalesce(share(g, i), F.lit(0.0)) for g in range(1, most + 1)), F.lit(0.0)) for i in range(k)})
    u, v = [F.col(f"_u{i}") for i in range(k)], [F.col(f"_v{i}") for i in range(k)]
    meat = df.groupBy(*keys).agg(
        F.array(*[F.sum(u[i] * u[j]) + F.sum(u[i] * v[j] + u[j] * v[i]) for i in range(k) for j in range(k)]).alias("omega"),
        F.sum(F.col("_e") ** 2).alias("ss_res"),
        F.sum((F.col("_y") - F.col("mean_y")) ** 2).alias("ss_tot"),
        F.avg("_e").alias("mean_resid"),
    )
    out = fit.join(meat, list(keys)).withColumn("se", sandwich_errors(F.col("inv"), F.col("omega"), k)).drop("inv", "omega")
    ratio_of = lambda c, s: F.coalesce(c / F.nullif(s, F.lit(0.0)), F.lit(0.0))
    return out.withColumn("t", F.zip_with("coef", "se", ratio_of)).withColumn("p", F.transform("t", two_sided_p))


def alpha_test(returns: DataFrame, benchmark: DataFrame, rf: float = 0.0, lags: int | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Alpha and beta of excess returns with Newey-West t and p."""
    both = join_dates(returns.select(*RUN, "date", "ret"), benchmark.select("date", F.col("ret").alias("bench_ret")))
    both = both.select(*RUN, "date", (F.col("ret") - rf).alias("y"), (F.col("bench_ret") - rf).alias("x"))
    fit = regress(both, "y", ["x"], lags)
    df = fit.select(
        *RUN,
        F.col("coef")[0].alias("alpha_daily"),
        (F.col("coef")[0] * cfg.trading_days).alias("alpha_annual"),
        F.col("coef")[1].alias("beta"),
        F.col("se")[0].alias("se_alpha_daily"),
        F.col("t")[0].alias("t_stat"),
        F.col("p")[0].alias("p_value"),
        F.col("n").alias("n_obs"),
        F.col("lags").alias("hac_lags"),
    )
    return df.withColumns({"significant_5pct": F.col("p_value") < 0.05, "significant_1pct": F.col("p_value") < 0.01})


def verdict(prob: Column) -> Column:
    """Evidence class of a probability."""
    return F.when(prob >= 0.95, "strong").when(prob >= 0.80, "borderline").otherwise("weak")


def full_report(returns: DataFrame, benchmark: DataFrame | None = None, n_trials: int = 10, resamples: int = 5000, rf: float = 0.0, cfg: Settings = DEFAULTS) -> DataFrame:
    """Bootstrap interval, PSR, DSR and, where a benchmark overlaps by more than 30 days, the alpha test."""
    ci = bootstrap_interval(bootstrap(returns, resamples, rf, cfg=cfg))
    psr = probabilistic_sharpe(returns, 0.0, rf, cfg)
    dsr = deflated_sharpe(returns, n_trials, rf, cfg).select(*RUN, "expected_max_sharpe", "dsr")
    out = ci.join(psr, list(RUN)).join(dsr, list(RUN))
    if benchmark is not None:
        out = out.join(alpha_test(returns, benchmark, rf, cfg=cfg).filter(F.col("n_obs") > LEAST), list(RUN), "left")
    return out.withColumn("dsr_verdict", verdict(F.col("dsr")))
