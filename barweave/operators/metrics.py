"""Performance tables: one row per series from (series_id, date, r)."""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.constants import TRADING_DAYS
from barweave.functions import stats as st
from barweave.functions.columns import finite, ratio
from barweave.functions.normal import norm_cdf_column, norm_ppf, norm_ppf_column
from barweave.functions.rolling import cumulative, ordered, trailing
from barweave.operators.prefix import rebased, worst_drawdowns
from barweave.operators.sliding import sliding

SERIES = "series_id"
EULER_GAMMA = 0.5772156649


def with_wealth(returns: DataFrame, by: str | tuple[str, ...] = SERIES) -> DataFrame:
    """Add wealth, its running peak, drawdown and the bars since the peak.

    Starting capital is not a peak: a loss on the first bar is no drawdown.
    """
    w = cumulative(by)
    df = returns.where(F.col("r").isNotNull())
    df = df.withColumns({"wealth": F.product(1 + F.col("r")).over(w), "_pos": F.row_number().over(ordered(by))})
    df = df.withColumn("peak", F.max("wealth").over(w))
    at_peak = F.max(F.when(F.col("wealth") >= F.col("peak"), F.col("_pos"))).over(w)
    return df.withColumns(
        {"drawdown": ratio(F.col("wealth"), F.col("peak")) - 1, "underwater": F.col("_pos") - at_peak}
    ).drop("_pos")


def performance(returns: DataFrame, periods: int = TRADING_DAYS) -> DataFrame:
    """All headline metrics in one pass: a window and an aggregate on the same key."""
    r = F.col("r")
    out = with_wealth(returns).groupBy(SERIES).agg(
        F.count(r).alias("n_obs"),
        st.annual_return(r, periods).alias("cagr"),
        st.annual_vol(r, periods).alias("vol"),
        st.sharpe(r, periods=periods).alias("sharpe"),
        st.sortino(r, periods=periods).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        st.hit_rate(r).alias("hit_rate"),
        st.profit_factor(r).alias("profit_factor"),
        st.omega(r).alias("omega"),
        F.max("underwater").cast("long").alias("time_underwater"),
    )
    return out.withColumn("calmar", ratio(F.col("cagr"), F.abs("max_drawdown")))


def drawdowns(returns: DataFrame) -> DataFrame:
    """Worst drawdown, bars under water and bars from the trough to recovery (0 if none).

    Through the prefix scan, so that a single long series spreads over many tasks.
    """
    return worst_drawdowns(returns, SERIES)


def moments(returns: DataFrame) -> DataFrame:
    """Mean, deviation, skew and excess kurtosis, all sample-corrected; NULL under 4 bars."""
    r = F.col("r")
    enough = F.count(r) >= 4
    return returns.groupBy(SERIES).agg(
        F.when(enough, F.avg(r)).alias("mean"),
        F.when(enough, F.stddev_samp(r)).alias("sd"),
        F.when(enough, st.skew_unbiased(r)).alias("skew"),
        F.when(enough, st.kurt_unbiased(r)).alias("kurt"),
    )


def probabilistic_sharpe(returns: DataFrame, benchmark_sr: float = 0.0, raw_kurtosis: bool = False) -> DataFrame:
    """z and probability that the true Sharpe ratio exceeds ``benchmark_sr`` (annual)."""
    z = st.psr_z(F.col("r"), benchmark_sr, raw_kurtosis=raw_kurtosis)
    return returns.groupBy(SERIES).agg(z.alias("z")).withColumn("psr", norm_cdf_column("z"))


def expected_max_sharpe(n_trials: int, sharpes: Sequence[float] | None = None) -> float:
    """Annual Sharpe ratio the best of ``n_trials`` skill-less strategies is expected to show."""
    if n_trials < 1:
        raise ValueError("n_trials must be >= 1")
    sd = statistics.stdev(sharpes) if sharpes is not None and len(sharpes) > 1 else 1.0
    if not math.isfinite(sd) or sd <= 0:
        sd = 1.0
    z_max = (1 - EULER_GAMMA) * norm_ppf(1 - 1 / n_trials) + EULER_GAMMA * norm_ppf(1 - 1 / (n_trials * math.e))
    return sd * z_max


def deflated_sharpe(
    returns: DataFrame, n_trials: int, sharpes: Sequence[float] | None = None, raw_kurtosis: bool = False
) -> DataFrame:
    """Probability of beating the expected maximum over the recorded number of trials."""
    out = probabilistic_sharpe(returns, expected_max_sharpe(n_trials, sharpes), raw_kurtosis)
    return out.withColumnRenamed("psr", "dsr")


def expected_max_from_log(log: DataFrame) -> DataFrame:
    """One row (n_trials, expected_max): :func:`expected_max_sharpe` over a run log's ``sharpe``.

    Count and deviation are moments that merge before the shuffle, so the log may be of any
    length. Runs without a Sharpe ratio count as trials but not for the deviation; an empty log
    counts as one trial. One trial has nothing to deflate: its maximum is minus infinity.
    """
    n = F.greatest(F.col("n_trials"), F.lit(1)).cast("double")
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    z_max = (1 - EULER_GAMMA) * norm_ppf_column(1 - 1 / n) + EULER_GAMMA * norm_ppf_column(1 - 1 / (n * math.e))
    sharpe = F.when(finite(F.col("sharpe")), F.col("sharpe"))
    stats = log.agg(F.count(F.lit(1)).alias("n_trials"), F.stddev_samp(sharpe).alias("_sd"))
    return stats.select(
        n.cast("long").alias("n_trials"), F.when(n > 1, sd * z_max).otherwise(F.lit(-math.inf)).alias("expected_max")
    )


def deflated_sharpe_from_log(returns: DataFrame, log: DataFrame, raw_kurtosis: bool = False) -> DataFrame:
    """(series_id, n_trials, expected_max, z, dsr) with the trials taken from a run log.

    With one recorded trial z is infinite and the probability 1. A series with too few bars
    has neither.
    """
    r = F.col("r")
    stats = returns.groupBy(SERIES).agg(
        st.psr_z(r, 0.0, raw_kurtosis=raw_kurtosis).alias("_z0"),
        st.psr_slope(r, raw_kurtosis=raw_kurtosis).alias("_slope"),
    )
    out = stats.join(F.broadcast(expected_max_from_log(log)), how="inner")  # one row
    z = F.when(F.col("_z0").isNotNull(), F.col("_z0") - F.col("expected_max") * F.col("_slope"))
    return out.select(SERIES, "n_trials", "expected_max", z.alias("z")).withColumn("dsr", norm_cdf_column("z"))


def per_year(returns: DataFrame) -> DataFrame:
    r = F.col("r")
    return returns.where(r.isNotNull()).groupBy(SERIES, F.year("date").alias("year")).agg(
        (F.product(1 + r) - 1).alias("total_return"),
        st.annual_vol(r).alias("vol"),
        F.when(F.stddev_samp(r) > 0, ratio(F.avg(r), F.stddev_samp(r)) * math.sqrt(TRADING_DAYS)).alias("sharpe"),
    )


def rolling_sharpe_beta(returns: DataFrame, benchmark: DataFrame, window: int = TRADING_DAYS) -> DataFrame:
    """Rolling Sharpe ratio of each series and its beta to ``benchmark`` (date, b).

    NULL where the deviation in the frame is noise beside the mean.
    """
    r, b = F.col("r"), F.col("b")
    df = returns.where("r IS NOT NULL").join(benchmark.select("date", "b"), "date", "left")
    df = sliding(df, window, SERIES, moments={"_r": r, "_b": b}, pairs={"_rb": (r, b)})
    sd, var = F.sqrt(F.col("_r_m2") / (window - 1)), F.col("_b_m2") / (window - 1)
    noise = lambda mean: F.greatest(F.lit(1e-15), F.abs(F.col(mean)) * 1e-12)
    steady, moving = sd >= noise("_r_mean"), F.sqrt(var) >= noise("_b_mean")
    return df.select(
        SERIES,
        "date",
        F.when((F.col("_r_n") == window) & steady, ratio(F.col("_r_mean"), sd) * math.sqrt(TRADING_DAYS)).alias("roll_sharpe"),
        F.when((F.col("_b_n") == window) & moving, ratio(F.col("_rb_co") / (window - 1), var)).alias("roll_beta"),
    )


def histogram(returns: DataFrame, bins: int = 60, value: str = "r") -> DataFrame:
    """Equal-width counts and densities per series; the last bin is closed on the right.

    The range and size come from one aggregate joined back by series.
    """
    x = F.col(value)
    df = returns.where(x.isNotNull())
    ends = df.groupBy(SERIES).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bucket = F.least(F.lit(bins - 1), F.coalesce(F.floor(ratio(x - F.col("_lo"), width)), F.lit(0)))
    return (
        df.join(ends, SERIES)
        .groupBy(SERIES, "_lo", "_hi", "_n", bucket.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            SERIES,
            "bin",
            (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
            "count",
            ratio(F.col("count"), F.col("_n") * width).alias("density"),
        )
    )


def normal_overlay(returns: DataFrame, points: int = 200) -> DataFrame:
    """Fitted normal density on an even grid from the least to the greatest return."""
    fit = returns.groupBy(SERIES).agg(
        F.min("r").alias("_lo"), F.max("r").alias("_hi"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s")
    )
    grid = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1)
    z = ratio(F.col("x") - F.col("_m"), F.col("_s"))
    density = ratio(F.exp(-0.5 * z * z), F.col("_s") * math.sqrt(2 * math.pi))
    return grid.withColumn("x", x).select(SERIES, "point", "x", density.alias("density"))


def normalised_equity(equity: DataFrame) -> DataFrame:
    """Each curve over its first value, with the drawdown of its returns."""
    w = ordered(SERIES)
    first = F.first("equity").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = equity.withColumns(
        {"norm_equity": F.col("equity") / first, "r": ratio(F.col("equity"), F.lag("equity").over(w)) - 1}
    )
    growth = F.product(1 + F.col("r")).over(cumulative(SERIES))
    df = df.withColumn("_w", F.when(F.col("r").isNotNull(), growth))
    peak = F.max("_w").over(cumulative(SERIES))
    return df.select(SERIES, "date", "norm_equity", (ratio(F.col("_w"), peak) - 1).alias("drawdown"))


def benchmark_curve(panel: DataFrame, ticker: str, base: float = 1_000_000.0) -> DataFrame:
    """One ticker's price rebased to ``base`` at its first bar."""
    return rebased(panel, ticker, base)


def kpis(returns: DataFrame, n_trials: int = 1, turnover: DataFrame | None = None) -> DataFrame:
    """The report's headline figures per series; average turnover when it is given."""
    r = F.col("r")
    bench = expected_max_sharpe(n_trials)
    extra = returns.where(r.isNotNull()).groupBy(SERIES).agg(
        st.psr_z(r, 0.0).alias("psr_z"), st.psr_z(r, bench).alias("dsr_z")
    )
    out = performance(returns).join(extra, SERIES)
    out = out.withColumns({"psr": norm_cdf_column("psr_z"), "dsr": norm_cdf_column("dsr_z")})
    if turnover is not None:
        out = out.join(turnover.groupBy(SERIES).agg(F.avg("turnover").alias("avg_turnover")), SERIES, "left")
    return out
