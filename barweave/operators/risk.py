"""Risk tables: one row per series from (series_id, date, r)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.constants import CONFIDENCE, STRESS_WINDOWS
from barweave.functions import stats as st
from barweave.functions.normal import norm_ppf
from barweave.operators.metrics import SERIES, with_wealth

MIN_OBS = 30


def parametric_stat(r: Column, confidence: float = CONFIDENCE) -> Column:
    return -(F.avg(r) + F.stddev_samp(r) * norm_ppf(1 - confidence))


def historical_stat(r: Column, confidence: float = CONFIDENCE) -> Column:
    return -F.percentile(r, F.lit(1 - confidence))


def cornish_fisher_stat(r: Column, confidence: float = CONFIDENCE) -> Column:
    """Normal quantile bent by sample skew and excess kurtosis."""
    z = norm_ppf(1 - confidence)
    s, k = st.skew_unbiased(r), st.kurt_unbiased(r)
    bent = z + (z**2 - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s * s
    return -(F.avg(r) + F.stddev_samp(r) * bent)


VAR_METHODS = {
    "parametric": parametric_stat,
    "historical": historical_stat,
    "cornish_fisher": cornish_fisher_stat,
}


def value_at_risk(returns: DataFrame, method: str = "historical", confidence: float = CONFIDENCE) -> DataFrame:
    """Loss not exceeded with the given confidence; NULL under 30 bars.

    With its interval: :func:`barweave.operators.bootstrap.var_with_interval`.
    """
    if method not in VAR_METHODS:
        raise ValueError(f"unknown method: {method!r}")
    r = F.col("r")
    point = F.when(F.count(r) >= MIN_OBS, VAR_METHODS[method](r, confidence))
    return returns.groupBy(SERIES).agg(point.alias("var"), F.count(r).alias("n_obs"))


def expected_shortfall(returns: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Mean loss at or below the quantile."""
    return tail_loss(returns, (SERIES,), confidence)


def tail_loss(returns: DataFrame, keys: Sequence[str], confidence: float) -> DataFrame:
    cut = F.percentile("r", F.lit(1 - confidence)).over(Window.partitionBy(*keys))
    tail = returns.where("r IS NOT NULL").withColumn("_cut", cut)
    return tail.groupBy(*keys).agg((-F.avg(F.when(F.col("r") <= F.col("_cut"), F.col("r")))).alias("es"))


def fractional_kelly(returns: DataFrame, fraction: float = 0.25) -> DataFrame:
    return returns.groupBy(SERIES).agg(st.kelly(F.col("r"), fraction).alias("kelly"))


def vol_target_scale(realized: Column, target: float) -> Column:
    """Exposure that moves realised volatility to ``target``; 0 without volatility."""
    return F.when(realized > 0, F.lit(target) / F.when(realized > 0, realized)).otherwise(F.lit(0.0))


def stress_rows(returns: DataFrame, windows: Sequence[tuple[str, str, str]] = STRESS_WINDOWS) -> DataFrame:
    """Each return once per named window that contains its date, both ends inclusive.

    Windows are parameters, so a row meets a constant array instead of a range join.
    """
    spans = F.array(
        *[
            F.struct(
                F.lit(n).alias("window"), F.lit(a).cast("date").alias("lo"), F.lit(b).cast("date").alias("hi")
            )
            for n, a, b in windows
        ]
    )
    inside = F.filter(spans, lambda s: (F.col("date") >= s["lo"]) & (F.col("date") <= s["hi"]))
    return returns.withColumn("_s", F.explode(inside)).withColumn("window", F.col("_s.window")).drop("_s")


def historical_stress(
    returns: DataFrame, windows: Sequence[tuple[str, str, str]] = STRESS_WINDOWS
) -> DataFrame:
    """Total return, Sharpe, worst drawdown and tail loss per window; an empty window has n = 0."""
    keys = (SERIES, "window")
    r = F.col("r")
    rows = stress_rows(returns.where(r.isNotNull()).select(SERIES, "date", "r"), windows)
    rows = with_wealth(rows, keys).withColumn("_cut", F.percentile("r", F.lit(0.05)).over(Window.partitionBy(*keys)))
    measured = rows.groupBy(*keys).agg(
        (F.product(1 + r) - 1).alias("total_return"),
        st.sharpe(r).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        (-F.avg(F.when(r <= F.col("_cut"), r))).alias("es_95"),
        F.count(r).alias("n_obs"),
    )
    every = returns.select(SERIES).distinct().withColumn(
        "window", F.explode(F.array(*[F.lit(n) for n, _, _ in windows]))
    )
    return every.join(measured, list(keys), "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
