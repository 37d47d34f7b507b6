"""Signals: score tables (date, ticker, score) for all decision dates at once.

Per-bar statistics are windows over each ticker's own history; ``dates`` then picks each
ticker's last row at every decision date. Without ``dates`` each bar's own date decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.constants import TRADING_DAYS
from barweave.functions.columns import finite, ratio
from barweave.functions.rolling import rolling, trailing
from barweave.operators.calendar import asof_last, in_windows
from barweave.operators.cross_section import first_rank, to_gross, with_group
from barweave.operators.features import bar_number, log_ret, momentum_expr
from barweave.session import deal, materialise


def decide(per_bar: DataFrame, dates: DataFrame | None, calendar: DataFrame | None = None) -> DataFrame:
    """Per-bar values at each decision date, using each ticker's last bar."""
    return per_bar if dates is None else asof_last(per_bar, dates, calendar)


def tsmom(
    panel: DataFrame,
    dates: DataFrame | None = None,
    lookback: int = TRADING_DAYS,
    skip: int = 21,
    vol_window: int = 63,
    target_vol: float = 0.10,
) -> DataFrame:
    """Sign of momentum scaled to a target volatility."""
    per_bar = (
        deal(panel.select("date", "ticker", "adj_close"), "ticker")
        .withColumns({"_mom": momentum_expr(lookback, skip), "_r": log_ret(), "_n": bar_number()})
        .withColumn("_sd", rolling(F.stddev_samp, vol_window, F.col("_r")))
        .select("date", "ticker", "_mom", "_sd", "_n")
    )
    usable = (F.col("_n") >= lookback + skip + vol_window) & (F.col("_sd") > 0) & finite(F.col("_mom"))
    size = target_vol / (F.col("_sd") * math.sqrt(TRADING_DAYS))
    return (
        decide(per_bar, dates, panel)
        .where(usable)
        .select("date", "ticker", (F.signum("_mom") * size).alias("score"))
    )


def _momentum_at(panel: DataFrame, dates: DataFrame | None, lookback: int, skip: int) -> DataFrame:
    per_bar = (
        deal(panel.select("date", "ticker", "adj_close"), "ticker")
        .withColumns({"_mom": momentum_expr(lookback, skip), "_n": bar_number()})
        .select("date", "ticker", "_mom", "_n")
    )
    enough = F.col("_n") >= lookback + skip + 1
    return decide(per_bar, dates, panel).where(enough & finite(F.col("_mom")))


def xsmom(
    panel: DataFrame,
    dates: DataFrame | None = None,
    lookback: int = TRADING_DAYS,
    skip: int = 21,
    decile: float = 0.10,
) -> DataFrame:
    """Long the top and short the bottom fraction by momentum, equal weights per leg.

    With one name the short leg overrides the long one.
    """
    if not 0 < decile < 0.5:
        raise ValueError("decile must be in (0, 0.5)")
    at = materialise(_momentum_at(panel, dates, lookback, skip).select("date", "ticker", "_mom"))
    ranked = first_rank(at, "_mom", "ticker", "date", "_rank")
    leg = F.greatest(F.lit(1), F.floor(F.lit(decile) * F.col("n_ranked")))
    score = (
        F.when(F.col("_rank") <= leg, -1.0 / leg)
        .when(F.col("_rank") > F.col("n_ranked") - leg, 1.0 / leg)
        .otherwise(F.lit(0.0))
    )
    return ranked.select("date", "ticker", score.alias("score"))


def carry(
    panel: DataFrame, dates: DataFrame | None = None, lookback: int = TRADING_DAYS, skip: int = 21
) -> DataFrame:
    """tanh of momentum, scaled to unit gross: a price-only carry proxy."""
    at = _momentum_at(panel, dates, lookback, skip)
    return to_gross(at.select("date", "ticker", F.tanh("_mom").alias("score")))


def quality(
    panel: DataFrame,
    dates: DataFrame | None = None,
    lookback: int = TRADING_DAYS,
    weights: tuple[float, float, float] = (0.5, 0.25, 0.25),
    reward_low_drawdown: bool = False,
) -> DataFrame:
    """Blend of standardised trailing Sharpe, low volatility and drawdown.

    Kept as the reference has it: log returns compound as if simple, and a deeper
    drawdown scores higher. ``reward_low_drawdown`` turns the last sign round.
    """
    base = deal(panel.select("date", "ticker", "adj_close"), "ticker").withColumns({"_r": log_ret(), "_n": bar_number()})
    measures = {
        "_mean": F.avg("_r"),
        "_vol": F.stddev_samp("_r"),
        "_path": F.collect_list(F.struct("date", "_r")),
    }
    if dates is None:
        w = trailing(lookback)
        at = base.withColumns({k: v.over(w) for k, v in measures.items()})
    else:
        # Only the bars of decision windows are gathered, one array per decision and name.
        windows = in_windows(base.select("date", "ticker", "_r", "_n"), dates, lookback, calendar=panel)
        at = (
            windows.groupBy("asof", "ticker")
            .agg(F.max("_n").alias("_n"), *[v.alias(k) for k, v in measures.items()])
            .withColumnRenamed("asof", "date")
        )
    yearly = {"_mean": F.col("_mean") * TRADING_DAYS, "_vol": F.col("_vol") * math.sqrt(TRADING_DAYS)}
    at = at.withColumns(yearly).where((F.col("_n") >= lookback + 1) & (F.col("_vol") > 0))
    raw = at.select(
        "date",
        "ticker",
        (F.col("_mean") / F.col("_vol")).alias("_sharpe"),
        "_vol",
        _path_drawdown(F.transform(F.array_sort("_path"), lambda x: x["_r"])).alias("_dd"),
    )
    stats = {}
    for c in ("_sharpe", "_vol", "_dd"):
        stats[f"{c}_m"], stats[f"{c}_s"] = F.avg(c), F.stddev_pop(c)
    withstats = with_group(materialise(raw), ["date"], stats)

    def z(c: str) -> Column:
        return ratio(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s"))

    w1, w2, w3 = weights
    dd_sign = 1.0 if reward_low_drawdown else -1.0
    blend = w1 * z("_sharpe") - w2 * z("_vol") + dd_sign * w3 * z("_dd")
    # Of two names the three parts may cancel: what is left is rounding, not a score.
    score = F.when(F.abs(blend) >= 1e-12, blend).otherwise(F.lit(0.0))
    return to_gross(withstats.select("date", "ticker", score.alias("score")))


def _path_drawdown(returns: Column) -> Column:
    """Worst wealth over running peak, minus one, along an array of returns."""
    start = F.struct(F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc: Column, x: Column) -> Column:
        wealth = acc["w"] * (1 + x)
        peak = F.greatest(acc["peak"], wealth)  # greatest skips the NULL start
        return F.struct(
            wealth.alias("w"), peak.alias("peak"), F.least(acc["dd"], F.try_divide(wealth, peak) - 1).alias("dd")
        )

    return F.aggregate(returns, start, step, lambda acc: acc["dd"])


def ou_windows(panel: DataFrame, market: DataFrame, dates: DataFrame, window: int) -> DataFrame:
    """Log prices of each ticker beside the market's for every decision window.

    Each side contributes its own last ``window`` bars; only common dates remain.
    """
    t = panel.select("date", "ticker", F.ln("adj_close").alias("y"), bar_number().alias("_n"))
    m = market.select("date", "ticker", F.ln("adj_close").alias("x"), bar_number().alias("_n"))
    tw = in_windows(t, dates, window)
    enough = F.max("_n").over(Window.partitionBy("ticker", "asof"))
    tw = tw.withColumn("_seen", enough).where(F.col("_seen") >= window + 2).select("asof", "date", "ticker", "y")
    mw = in_windows(m, dates, window).select("asof", "date", "x")
    return tw.join(mw, ["asof", "date"])


def ou_fit(df: DataFrame, keys: tuple[str, ...], resid: str = "resid", order: str = "date") -> DataFrame:
    """Per group: AR(1) fit of the residual as an Ornstein-Uhlenbeck process.

    theta, mu and sigma are NULL unless the slope lies strictly between 0 and 1.
    """
    by = Window.partitionBy(*keys)
    step = df.withColumn("_x", F.lag(resid).over(by.orderBy(order)))
    y, x = F.col(resid), F.col("_x")
    step = step.withColumns(
        {"_b": F.regr_slope(y, x).over(by), "_a": F.regr_intercept(y, x).over(by)}
    ).withColumn("_e", y - (F.col("_b") * x + F.col("_a")))
    fit = step.groupBy(*keys).agg(
        F.first("_b").alias("b"),
        F.first("_a").alias("a"),
        F.stddev_samp("_e").alias("_se"),
        F.max_by(resid, order).alias("last"),
    )
    ok = (F.col("b") > 0) & (F.col("b") < 1)
    theta = F.when(ok, -F.ln("b"))
    return fit.select(
        *keys,
        theta.alias("theta"),
        F.when(ok, F.col("a") / (1 - F.col("b"))).alias("mu"),
        F.when(ok, F.col("_se") * F.sqrt(2 * theta / (1 - F.col("b") * F.col("b")))).alias("sigma"),
        "last",
    )


def ou_residuals(panel: DataFrame, market: DataFrame, dates: DataFrame, window: int = 63) -> DataFrame:
    """Residual of log price on log market in every (decision date, ticker) window."""
    w = Window.partitionBy("asof", "ticker")
    both = ou_windows(panel, market, dates, window).withColumns(
        {
            "_k": F.count(F.lit(1)).over(w),
            "_b": F.regr_slope("y", "x").over(w),
            "_a": F.regr_intercept("y", "x").over(w),
        }
    )
    both = both.where(F.col("_k") >= window // 2)
    return both.select(
        "asof", "ticker", "date", (F.col("y") - (F.col("_b") * F.col("x") + F.col("_a"))).alias("resid")
    )


def ou_mean_reversion(
    panel: DataFrame,
    market: DataFrame,
    dates: DataFrame,
    window: int = 63,
    entry_z: float = 2.0,
    exit_z: float = 0.5,
    max_half_life: float = 30.0,
) -> DataFrame:
    """Short rich and long cheap residuals, each leg scaled to one half.

    Names between the exit and entry levels have no row; names inside the exit level score 0.
    The market series is passed apart, so it need not be among the traded names.
    """
    fit = ou_fit(ou_residuals(panel, market, dates, window), ("asof", "ticker"))
    sd = F.col("sigma") / F.sqrt(2 * F.col("theta"))
    z = F.when(sd > 0, (F.col("last") - F.col("mu")) / sd)
    scored = (
        fit.where((F.col("theta") > 0) & (math.log(2.0) / F.col("theta") <= max_half_life))
        .withColumn("_z", z)
        .select(
            F.col("asof").alias("date"),
            "ticker",
            F.when(F.col("_z") > entry_z, -1.0)
            .when(F.col("_z") < -entry_z, 1.0)
            .when(F.abs("_z") < exit_z, 0.0)
            .alias("_s"),
        )
        .where("_s IS NOT NULL")
    )
    legs = with_group(
        materialise(scored),
        ["date"],
        {"_long": F.count(F.when(F.col("_s") > 0, 1)), "_short": F.count(F.when(F.col("_s") < 0, 1))},
    )
    share = (
        F.when(F.col("_s") > 0, F.col("_s") / F.col("_long") / 2)
        .when(F.col("_s") < 0, F.col("_s") / F.col("_short") / 2)
        .otherwise(F.lit(0.0))
    )
    return legs.select("date", "ticker", share.alias("score"))


def half_life(df: DataFrame, keys: tuple[str, ...], resid: str = "resid", order: str = "date") -> DataFrame:
    """Mean-reversion half-life per group from the change on the lagged level.

    Infinite when the slope is not negative.
    """
    x = F.lag(resid).over(Window.partitionBy(*keys).orderBy(order))
    slope = F.regr_slope(F.col("_d"), F.col("_x"))
    step = df.withColumn("_x", x).withColumn("_d", F.col(resid) - F.col("_x"))
    return (
        step.groupBy(*keys)
        .agg(slope.alias("_s"))
        .select(
            *keys,
            F.when(F.col("_s") < 0, -math.log(2.0) / F.col("_s")).otherwise(F.lit(float("inf"))).alias("half_life"),
        )
    )


def blend(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """Weighted sum of score tables; a name missing from one counts as zero there."""
    if not parts:
        raise ValueError("no signals to blend")
    stacked = None
    for w, s in parts:
        one = s.select("date", "ticker", (F.lit(float(w)) * F.col("score")).alias("score"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy("date", "ticker").agg(F.sum("score").alias("score"))
