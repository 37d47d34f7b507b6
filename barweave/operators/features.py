"""Time-series features. Each function adds one column to a long panel.

All windows share the partitioning (ticker) and the order (date), so a chain of these
functions costs one shuffle and one sort however many features it adds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.constants import TRADING_DAYS
from barweave.functions.columns import clip, positive, ratio
from barweave.functions.rolling import cumulative, lag, ordered, rolling
from barweave.operators.sliding import sliding

VOL_METHODS = ("close_to_close", "parkinson", "garman_klass", "yang_zhang")
LN2 = math.log(2.0)


def log_ret(price: str = "adj_close", by: str = "ticker") -> Column:
    """ln(p_t / p_{t-1}) as an expression."""
    return F.ln(ratio(F.col(price), lag(F.col(price), 1, by)))


def simple_ret(price: str = "adj_close", by: str = "ticker") -> Column:
    """p_t / p_{t-1} - 1 as an expression."""
    return ratio(F.col(price), lag(F.col(price), 1, by)) - 1


def log_returns(panel: DataFrame, price: str = "adj_close", fill_na: bool = False) -> DataFrame:
    """Log returns; a non-positive price fails the job. ``fill_na`` drops the leading NULL."""
    checked = panel.withColumn(price, positive(F.col(price), price))
    out = checked.withColumn("log_ret", log_ret(price))
    return out.where(F.col("log_ret").isNotNull()) if fill_na else out


def simple_returns(panel: DataFrame, price: str = "adj_close", fill_na: bool = False) -> DataFrame:
    out = panel.withColumn("ret", simple_ret(price))
    return out.where(F.col("ret").isNotNull()) if fill_na else out


def cumulative_returns(
    df: DataFrame, ret: str = "ret", compounding: str = "geometric", by: str = "ticker"
) -> DataFrame:
    """Running growth of each series; a NULL return stays NULL and is skipped."""
    w = cumulative(by)
    if compounding == "geometric":
        grown = F.product(1 + F.col(ret)).over(w) - 1
    elif compounding == "additive":
        grown = F.sum(ret).over(w)
    else:
        raise ValueError(f"unknown compounding mode: {compounding!r}")
    return df.withColumn("cum_ret", F.when(F.col(ret).isNotNull(), grown))


def rebuild_prices(df: DataFrame, log_ret_col: str = "log_ret", base: float = 1.0) -> DataFrame:
    """Price path ``base * exp(running sum of log returns)``."""
    if abs(base) < 1e-12:
        raise ValueError("base must be non-zero")
    path = F.lit(base) * F.exp(F.sum(log_ret_col).over(cumulative()))
    return df.withColumn("rebuilt", F.when(F.col(log_ret_col).isNotNull(), path))


def annualise_vol(vol: Column, periods: int = TRADING_DAYS) -> Column:
    """Per-bar volatility to annual; a negative input fails the job."""
    bad = F.raise_error(F.lit("volatility must be non-negative")).cast("double")
    return F.when(vol < 0, bad).otherwise(vol * math.sqrt(periods))


def ffd_weights(d: float, thresh: float) -> list[float]:
    """Binomial weights of (1 - L)^d, newest first, cut at the first below ``thresh``."""
    out = [1.0]
    for k in range(1, 10_001):
        nxt = out[-1] * (k - 1 - d) / k
        if abs(nxt) < thresh:
            break
        out.append(nxt)
    return out


def frac_diff(
    df: DataFrame, value: str, d: float, thresh: float = 1e-4, out: str = "frac_diff"
) -> DataFrame:
    """Fixed-width fractional difference; NULL until the whole filter fits.

    Short filters are a sum of lags inside the window operator. Long ones are a dot product
    per bar over each ticker's history, as a moving frame would copy the whole filter's values
    for every bar.
    """
    if not 0.0 <= d <= 1.0:
        raise ValueError("d must be in [0, 1]")
    weights = ffd_weights(d, thresh)
    x = F.col(value)
    if len(weights) <= 64:
        terms = [F.lit(w) * lag(x, k) for k, w in enumerate(weights)]
        filtered = terms[0]
        for t in terms[1:]:
            filtered = filtered + t
        return df.withColumn(out, filtered)
    return over_histories(df, {out: (value, len(weights), _dots(weights))})


def over_histories(
    df: DataFrame, added: Mapping[str, tuple[str, int, Callable[[np.ndarray], np.ndarray]]]
) -> DataFrame:
    """Add columns ``{name: (value, n, stat)}`` over the last ``n`` bars, NULL until all ``n`` values are present.

    ``stat`` takes a ticker's values by date, ``n`` or more, and gives one result per full window. The
    bars are handed over once for all columns; a moving frame would update ``n`` values for every bar.
    """
    kept = [c for c in df.columns if c not in added]
    names = list(added)

    def extended(bars: pa.Table) -> pa.Table:
        bars = bars.sort_by("date")
        out = bars.select(kept)
        for name, (value, n, stat) in added.items():
            x = bars[value].cast(pa.float64())
            found, missing = np.zeros(len(x)), np.ones(len(x), bool)
            if len(x) >= n:
                gaps = np.r_[0, np.cumsum(x.is_null().to_numpy())]
                found[n - 1 :] = stat(x.fill_null(0.0).to_numpy())
                missing[n - 1 :] = gaps[n:] > gaps[:-n]
            out = out.append_column(name, pa.array(found, mask=missing))
        return out

    schema = df.select(*kept, *[F.lit(None).cast("double").alias(c) for c in names]).schema
    return df.groupBy("ticker").applyInArrow(extended, schema)


def _dots(weights: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.convolve(x, weights, "valid")


def _spread(n: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: sliding_window_view(x, n).std(axis=1, ddof=1)


def _mean(n: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: sliding_window_view(x, n).mean(axis=1)


def momentum_expr(lookback: int, skip: int = 0, price: str = "adj_close") -> Column:
    if lookback <= 0:
        raise ValueError("lookback must be positive")
    if skip < 0:
        raise ValueError("skip must be non-negative")
    p = F.col(price)
    return ratio(lag(p, skip), lag(p, skip + lookback)) - 1


def momentum(panel: DataFrame, lookback: int, skip: int = 0, out: str = "mom") -> DataFrame:
    return panel.withColumn(out, momentum_expr(lookback, skip))


def realized_vol(
    panel: DataFrame, window: int = 21, method: str = "close_to_close", out: str = "vol"
) -> DataFrame:
    """Per-bar volatility from the named range estimator over the last ``window`` bars."""
    if method not in VOL_METHODS:
        raise ValueError(f"unknown method: {method!r}")
    if method == "close_to_close":
        step = panel.withColumn("_r", log_ret())
        return step.withColumn(out, rolling(F.stddev_samp, window, F.col("_r"))).drop("_r")
    o, h, low, c = (
        positive(F.col(n), n) for n in ("open", "high", "low", "adj_close")
    )
    if method == "parkinson":
        hl2 = F.pow(F.ln(h / low), 2)
        step = panel.withColumn("_x", hl2)
        return step.withColumn(out, F.sqrt(rolling(F.avg, window, F.col("_x")) / (4 * LN2))).drop("_x")
    if method == "garman_klass":
        x = 0.5 * F.pow(F.ln(h / low), 2) - (2 * LN2 - 1) * F.pow(F.ln(c / o), 2)
        step = panel.withColumn("_x", x)
        return step.withColumn(out, F.sqrt(clip(rolling(F.avg, window, F.col("_x")), lo=0.0))).drop("_x")
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    step = panel.withColumns(
        {
            "_overnight": F.ln(o / lag(F.col("adj_close"), 1)),
            "_intraday": F.ln(c / o),
            "_rs": F.ln(h / c) * F.ln(h / o) + F.ln(low / c) * F.ln(low / o),
        }
    )
    var = (
        rolling(F.var_samp, window, F.col("_overnight"))
        + k * rolling(F.var_samp, window, F.col("_intraday"))
        + (1 - k) * rolling(F.avg, window, F.col("_rs"))
    )
    return step.withColumn(out, F.sqrt(clip(var, lo=0.0))).drop("_overnight", "_intraday", "_rs")


def amihud(df: DataFrame, ret: str, dollar_volume: str, window: int = 21, out: str = "amihud") -> DataFrame:
    """Mean absolute return per unit of dollar volume; zero volume counts as missing."""
    step = df.withColumn("_x", ratio(F.abs(F.col(ret)), F.col(dollar_volume)))
    return step.withColumn(out, rolling(F.avg, window, F.col("_x"))).drop("_x")


def roll_spread(panel: DataFrame, price: str = "close", window: int = 21) -> DataFrame:
    """Twice the root of the negated serial covariance of price changes, else zero."""
    step = panel.withColumn("_dp", F.col(price) - lag(F.col(price), 1))
    step = step.withColumn("_dp1", lag(F.col("_dp"), 1))
    cov = rolling(F.covar_samp, window, F.col("_dp"), F.col("_dp1"))
    return step.withColumn("spread", 2 * F.sqrt(clip(-cov, lo=0.0))).drop("_dp", "_dp1")


def kyle_lambda(df: DataFrame, ret: str, signed_volume: str, window: int = 21) -> DataFrame:
    """Rolling through-origin slope of return on signed dollar volume.

    The window counts bars where both inputs are present, and the result sits on the
    true date of its last bar.
    """
    r, v = F.col(ret), F.col(signed_volume)
    step = df.withColumn("_ok", r.isNotNull() & v.isNotNull())
    w = Window.partitionBy("ticker", "_ok").orderBy("date").rowsBetween(-(window - 1), 0)
    slope = ratio(F.sum(r * v).over(w), F.sum(v * v).over(w))
    full = F.col("_ok") & (F.count(F.lit(1)).over(w) == window)
    return step.withColumn("kyle", F.when(full, slope)).drop("_ok")


def signed_dollar_volume(panel: DataFrame, ret: str = "ret") -> DataFrame:
    """Dollar volume signed by the direction of the bar's return."""
    return panel.withColumn(
        "signed_volume", F.signum(F.col(ret)) * F.col("volume") * F.col("adj_close")
    )


def dist_high(panel: DataFrame, window: int = TRADING_DAYS, out: str = "dist_high") -> DataFrame:
    """Price relative to its rolling high, minus one."""
    price = F.col("adj_close")
    found = sliding(panel, window, moments={"_h": price}, maxima={"_high": price})
    full = F.when(F.col("_h_n") == window, F.col("_high"))
    return found.select(*[c for c in panel.columns if c != out], (ratio(price, full) - 1).alias(out))


FEATURES = (
    "mom_5", "mom_21", "mom_63", "mom_252", "vol_21", "vol_63", "fd_lp", "amihud_21", "dist_52w_high",
)


def feature_frame(panel: DataFrame, thresh: float = 1e-4, min_bars: int = 260) -> DataFrame:
    """The nine model features for every bar of every ticker with enough history."""
    size = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    df = panel.select("date", "ticker", "adj_close", "volume").withColumn("_bars", size)
    df = df.where(F.col("_bars") >= min_bars).withColumns(
        {f"mom_{n}": momentum_expr(n) for n in (5, 21, 63, 252)}
        | {
            "_r": log_ret(),
            "_lp": F.ln("adj_close"),
            "_x": ratio(F.abs(F.coalesce(simple_ret(), F.lit(0.0))), F.col("adj_close") * F.col("volume")),
        }
    )
    df = df.drop("volume", "_bars")
    weights = ffd_weights(0.4, thresh)
    windows = {
        "vol_21": ("_r", 21, _spread(21)),
        "vol_63": ("_r", 63, _spread(63)),
        "fd_lp": ("_lp", len(weights), _dots(weights)),
        "amihud_21": ("_x", 21, _mean(21)),
        "_high": ("adj_close", 252, lambda x: sliding_window_view(x, 252).max(axis=1)),
    }
    found = over_histories(df, windows).withColumn("dist_52w_high", ratio(F.col("adj_close"), F.col("_high")) - 1)
    return found.select("date", "ticker", *FEATURES)


def first_complete(thresh: float = 1e-4) -> int:
    """The number of the first bar of a history that can have all of :func:`feature_frame`'s features."""
    return max(252 + 1, len(ffd_weights(0.4, thresh)))


def bar_number(by: str = "ticker") -> Column:
    """1-based position of a bar in its own history."""
    return F.row_number().over(ordered(by))
