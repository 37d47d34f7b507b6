"""A random one-factor price panel for tests and demonstrations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.constants import TRADING_DAYS
from barweave.functions.rolling import cumulative


def _uniform(*parts: Column) -> Column:
    """A uniform in (0, 1) that depends only on its arguments, not on the partitioning."""
    h = F.xxhash64(*parts)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(2**52)


def _normal(*parts: Column) -> Column:
    u, v = _uniform(*parts, F.lit("u")), _uniform(*parts, F.lit("v"))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


def synthetic_panel(
    spark: SparkSession,
    n_tickers: int = 10,
    n_days: int = 5 * TRADING_DAYS,
    start: str = "2018-01-02",
    *,
    seed: int = 1729,
    mu_annual: float = 0.08,
    sigma_annual: float = 0.20,
    factor_loading_dispersion: float = 0.30,
    factor_sigma_annual: float = 0.15,
) -> DataFrame:
    """Prices from ``r = beta f + e`` on business days, with an open-high-low-close envelope.

    Every draw is a hash of (seed, purpose, ticker, day), so the panel is the same under any
    partitioning. Each ticker carries its own calendar: no cross join.
    """
    dt = 1.0 / TRADING_DAYS
    sigma, f_sigma = sigma_annual * math.sqrt(dt), factor_sigma_annual * math.sqrt(dt)
    s = F.lit(seed)
    first = F.lit(start).cast("date")
    span = F.sequence(first, F.date_add(first, (n_days * 7) // 5 + 7))
    weekdays = F.slice(F.filter(span, lambda d: F.weekday(d) < 5), 1, n_days)
    df = (
        spark.range(n_tickers)
        .select(
            F.format_string("SYN%03d", "id").alias("ticker"),
            (1.0 + factor_loading_dispersion * _normal(s, F.lit("beta"), F.col("id"))).alias("beta"),
            F.col("id"),
            F.posexplode(weekdays).alias("t", "date"),
        )
    )
    k, t = F.col("id"), F.col("t")
    factor = mu_annual * dt + f_sigma * _normal(s, F.lit("factor"), t)
    df = df.withColumn("r", F.col("beta") * factor + sigma * _normal(s, F.lit("idio"), k, t))
    df = df.withColumn("close", 100.0 * F.exp(F.sum("r").over(cumulative())))
    c = F.col("close")
    open_ = c * (1.0 + sigma / 2.0 * _normal(s, F.lit("open"), k, t))
    up = c + F.abs(sigma * c * _normal(s, F.lit("high"), k, t))
    down = c - F.abs(sigma * c * _normal(s, F.lit("low"), k, t))
    volume = 500_000 + F.floor(_uniform(s, F.lit("volume"), k, t) * 2_000_000)
    return df.select(
        "date",
        "ticker",
        open_.alias("open"),
        F.greatest(up, open_, c).alias("high"),
        F.least(down, open_, c).alias("low"),
        c.alias("close"),
        c.alias("adj_close"),
        volume.cast("double").alias("volume"),
    )
