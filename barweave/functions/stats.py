"""Aggregate columns over one series of per-bar returns; use inside ``groupBy().agg()``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barweave.constants import TRADING_DAYS
from barweave.functions.columns import ratio


def n_obs(r: Column) -> Column:
    return F.count(r)


def annual_return(r: Column, periods: int = TRADING_DAYS) -> Column:
    """Geometric; NULL when the capital is wiped out."""
    grown = F.product(1 + r)
    return F.when(grown > 0, F.pow(grown, F.lit(float(periods)) / F.count(r)) - 1)


def annual_vol(r: Column, periods: int = TRADING_DAYS) -> Column:
    return F.stddev_samp(r) * math.sqrt(periods)


def sharpe(r: Column, rf: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    """NULL when the deviation is noise beside the mean."""
    mean, sd = F.avg(r) - rf, F.stddev_samp(r)
    floor = F.greatest(F.lit(1e-15), F.abs(mean) * 1e-12)
    return F.when(sd >= floor, ratio(mean, sd) * math.sqrt(periods))


def sortino(r: Column, rf: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    """Downside deviation over all bars, gains counted as zero."""
    down = F.sqrt(F.avg(F.pow(F.least(r - rf, F.lit(0.0)), 2)))
    return ratio(F.avg(r) - rf, down) * math.sqrt(periods)


def hit_rate(r: Column) -> Column:
    return F.avg(F.when(r.isNotNull(), (r > 0).cast("double")))


def omega(r: Column, threshold: float = 0.0) -> Column:
    """Gains over losses around ``threshold``; NULL without losses."""
    x = r - threshold
    gain = F.sum(F.when(x > 0, x).when(x.isNotNull(), 0.0))
    loss = -F.sum(F.when(x < 0, x).when(x.isNotNull(), 0.0))
    return ratio(gain, loss)


def profit_factor(r: Column) -> Column:
    return omega(r, 0.0)


def skew_unbiased(r: Column) -> Column:
    n = F.count(r).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(r))


def kurt_unbiased(r: Column) -> Column:
    """Sample-corrected excess kurtosis."""
    n = F.count(r).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6))


def kelly(r: Column, fraction: float = 0.25, periods: int = TRADING_DAYS) -> Column:
    mu, var = F.avg(r) * periods, F.var_samp(r) * periods
    return F.when((F.count(r) >= 30) & (var > 0), ratio(fraction * mu, var))


def _psr_spread(r: Column, raw_kurtosis: bool) -> Column:
    sr = sharpe(r, periods=1)
    k = kurt_unbiased(r) + (3.0 if raw_kurtosis else 0.0)
    return 1 - skew_unbiased(r) * sr + (k - 1) / 4 * sr * sr


def psr_z(r: Column, benchmark_sr: float = 0.0, periods: int = TRADING_DAYS, raw_kurtosis: bool = False) -> Column:
    """z of the probabilistic Sharpe ratio.

    The kurtosis term is the excess one, as in the reference; ``raw_kurtosis`` gives the
    published form.
    """
    lead = sharpe(r, periods=1) - benchmark_sr / math.sqrt(periods)
    return lead * math.sqrt(periods) * psr_slope(r, periods, raw_kurtosis)


def psr_slope(r: Column, periods: int = TRADING_DAYS, raw_kurtosis: bool = False) -> Column:
    """What :func:`psr_z` loses for each unit of the annual benchmark Sharpe ratio."""
    spread = _psr_spread(r, raw_kurtosis)
    scale = F.sqrt(F.count(r).cast("double") - 1) / math.sqrt(periods)
    return F.when((F.count(r) >= 4) & (spread > 0), scale / F.sqrt(F.when(spread > 0, spread)))
