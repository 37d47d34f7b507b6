"""Resampling intervals.

A series holds at most one value per calendar date. Its values, as one array, are copied to a
few replicate groups, each drawing its share of the replicates with numpy; the groups of one
series run in parallel and leave one array of numbers per statistic. Draws depend on the seed,
the series and the group alone, so a rerun task repeats them and all statistics share them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.constants import BOOTSTRAP_BLOCK, BOOTSTRAP_REPLICATES, CONFIDENCE, TRADING_DAYS
from barweave.functions.normal import norm_ppf
from barweave.operators import risk
from barweave.operators.metrics import SERIES
from barweave.session import deal, materialise

Statistic = Callable[[np.ndarray], np.ndarray]
PER_GROUP = 250
CHUNK = 200  # arrays of replicates held at once
MIN_OBS = 30


def _sd(x: np.ndarray) -> np.ndarray:
    return x.std(axis=1, ddof=1)


def mean_statistic(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=1)


def sharpe_statistic(x: np.ndarray) -> np.ndarray:
    sd = _sd(x)
    return np.divide(x.mean(axis=1), sd, out=np.full(len(x), np.nan), where=sd > 0) * np.sqrt(TRADING_DAYS)


def var_statistic(method: str, confidence: float = CONFIDENCE) -> Statistic:
    """The value-at-risk estimators over a matrix with one replicate per row."""
    z = norm_ppf(1 - confidence)

    def parametric(x: np.ndarray) -> np.ndarray:
        return -(x.mean(axis=1) + _sd(x) * z)

    def historical(x: np.ndarray) -> np.ndarray:
        at = (x.shape[1] - 1) * (1 - confidence)
        lo = int(at)
        hi = min(lo + 1, x.shape[1] - 1)
        low, high = np.partition(x, (lo, hi), axis=1)[:, (lo, hi)].T
        return -(low + (at - lo) * (high - low))

    def cornish_fisher(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        c = x - x.mean(axis=1, keepdims=True)
        m2 = (c**2).mean(axis=1)
        c2 = c * c  # numpy's general powers cost many times a product
        s = np.sqrt(n * (n - 1)) / (n - 2) * (c2 * c).mean(axis=1) / m2**1.5
        k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((c2 * c2).mean(axis=1) / m2**2 - 3) + 6)
        bent = z + (z**2 - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s**2
        return -(x.mean(axis=1) + _sd(x) * bent)

    methods = {"parametric": parametric, "historical": historical, "cornish_fisher": cornish_fisher}
    if method not in methods:
        raise ValueError(f"unknown method: {method!r}")
    return methods[method]


def independent_draws(rng: np.random.Generator, n: int, rows: int) -> np.ndarray:
    return rng.integers(0, n, size=(rows, n))


def stationary_draws(mean_block: float) -> Callable[[np.random.Generator, int, int], np.ndarray]:
    """Index paths of the stationary bootstrap: geometric blocks that wrap round the end."""

    def draw(rng: np.random.Generator, n: int, rows: int) -> np.ndarray:
        fresh = rng.random((rows, n)) < 1.0 / mean_block
        fresh[:, 0] = True
        starts = rng.integers(0, n, size=(rows, n))
        at = np.arange(n)
        begun = np.maximum.accumulate(np.where(fresh, at, 0), axis=1)
        return (np.take_along_axis(starts, begun, axis=1) + at - begun) % n

    return draw


def _resampled(
    returns: DataFrame,
    statistics: dict[str, Statistic],
    n_boot: int,
    seed: int,
    draws: Callable[[np.random.Generator, int, int], np.ndarray],
) -> DataFrame:
    """(series_id, group, one array per statistic) for every series with enough bars."""
    groups = -(-n_boot // PER_GROUP)
    paths = (
        deal(returns.where("r IS NOT NULL").select(SERIES, "date", "r"), SERIES)
        .groupBy(SERIES)
        .agg(F.array_sort(F.collect_list(F.struct("date", "r"))).alias("_path"))
        .where(F.size("_path") >= MIN_OBS)
        .select(SERIES, F.transform("_path", lambda x: x["r"]).alias("_r"))
    )
    spread = paths.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                out = {name: [] for name in statistics}
                for series, values, group in zip(part[SERIES], part["_r"], part["group"]):
                    x = np.asarray(values, dtype=float)
                    rng = np.random.default_rng([seed, zlib.crc32(str(series).encode()), int(group)])
                    drawn = x[draws(rng, len(x), min(PER_GROUP, n_boot - group * PER_GROUP))]
                    for name, statistic in statistics.items():
                        out[name].append(statistic(drawn))
                yield pd.DataFrame({SERIES: part[SERIES].to_numpy(), "group": part["group"].to_numpy(), **out})

    arrays = ", ".join(f"{name} array<double>" for name in statistics)
    return deal(spread, SERIES, "group").mapInPandas(resample, f"{SERIES} string, group int, {arrays}")


def replicates(
    returns: DataFrame,
    statistic: Statistic,
    n_boot: int = BOOTSTRAP_REPLICATES,
    seed: int = 0,
    draws: Callable[[np.random.Generator, int, int], np.ndarray] = independent_draws,
) -> DataFrame:
    """(series_id, replicate, stat) for every resample of every series with enough bars."""
    found = _resampled(returns, {"stat": statistic}, n_boot, seed, draws)
    each = found.select(SERIES, "group", F.posexplode("stat").alias("_k", "_x"))
    return each.select(
        SERIES, (F.col("group") * PER_GROUP + F.col("_k")).cast("long").alias("replicate"), F.when(~F.isnan("_x"), F.col("_x")).alias("stat")
    )


def _intervals(
    returns: DataFrame,
    statistics: dict[str, Statistic],
    n_boot: int,
    seed: int,
    level: float,
    draws: Callable[[np.random.Generator, int, int], np.ndarray],
) -> DataFrame:
    """(series_id, one struct of ``ci_low``, ``ci_high`` and ``n_boot`` per statistic).

    Linear between ranks, from the sorted array of a series' replicates; undefined ones (NaN) are
    not counted.
    """
    found = deal(_resampled(returns, statistics, n_boot, seed, draws), SERIES)
    tail = (1 - level) / 2
    known = {m: F.filter(F.flatten(F.collect_list(m)), lambda x: ~F.isnan(x)) for m in statistics}
    sets = found.groupBy(SERIES).agg(*[F.array_sort(x).alias(m) for m, x in known.items()])

    def quantile(m: str, q: float) -> Column:
        at = (F.size(m) - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.get(m, low.cast("int")), F.get(m, high.cast("int"))
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    return sets.select(
        SERIES,
        *[
            F.struct(quantile(m, tail).alias("ci_low"), quantile(m, 1 - tail).alias("ci_high"), F.size(m).cast("long").alias("n_boot")).alias(m)
            for m in statistics
        ],
    )


def bootstrap_ci(
    returns: DataFrame,
    statistic: Statistic,
    n_boot: int = BOOTSTRAP_REPLICATES,
    seed: int = 0,
    level: float = 0.95,
    draws: Callable[[np.random.Generator, int, int], np.ndarray] = independent_draws,
) -> DataFrame:
    """Percentile interval of a statistic per series."""
    return _intervals(returns, {"stat": statistic}, n_boot, seed, level, draws).select(SERIES, "stat.*")


def stationary_sharpe_ci(
    returns: DataFrame,
    n_boot: int = BOOTSTRAP_REPLICATES,
    mean_block: float = BOOTSTRAP_BLOCK,
    seed: int = 0,
    level: float = 0.95,
) -> DataFrame:
    """Interval of the annual Sharpe ratio that keeps short-run dependence."""
    return bootstrap_ci(returns, sharpe_statistic, n_boot, seed, level, stationary_draws(mean_block))


def var_with_interval(
    returns: DataFrame,
    methods: tuple[str, ...] = tuple(risk.VAR_METHODS),
    n_boot: int = BOOTSTRAP_REPLICATES,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Value at risk and its bootstrap interval, one row per series and method."""
    statistics = {m: var_statistic(m, confidence) for m in methods}
    found = materialise(_intervals(returns, statistics, n_boot, 0, 0.95, independent_draws))
    parts = [
        risk.value_at_risk(returns, m, confidence)
        .join(found.select(SERIES, f"{m}.*"), SERIES, "left")
        .withColumn("method", F.lit(m))
        for m in methods
    ]
    return reduce(DataFrame.unionByName, parts)
