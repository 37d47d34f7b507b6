"""Information coefficient: rank correlation of scores with forward returns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions.normal import t_two_sided_column
from barweave.operators.cross_section import average_rank
from barweave.session import materialise

MIN_OBS = 30


def rank_pairs(df: DataFrame, score: str = "score", fwd: str = "fwd_ret") -> DataFrame:
    """Average ranks of both columns over all stacked (date, ticker) rows."""
    rows = df.where(F.col(score).isNotNull() & F.col(fwd).isNotNull()).select("date", "ticker", score, fwd)
    rows = materialise(rows)
    return average_rank(average_rank(rows, score, (), "rank_s").drop("n_ranked"), fwd, (), "rank_r")


def information_coefficient(df: DataFrame, score: str = "score", fwd: str = "fwd_ret") -> DataFrame:
    """One row: Spearman correlation, its t statistic, p-value and row count; NULL under 30."""
    n = F.count(F.lit(1))
    ic = F.when(n >= MIN_OBS, F.corr("rank_s", "rank_r"))
    out = rank_pairs(df, score, fwd).agg(ic.alias("ic"), n.alias("n_obs"))
    t = F.col("ic") * F.sqrt(F.try_divide(F.col("n_obs") - 2, 1 - F.col("ic") * F.col("ic")))
    out = out.withColumn("t_stat", t)
    return out.withColumn("p_value", t_two_sided_column("t_stat", (F.col("n_obs") - 2).cast("double")))


#: Cumulative Poisson(1) probabilities for 0, 1, 2, ... events, to double precision.
POISSON_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])


def ic_bootstrap(df: DataFrame, n_bootstrap: int = 500, seed: int = 0, score: str = "score", fwd: str = "fwd_ret") -> DataFrame:
    """95% interval of the IC over all rows, however many.

    Each row enters each replicate a Poisson(1) number of times, drawn from a hash of the
    row, so no row is collected and a rerun task repeats its draws. A partition adds up six
    weighted moments per replicate; ranks stay those of the full sample.
    """
    # Ranks over the row count keep the moments near one; correlation ignores the scale.
    scale = rank_pairs(df, score, fwd).select(
        F.xxhash64("date", "ticker", F.lit(seed)).alias("h"),
        (F.col("rank_s") / F.col("n_ranked")).alias("x"),
        (F.col("rank_r") / F.col("n_ranked")).alias("y"),
    )
    salt = np.random.default_rng(seed).integers(0, 2**63, size=n_bootstrap, dtype=np.uint64)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_bootstrap, 6))
        for pdf in batches:
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            parts = np.column_stack([np.ones(len(x)), x, y, x * x, y * y, x * y])
            h = pdf["h"].to_numpy().astype(np.uint64)
            for b in range(n_bootstrap):
                v = h ^ salt[b]
                v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                v = (v ^ (v >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
                u = ((v ^ (v >> np.uint64(33))) >> np.uint64(11)).astype(float) / 2.0**53
                total[b] += np.searchsorted(POISSON_CDF, u) @ parts
        yield pd.DataFrame(total, columns=list("wxypqr")).assign(b=np.arange(n_bootstrap))

    sums = (
        scale.mapInPandas(moments, "w double, x double, y double, p double, q double, r double, b long")
        .groupBy("b")
        .agg(*[F.sum(c).alias(c) for c in "wxypqr"])
    )
    w, x, y, p, q, r = (F.col(c) for c in "wxypqr")
    var = (p / w - (x / w) ** 2) * (q / w - (y / w) ** 2)
    ic = F.when((w > 0) & (var > 0), (r / w - x / w * y / w) / F.sqrt(var))
    return sums.agg(
        F.percentile(ic, F.lit(0.025)).alias("ci_low"),
        F.percentile(ic, F.lit(0.975)).alias("ci_high"),
        F.count(ic).alias("n_boot"),
    )
