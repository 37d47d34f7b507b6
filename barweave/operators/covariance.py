"""Pairwise statistics over names, computed block by block.

A pair statistic needs each pair of names once. Names are hashed into blocks and every
block's rows are sent to the tasks of the block pairs it belongs to: a row is copied once
per block, not once per partner, and a task holds two blocks of at most
``window x names per block`` numbers. Rows for pairs exist only where they are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.columns import ratio
from barweave.operators.cross_section import with_group

NAMES_PER_BLOCK = 256


def block_count(df: DataFrame, per_block: int = NAMES_PER_BLOCK) -> int:
    """How many blocks the measured number of names needs."""
    names = df.select("ticker").distinct().count()
    return max(1, math.ceil(names / per_block))


def into_block_pairs(df: DataFrame, blocks: int) -> DataFrame:
    """Add ``bi <= bj`` and ``side``: each row goes to every block pair its block is in."""
    mine = F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return (
        df.withColumn("_mine", mine)
        .withColumn("_other", other)
        .withColumns({"bi": F.least("_mine", "_other"), "bj": F.greatest("_mine", "_other")})
        .withColumn("own", F.col("_mine"))
        .drop("_mine", "_other")
    )


def wide_block(pdf: pd.DataFrame, block: int, value: str, dates: pd.Index) -> pd.DataFrame:
    """One block's rows as a dates x names matrix."""
    one = pdf[pdf["own"] == block]
    return one.pivot(index="date", columns="ticker", values=value).reindex(dates)


def complete_cases(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on dates where every name of the group has a value."""
    rows = df.where(F.col("r").isNotNull())
    names = rows.select(*keys, "ticker").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_names"))
    dated = rows.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_present"))
    full = dated.join(names, keys).where("_present = _names").select(*keys, "date")
    return rows.join(full, [*keys, "date"])


def pair_cov(df: DataFrame, blocks: int | None = None) -> DataFrame:
    """Sample covariance of every pair of names per ``asof``.

    Input ``(asof, date, ticker, r)`` on complete dates; output ``(asof, a, b, cov, n_obs)``
    with ``a <= b``.
    """
    blocks = blocks or block_count(df)
    schema = "asof date, a string, b string, cov double, n_obs long"

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asof, bi, bj = key
        dates = pd.Index(sorted(pdf["date"].unique()))
        left = wide_block(pdf, bi, "r", dates)
        right = left if bi == bj else wide_block(pdf, bj, "r", dates)
        if left.empty or right.empty or len(dates) < 2:
            return pd.DataFrame(columns=["asof", "a", "b", "cov", "n_obs"])
        x = left.to_numpy() - left.to_numpy().mean(axis=0)
        y = right.to_numpy() - right.to_numpy().mean(axis=0)
        cov = x.T @ y / (len(dates) - 1)
        i, j = np.triu_indices(cov.shape[0]) if bi == bj else np.indices(cov.shape).reshape(2, -1)
        p, q = left.columns.to_numpy()[i], right.columns.to_numpy()[j]
        swap = p > q
        return pd.DataFrame(
            {
                "asof": asof,
                "a": np.where(swap, q, p),
                "b": np.where(swap, p, q),
                "cov": cov[i, j],
                "n_obs": len(dates),
            }
        )

    spread = into_block_pairs(df.select("asof", "date", "ticker", "r"), blocks)
    return spread.groupBy("asof", "bi", "bj").applyInPandas(products, schema)


def correlations(cov: DataFrame) -> DataFrame:
    """Add correlation and the clipped distance ``sqrt((1 - rho) / 2)``."""
    var = cov.where("a = b").select("asof", F.col("a").alias("_t"), F.col("cov").alias("_v"))
    va = var.withColumnsRenamed({"_t": "a", "_v": "_va"})
    vb = var.withColumnsRenamed({"_t": "b", "_v": "_vb"})
    rho = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(
        ratio(F.col("cov"), F.sqrt(F.col("_va") * F.col("_vb")))
    )
    gap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("rho")) / 2))
    return (
        cov.join(va, ["asof", "a"])
        .join(vb, ["asof", "b"])
        .withColumn("rho", rho)
        .withColumn("distance", F.when(F.col("rho").isNotNull(), F.sqrt(gap)))
        .drop("_va", "_vb")
    )


def inverse_variance(cov: DataFrame) -> DataFrame:
    """Weights proportional to one over each name's variance, per ``asof``."""
    inv = cov.where("a = b").select("asof", F.col("a").alias("ticker"), ratio(F.lit(1.0), F.col("cov")).alias("_iv"))
    total = with_group(inv, ["asof"], {"_sum": F.sum("_iv")})
    return total.select("asof", "ticker", (F.col("_iv") / F.col("_sum")).alias("weight"))


def ledoit_wolf(df: DataFrame, cov: DataFrame) -> DataFrame:
    """Shrunk covariance per ``asof`` towards a scaled identity (Ledoit and Wolf, 2004).

    ``df`` holds the complete-case returns and ``cov`` their sample covariance. The sum of
    squared products over all pairs equals the squared per-date sum of squares, so the
    fourth moments never need a pair expansion.
    """
    means = Window.partitionBy("asof", "ticker")
    centred = df.withColumn("_x", F.col("r") - F.avg("r").over(means))
    per_date = centred.groupBy("asof", "date").agg(F.sum(F.col("_x") * F.col("_x")).alias("_d"))
    fourth = per_date.groupBy("asof").agg(F.avg(F.col("_d") * F.col("_d")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    pop = cov.withColumn("_s", F.col("cov") * (F.col("n_obs") - 1) / F.col("n_obs"))
    diag = F.col("a") == F.col("b")
    sums = pop.groupBy("asof").agg(
        F.sum(F.when(diag, F.col("_s"))).alias("_trace"),
        F.count(F.when(diag, 1)).alias("_p"),
        F.sum(F.when(diag, F.col("_s") ** 2).otherwise(2 * F.col("_s") ** 2)).alias("_ss"),
    )
    mu = F.col("_trace") / F.col("_p")
    delta = F.col("_ss") / F.col("_p") - mu * mu
    beta = (F.col("_q") - F.col("_ss")) / (F.col("_p") * F.col("_n"))
    shrink = sums.join(fourth, "asof").select(
        "asof", mu.alias("mu"), F.coalesce(ratio(F.least(beta, delta), delta), F.lit(0.0)).alias("shrinkage")
    )
    s = F.col("shrinkage")
    return pop.join(shrink, "asof").select(
        "asof",
        "a",
        "b",
        ((1 - s) * F.col("_s") + F.when(diag, s * F.col("mu")).otherwise(F.lit(0.0))).alias("cov"),
        "n_obs",
        "shrinkage",
    )


def both_ways(cov: DataFrame) -> DataFrame:
    """The symmetric completion of an upper-triangle table."""
    flipped = cov.where("a <> b").select("asof", F.col("b").alias("a"), F.col("a").alias("b"), "cov")
    return cov.select("asof", "a", "b", "cov").unionByName(flipped)


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """w_i (Sigma w)_i per name and its share of the total."""
    w = weights.select("asof", "ticker", "weight")
    marginal = (
        both_ways(cov)
        .join(w.withColumnsRenamed({"ticker": "b", "weight": "_wb"}), ["asof", "b"])
        .groupBy("asof", "a")
        .agg(F.sum(F.col("cov") * F.col("_wb")).alias("_m"))
    )
    rc: Column = F.col("weight") * F.col("_m")
    each = w.withColumnRenamed("ticker", "a").join(marginal, ["asof", "a"]).select(
        "asof", F.col("a").alias("ticker"), "weight", rc.alias("risk")
    )
    return with_group(each, ["asof"], {"_all": F.sum("risk")}).withColumn(
        "share", ratio(F.col("risk"), F.col("_all"))
    ).drop("_all")


def contributions_from_returns(weights: DataFrame, returns: DataFrame, bars: DataFrame) -> DataFrame:
    """Risk contributions w_i cov(r_i, r_p) without any pair of names.

    ``weights`` is (asof, ticker, weight), ``returns`` (asof, date, ticker, r) and ``bars`` (asof,
    n_bars); a bar that a name lacks is a return of zero, so the sums over its own rows are those
    over all bars. Cost and result grow with the names, not with their square.
    """
    held = returns.join(weights, ["asof", "ticker"])
    portfolio = held.groupBy("asof", "date").agg(F.sum(F.col("weight") * F.col("r")).alias("_p"))
    means = portfolio.join(bars, "asof").groupBy("asof", "n_bars").agg((F.sum("_p") / F.col("n_bars")).alias("_pm"))
    met = held.join(portfolio, ["asof", "date"])
    sums = met.groupBy("asof", "ticker", "weight").agg(F.sum(F.col("r") * F.col("_p")).alias("_rp"), F.sum("r").alias("_s"))
    risk = F.col("weight") * (F.col("_rp") - F.col("_s") * F.col("_pm")) / (F.col("n_bars") - 1)
    each = sums.join(means, "asof").select("asof", "ticker", "weight", risk.alias("risk"))
    return with_group(each, ["asof"], {"_all": F.sum("risk")}).withColumn("share", ratio(F.col("risk"), F.col("_all"))).drop("_all")


def inverse_variance_from_returns(returns: DataFrame, bars: DataFrame) -> DataFrame:
    """(asof, ticker, weight) by 1 / variance over all bars, a lacking one being zero; names
    without variance take no part."""
    own = returns.groupBy("asof", "ticker").agg(F.sum(F.col("r") * F.col("r")).alias("_q"), F.sum("r").alias("_s"))
    n = F.col("n_bars")
    var = (F.col("_q") - F.col("_s") * F.col("_s") / n) / (n - 1)
    each = own.join(bars, "asof").withColumn("_v", var).where("_v > 0").select("asof", "ticker", (1 / F.col("_v")).alias("_w"))
    return with_group(each, ["asof"], {"_all": F.sum("_w")}).select("asof", "ticker", (F.col("_w") / F.col("_all")).alias("weight"))
