"""Per-date operators across names.

A date's cross-section grows with the number of names, so no function here gathers one
date into one window partition. Group statistics are map-side combined aggregates joined
back by key; ranks are counted in two levels (value buckets, then values).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.columns import ratio

BUCKETS_PER_OCTAVE = 512


def with_group(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add aggregates of each row's group.

    The aggregate has one row per group and joins back by key: adaptive execution
    broadcasts it when its measured size allows and splits a skewed key otherwise.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(totals, list(keys))


def value_bucket(x: Column) -> Column:
    """A coarse long that never decreases as ``x`` grows; independent of the data."""
    level = F.floor(F.log2(F.abs(x)) * BUCKETS_PER_OCTAVE).cast("long") + 1_000_000
    return F.when(x > 0, level).when(x < 0, -level).otherwise(F.lit(0).cast("long"))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Average-tie rank of ``value`` within ``by`` (the whole frame when empty), plus ``n_ranked``.

    Equal values are merged before any shuffle. Each bucket then ranks its distinct values
    and is shifted by the number of rows in lower buckets, so a group of any size is spread
    over many tasks. NULL values get a NULL rank and are not counted.
    """
    keys = list(by)
    # -0.0 and 0.0 are one value.
    x = df.withColumn("_v", F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col(value)))
    distinct = (
        x.where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_ties"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        distinct.groupBy(*keys, "_b")
        .agg(F.sum("_ties").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(below), F.lit(0)))
        .withColumn("n_ranked", F.sum("_size").over(group))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    upto = F.sum("_ties").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = distinct.join(buckets, [*keys, "_b"]).select(
        *keys,
        "_v",
        "n_ranked",
        "_ties",
        (F.col("_offset") + upto - (F.col("_ties") - 1) / 2.0).cast("double").alias(out),
    )
    return x.join(ranked.drop("_ties"), [*keys, "_v"], "left").drop("_v")


def first_rank(
    df: DataFrame, value: str, tie: str, by: str = "date", out: str = "rank", prefix: int = 8
) -> DataFrame:
    """Rank of ``value`` within ``by`` with ties in order of ``tie``; adds ``n_ranked``.

    Rows are counted per (value, prefix of the tie string), a refinement that keeps the
    order, so even a value shared by most names is numbered in many small groups.
    """
    x = df.where(F.col(value).isNotNull()).withColumns(
        {
            "_v": F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col(value)),
            "_t": F.substring(F.col(tie), 1, prefix),
        }
    )
    parts = x.groupBy(by, "_v", "_t").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_b", value_bucket(F.col("_v")))
    group = Window.partitionBy(by)
    below = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        parts.groupBy(by, "_b")
        .agg(F.sum("_rows").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(below), F.lit(0)))
        .withColumn("n_ranked", F.sum("_size").over(group))
        .drop("_size")
    )
    inside = Window.partitionBy(by, "_b").orderBy("_v", "_t").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(buckets, [by, "_b"]).select(
        by, "_v", "_t", "n_ranked", (F.col("_offset") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_start")
    )
    own = Window.partitionBy(by, "_v", "_t").orderBy(tie)
    return (
        x.join(placed, [by, "_v", "_t"])
        .withColumn(out, F.col("_start") + F.row_number().over(own))
        .drop("_v", "_t", "_start")
    )


def cs_rank(panel: DataFrame, value_col: str, by: str = "date") -> DataFrame:
    """Percent rank with average ties, centred: in ``(-0.5, 0.5]``, lowest ``1/n - 0.5``."""
    ranked = average_rank(panel, value_col, [by], "_rank")
    return ranked.withColumn("cs_rank", F.col("_rank") / F.col("n_ranked") - 0.5).drop("_rank", "n_ranked")


def cs_zscore(panel: DataFrame, value_col: str, by: str = "date") -> DataFrame:
    """Standard score with population deviation; a constant cross-section gives NULL."""
    x = F.col(value_col)
    withstats = with_group(panel, [by], {"_mean": F.avg(x), "_sd": F.stddev_pop(x)})
    return withstats.withColumn("cs_z", ratio(x - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def sector_neutralize(panel: DataFrame, value_col: str, sector_col: str, by: str = "date") -> DataFrame:
    """Value minus its (date, sector) mean."""
    if sector_col not in panel.columns:
        raise KeyError(f"sector column not found: {sector_col!r}")
    x = F.col(value_col)
    withmean = with_group(panel, [by, sector_col], {"_mean": F.avg(x)})
    return withmean.withColumn("neutral", x - F.col("_mean")).drop("_mean")


def to_gross(scores: DataFrame, col: str = "score", by: str = "date", gross: float = 1.0) -> DataFrame:
    """Scale each cross-section so absolute values sum to ``gross``; an all-zero one is kept."""
    total = with_group(scores, [by], {"_gross": F.sum(F.abs(F.col(col)))})
    scaled = F.when(F.col("_gross") > 0, F.col(col) * gross / F.col("_gross")).otherwise(F.col(col))
    return total.withColumn(col, scaled).drop("_gross")
