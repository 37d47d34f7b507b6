"""Exact quantiles of groups of any size.

A mergeable sketch brackets the rank that is asked for. The values below the bracket are
counted exactly, and only the bracket's distinct values are shuffled and sorted; a bracket
that misses the rank is widened. No task sees more of a group than its bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.session import materialise

ACCURACY = 10_000  # a sketched rank is off by one part in so many at most
BROADCAST_GROUPS = 50_000  # up to so many groups, their brackets go to every task


def _brackets(rows: DataFrame, keys: list[str], q: float, slack: float, accuracy: int) -> DataFrame:
    ends = [max(0.0, q - slack), min(1.0, q + slack)]
    low = F.col("_min") if ends[0] == 0 else F.col("_s")[0]
    high = F.col("_max") if ends[1] == 1 else F.col("_s")[1]
    at = (F.col("n") - 1) * F.lit(q)
    return (
        rows.groupBy(*keys)
        .agg(
            F.count("_x").alias("n"),
            F.min("_x").alias("_min"),
            F.max("_x").alias("_max"),
            F.percentile_approx("_x", ends, accuracy).alias("_s"),
        )
        .select(*keys, "n", low.alias("_low"), high.alias("_high"), F.floor(at).alias("_r"), (at - F.floor(at)).alias("_part"))
    )


def bracketed(rows: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """``rows`` with their group's bracket, in every task if the groups are few."""
    few = brackets.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(brackets) if few else brackets, keys)


def exact_quantile(df: DataFrame, value: str, q: float, keys: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """(keys, quantile, n): linear interpolation between the two values around rank (n - 1) q.

    NULL values are not counted; a group without values has no row. Without ``keys`` the
    whole frame is one group.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be between 0 and 1")
    by = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    rows = source.select(*by, F.col(value).alias("_x")).where("_x IS NOT NULL")
    slack = 2.0 / accuracy
    while True:
        brackets = materialise(_brackets(rows, by, q, slack, accuracy))
        met = bracketed(rows, by, brackets)
        below = met.groupBy(*by).agg(F.count(F.when(F.col("_x") < F.col("_low"), 1)).alias("_below"))
        upto = Window.partitionBy(*by).orderBy("_x")
        ranked = (
            met.where(F.col("_x").between(F.col("_low"), F.col("_high")))
            .groupBy(*by, "_x")
            .agg(F.count(F.lit(1)).alias("_ties"))
            .withColumn("_upto", F.sum("_ties").over(upto))
        )
        first = F.col("_below") + F.col("_upto") - F.col("_ties")
        here = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("_below") + F.col("_upto")), F.col("_x")))
        above = F.when(F.col("_part") > 0, F.col("_r") + 1).otherwise(F.col("_r"))
        found = materialise(
            brackets.join(below, by)
            .join(ranked, by)
            .groupBy(*by, "n", "_part")
            .agg(here(F.col("_r")).alias("_a"), here(above).alias("_b"))
        )
        if slack >= 1 or found.where("_a IS NULL OR _b IS NULL").isEmpty() and found.count() == brackets.count():
            return found.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile"), "n")
        slack *= 8


def pooled_tail(returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Historical value at risk and expected shortfall of all series as one: a single row."""
    cut = exact_quantile(returns, "r", 1 - confidence)
    rows = returns.select("r").where("r IS NOT NULL").join(F.broadcast(cut), how="inner")  # one row
    tail = rows.agg((-F.avg(F.when(F.col("r") <= F.col("quantile"), F.col("r")))).alias("es"))
    return cut.select((-F.col("quantile")).alias("var"), F.col("n").alias("n_obs")).join(F.broadcast(tail))
