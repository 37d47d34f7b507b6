"""From scores to weights with column expressions; one row per (date, ticker)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.columns import clip
from barweave.operators.cross_section import with_group


@dataclass(frozen=True)
class Constraints:
    """What weights must keep to at each decision.

    ``min_weight`` to ``max_weight`` bound every name, ``gross_leverage`` is the sum of absolute
    weights aimed at, and ``turnover_cap`` the most that weights may change in all from prior
    ones, where these are given.
    """

    max_weight: float = 0.10
    min_weight: float = -0.10
    gross_leverage: float = 1.0
    turnover_cap: float | None = None


def equal_weight(scores: DataFrame, mode: str = "signed", gross_leverage: float = 1.0) -> DataFrame:
    """``1/n`` long for every name, or the score's sign over the number of non-zero scores."""
    if mode not in ("signed", "signless"):
        raise ValueError(f"unknown mode: {mode!r}")
    s = scores.where(F.col("score").isNotNull())
    if mode == "signless":
        n = with_group(s, ["date"], {"_n": F.count(F.lit(1))})
        weight = F.lit(gross_leverage) / F.col("_n")
    else:
        n = with_group(s, ["date"], {"_n": F.count(F.when(F.col("score") != 0, 1))})
        weight = F.when(F.col("_n") > 0, F.signum("score") * gross_leverage / F.col("_n")).otherwise(F.lit(0.0))
    return n.select("date", "ticker", weight.alias("weight"))


def pull_toward(weights: DataFrame, prior: DataFrame, cap: float) -> DataFrame:
    """Move ``weights`` back toward ``prior`` (date, ticker, weight) where they change by more than
    ``cap`` in all: one blend factor per decision.

    A name that ``prior`` lacks was at zero; names that only ``prior`` has are not counted and
    not returned, so every new name meets its old weight by key.
    """
    old = prior.groupBy("date", "ticker").agg(F.sum("weight").alias("_prior"))
    both = weights.join(old, ["date", "ticker"], "left").withColumn("_prior", F.coalesce("_prior", F.lit(0.0)))
    change = F.coalesce("weight", F.lit(0.0)) - F.col("_prior")
    moved = with_group(both.withColumn("_change", change), ["date"], {"_turnover": F.sum(F.abs("_change"))})
    factor = F.when(F.col("_turnover") > cap, F.lit(cap) / F.col("_turnover")).otherwise(F.lit(1.0))
    return moved.withColumn("weight", F.col("_prior") + factor * F.col("_change")).select(*weights.columns)


def apply_constraints(weights: DataFrame, c: Constraints = Constraints(), prior: DataFrame | None = None) -> DataFrame:
    """Clip, scale the gross to its target, clip again; caps win over the gross target.

    With ``prior`` weights and a turnover cap the result is then pulled toward them; a cap
    without prior weights has nothing to act on.
    """
    w0 = clip(F.coalesce("weight", F.lit(0.0)), c.min_weight, c.max_weight)
    clipped = weights.withColumn("weight", w0)
    gross = with_group(clipped, ["date"], {"_gross": F.sum(F.abs("weight"))})
    off = (F.col("_gross") > c.gross_leverage + 1e-12) | (
        (F.col("_gross") > 0) & (F.col("_gross") < c.gross_leverage)
    )
    scaled = clip(F.col("weight") * (c.gross_leverage / F.col("_gross")), c.min_weight, c.max_weight)
    out = gross.withColumn("weight", F.when(off, scaled).otherwise(F.col("weight"))).drop("_gross")
    return out if prior is None or c.turnover_cap is None else pull_toward(out, prior, c.turnover_cap)


def turnover(weights: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Sum of absolute weight changes per decision over both name sets; the first is from zero.

    Each weight meets its own negation one decision later, so the change per name is a sum
    by key: no self-join.
    """
    decisions = (weights if dates is None else dates).select("date").distinct()
    nxt = F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    follow = decisions.withColumn("_next", nxt)
    leaving = (
        weights.join(follow.where("_next IS NOT NULL"), "date")
        .select(F.col("_next").alias("date"), "ticker", (-F.col("weight")).alias("weight"))
    )
    change = (
        weights.select("date", "ticker", "weight")
        .unionByName(leaving)
        .groupBy("date", "ticker")
        .agg(F.abs(F.sum("weight")).alias("_c"))
    )
    return change.groupBy("date").agg(F.sum("_c").alias("turnover"))


def densify(weights: DataFrame) -> DataFrame:
    """Every (decision date, name) with absent weights as 0.

    The result is dates x names by definition. Each name carries the array of decision
    dates (bounded by the calendar) and its own weights, so no row meets a foreign name.
    """
    days = weights.agg(F.array_sort(F.collect_set("date")).alias("_days"))
    own = weights.groupBy("ticker").agg(
        F.map_from_entries(F.collect_list(F.struct("date", "weight"))).alias("_w")
    )
    # One row of at most one entry per calendar date.
    days, own = days.withColumn("_all", F.lit(1)), own.withColumn("_all", F.lit(1))
    spread = own.join(F.broadcast(days), "_all").select("ticker", "_w", F.explode("_days").alias("date"))
    return spread.select("date", "ticker", F.coalesce(F.try_element_at("_w", F.col("date")), F.lit(0.0)).alias("weight"))
