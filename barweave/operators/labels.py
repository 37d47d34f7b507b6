"""Event labels on price paths."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.rolling import ordered
from barweave.session import deal


@dataclass(frozen=True)
class Barriers:
    """Barrier multiples of volatility, the horizon in bars, and the least return kept."""

    pt: float = 2.0
    sl: float = 2.0
    vertical: int = 21
    min_ret: float = 0.0


def triple_barrier(
    df: DataFrame,
    price: str = "adj_close",
    vol: str = "vol",
    event: str | None = None,
    barriers: Barriers = Barriers(),
) -> DataFrame:
    """(ticker, t0, t1, ret, bin) for every bar with a volatility and a true ``event``.

    The first touch is found by descent. Bars lie in blocks of about the square root of the
    horizon, each with its highest and lowest price. A bar looks through the rest of its own
    block, then through the ends of the blocks ahead, then into the first block whose ends lie
    beyond a barrier: work per bar grows with the root of ``vertical``, and nothing is shuffled
    but the panel by ticker. Without a touch the label is taken at the last bar of the horizon;
    a value on both sides (possible with zero volatility) is such a tie.
    """
    reach = barriers.vertical
    size = max(1, math.isqrt(reach))
    w = ordered()
    wanted = F.col(vol).isNotNull() & ~F.isnan(vol)
    if event is not None:
        wanted = wanted & F.coalesce(F.col(event), F.lit(False))
    bars = df.select(
        "ticker",
        "date",
        (F.row_number().over(w) - 1).alias("at"),
        F.ln(price).alias("lp"),
        wanted.alias("go"),
        (barriers.pt * F.col(vol)).alias("up"),
        (-barriers.sl * F.col(vol)).alias("down"),
    )
    bar = F.struct("at", "date", "lp")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.coalesce(F.lead(bar, reach).over(w), F.last(bar).over(whole))
    bars = bars.withColumns({"end": end, "_block": F.floor(F.col("at") / size)})
    blocks = bars.groupBy("ticker", "_block").agg(
        F.sort_array(F.collect_list(F.struct("at", "date", "lp", "go", "up", "down", "end"))).alias("_bars"),
        F.max("lp").alias("_high"),
        F.min("lp").alias("_low"),
    )
    slim = F.transform("_bars", lambda y: F.struct(y["at"].alias("at"), y["date"].alias("date"), y["lp"].alias("lp")))
    ahead = F.collect_list(F.struct(F.col("_high").alias("high"), F.col("_low").alias("low"), slim.alias("bars")))
    following = ordered("ticker", "_block").rowsBetween(1, (reach + size - 1) // size)
    blocks = blocks.withColumn("_ahead", ahead.over(following))

    def first_beyond(found: Column, x: Column) -> Column:
        within = lambda y: (y["at"] > x["at"]) & (y["at"] <= x["at"] + reach)
        return F.try_element_at(F.filter(found, lambda y: within(y) & _beyond(y["lp"], y["lp"], x)), F.lit(1))

    def touched(x: Column) -> Column:
        block = F.try_element_at(F.filter("_ahead", lambda b: _beyond(b["high"], b["low"], x)), F.lit(1))
        hit = F.coalesce(first_beyond(slim, x), first_beyond(block["bars"], x))
        return F.struct(
            x["date"].alias("t0"), x["lp"].alias("lp"), x["up"].alias("up"), x["down"].alias("down"),
            hit.alias("hit"), F.when(x["end"]["at"] > x["at"], x["end"]).alias("end"),
        )

    out = blocks.select("ticker", F.inline(F.transform(F.filter("_bars", lambda x: x["go"]), touched)))
    move = F.col("hit.lp") - F.col("lp")
    none = F.col("hit").isNull() | ((move >= F.col("up")) & (move <= F.col("down")))
    out = out.withColumns(
        {
            "_at": F.when(none, F.col("end")).otherwise(F.col("hit")),
            "_side": F.when(none, 0).when(move >= F.col("up"), 1).otherwise(-1),
        }
    ).withColumn("ret", F.coalesce(F.col("_at.lp") - F.col("lp"), F.lit(0.0)))
    label = F.when(F.abs("ret") < barriers.min_ret, 0).otherwise(F.col("_side"))
    return out.select("ticker", "t0", F.coalesce(F.col("_at.date"), F.col("t0")).alias("t1"), "ret", label.cast("int").alias("bin"))


def _beyond(high: Column, low: Column, x: Column) -> Column:
    """Whether prices between ``low`` and ``high`` reach a barrier of the bar ``x``."""
    return (high - x["lp"] >= x["up"]) | (low - x["lp"] <= x["down"])


def meta_labels(predictions: DataFrame, labels: DataFrame, pred: str = "pred") -> DataFrame:
    """1 where the prediction's sign equals the label's sign, on the common rows."""
    lab = labels.select("ticker", F.col("t0").alias("date"), "bin").where("bin IS NOT NULL")
    joined = deal(predictions.where(F.col(pred).isNotNull()), "date", "ticker").join(lab, ["date", "ticker"])
    same = F.signum(F.col(pred).cast("double")) == F.signum(F.col("bin").cast("double"))
    return joined.withColumn("meta", same.cast("int"))


def forward_return(panel: DataFrame, horizon: int = 21, price: str = "adj_close") -> DataFrame:
    """Return over the next ``horizon`` bars; NULL where the history ends first."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    ahead = F.lead(price, horizon).over(ordered())
    return panel.withColumn("fwd_ret", F.try_divide(ahead, F.col(price)) - 1)
