"""From target weights to fills, equity and returns, as set operations.

Targets are sized on a fixed capital base. The one step that must run in order, the capped
position of each name, is a fold over that name's own decisions; everything else is sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.constants import INITIAL_CAPITAL, PARTICIPATION_CAP
from barweave.functions.columns import finite
from barweave.functions.costs import CostModel
from barweave.functions.rolling import cumulative, ordered
from barweave.operators.calendar import asof_last, held_since, next_dates, trading_dates
from barweave.operators.features import simple_ret
from barweave.session import deal

RUN = "run_id"


def portfolio_returns(weights: DataFrame, panel: DataFrame, run: str = RUN) -> DataFrame:
    """Daily return per run: each bar's return times the weight decided before its date.

    Weights hold from the day after their decision up to and including the next decision
    date. Every calendar date after a run's first decision has a row; on one where no
    weighted name has a bar the return is 0. Runs decide on the same dates.
    """
    calendar = trading_dates(panel)
    spans = held_since(calendar, weights.select("date").distinct())
    rets = deal(panel.select("date", "ticker", "adj_close"), "ticker").withColumn("r", simple_ret()).where("r IS NOT NULL")
    w = weights.where(finite(F.col("weight"))).select(F.col("date").alias("decided"), "ticker", run, "weight")
    earned = (
        deal(rets.join(spans, "date"), "decided", "ticker")
        .join(w, ["decided", "ticker"])
        .groupBy(run, "date")
        .agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    )
    decisions = weights.select(run, F.col("date").alias("decided")).distinct()
    days = spans.join(decisions, "decided").select(run, "date")
    return days.join(earned, [run, "date"], "left").select(
        F.col(run).alias("series_id"), "date", F.coalesce("r", F.lit(0.0)).alias("r")
    )


def orders(
    weights: DataFrame,
    panel: DataFrame,
    capital: float = INITIAL_CAPITAL,
    hold_missing: bool = False,
    wait_for_bar: bool = False,
) -> DataFrame:
    """Share targets with the bar each will trade on: the next calendar date's.

    A name without a bar on the decision date or on the next date does not trade. With
    ``wait_for_bar`` it is sized at its last price, however old, and its order waits for its
    next bar. A name without a weight at a later decision is closed, or kept with
    ``hold_missing``. When two decisions meet on one bar the later one counts.
    """
    w = ordered()
    bars = deal(panel, "ticker").select(
        "date",
        "ticker",
        F.col("adj_close").alias("_p"),
        F.lead("date").over(w).alias("exec_date"),
        F.lead("open").over(w).alias("open"),
        F.lead("volume").over(w).alias("volume"),
    )
    if wait_for_bar:
        at = asof_last(bars, weights.select("date").distinct(), calendar=panel.select("date"))
    else:
        at = bars.join(next_dates(panel), "date").where("exec_date = next_date").drop("next_date")
    wanted = weights.where(finite(F.col("weight"))).select(RUN, "date", "ticker", "weight")
    if hold_missing:
        placed = at.join(wanted, ["date", "ticker"])
    else:
        members = weights.select(RUN, "ticker").distinct()
        decisions = weights.select(RUN, "date").distinct()
        placed = (
            deal(at.join(members, "ticker").join(decisions, [RUN, "date"]), RUN, "date", "ticker")
            .join(wanted, [RUN, "date", "ticker"], "left")
            .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        )
    placed = placed.where((F.col("_p") > 0) & F.col("exec_date").isNotNull())
    target = F.col("weight") * capital / F.col("_p")
    return (
        placed.withColumn("target", target)
        .groupBy(RUN, "ticker", "exec_date", "open", "volume")
        .agg(F.max_by("target", "date").alias("target"))
    )


def fill_orders(
    wanted: DataFrame,
    cost: CostModel = CostModel(),
    cap: float = PARTICIPATION_CAP,
    flat_cost: bool = False,
) -> DataFrame:
    """Fills per (run, name) in date order; what exceeds the volume cap is dropped.

    ``flat_cost`` charges one fraction as if every trade used the whole cap.
    """
    step = F.struct(
        F.col("exec_date").alias("d"),
        "target",
        F.col("open").alias("px"),
        "volume",
        F.when((F.col("open") > 0) & (F.col("volume") > 0), F.lit(cap) * F.col("volume"))
        .otherwise(F.lit(0.0))
        .alias("room"),
    )
    path = wanted.groupBy(RUN, "ticker").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    empty = F.array().cast("array<struct<d:date,shares:double,px:double,volume:double>>")
    start = F.struct(F.lit(0.0).alias("pos"), empty.alias("fills"))

    def trade(acc: Column, s: Column) -> Column:
        delta = s["target"] - acc["pos"]
        shares = F.when(F.abs(delta) < 1e-9, F.lit(0.0)).otherwise(
            F.greatest(-s["room"], F.least(delta, s["room"]))
        )
        fill = F.struct(s["d"].alias("d"), shares.alias("shares"), s["px"].alias("px"), s["volume"].alias("volume"))
        return F.struct((acc["pos"] + shares).alias("pos"), F.concat(acc["fills"], F.array(fill)).alias("fills"))

    filled = path.select(RUN, "ticker", F.inline(F.aggregate("steps", start, trade, lambda a: a["fills"])))
    notional = F.col("shares") * F.col("px")
    part = F.abs("shares") / F.col("volume")
    out = filled.where("shares <> 0").select(
        RUN,
        F.col("d").alias("date"),
        "ticker",
        "shares",
        F.col("px").alias("price"),
        notional.alias("notional"),
        part.alias("participation"),
    )
    if flat_cost:
        charge = F.abs("notional") * cost.flat_fraction(cap)
    else:
        charge = cost.trade_cost(F.col("notional"), F.col("participation"))
    return out.withColumn("cost", charge)


def mark_to_market(
    fills: DataFrame, panel: DataFrame, capital: float = INITIAL_CAPITAL, cost: CostModel = CostModel()
) -> DataFrame:
    """Equity, cash, gross leverage and borrow per run and date.

    A name's value moves only on its own bars, so each bar contributes the change in value
    and the totals are running sums over dates: names are never expanded over the calendar.
    Borrow accrues after the mark and reduces cash from the next date on.
    """
    members = fills.select(RUN, "ticker").distinct()
    bars = panel.select("date", "ticker", "adj_close").join(members, "ticker")
    trades = fills.select(RUN, "date", "ticker", "shares", (F.col("notional") + F.col("cost")).alias("paid"))
    keys = (RUN, "ticker")
    held = deal(deal(bars, RUN, "date", "ticker").join(trades, [RUN, "date", "ticker"], "left"), *keys)
    held = held.withColumn("pos", F.coalesce(F.sum("shares").over(cumulative(keys)), F.lit(0.0)))
    held = held.withColumn("value", F.col("pos") * F.col("adj_close"))
    short = F.when(F.col("value") < 0, F.col("value")).otherwise(F.lit(0.0))
    held = held.withColumns({"gross": F.abs("value"), "short": short})
    change = {c: F.col(c) - F.coalesce(F.lag(c).over(ordered(keys)), F.lit(0.0)) for c in ("value", "gross", "short")}
    moved = held.select(RUN, "date", "paid", *[x.alias(f"d_{c}") for c, x in change.items()])
    daily = moved.groupBy(RUN, "date").agg(
        F.sum("d_value").alias("d_value"),
        F.sum("d_gross").alias("d_gross"),
        F.sum("d_short").alias("d_short"),
        F.coalesce(F.sum("paid"), F.lit(0.0)).alias("paid"),
    )
    w = cumulative(RUN)
    totals = daily.select(
        RUN,
        "date",
        F.sum("d_value").over(w).alias("value"),
        F.sum("d_gross").over(w).alias("gross"),
        cost.carry_cost(F.sum("d_short").over(w)).alias("borrow"),
        F.sum("paid").over(w).alias("spent"),
    )
    earlier = ordered(RUN).rowsBetween(Window.unboundedPreceding, -1)
    cash = F.lit(capital) - F.col("spent") - F.coalesce(F.sum("borrow").over(earlier), F.lit(0.0))
    out = totals.withColumn("cash", cash).withColumn("equity", F.col("cash") + F.col("value"))
    leverage = F.when(F.col("equity") > 0, F.col("gross") / F.col("equity")).otherwise(F.lit(0.0))
    return out.select(RUN, "date", "cash", "equity", leverage.alias("gross_leverage"), "borrow")


def equity_returns(equity: DataFrame) -> DataFrame:
    """(series_id, date, r, log_r) from an equity curve, without the leading bar."""
    w = ordered(RUN)
    rel = F.try_divide(F.col("equity"), F.lag("equity").over(w))
    return (
        equity.withColumn("_g", rel)
        .where("_g IS NOT NULL")
        .select(F.col(RUN).alias("series_id"), "date", (F.col("_g") - 1).alias("r"), F.ln("_g").alias("log_r"))
    )
