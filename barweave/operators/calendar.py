"""Trading calendar, rebalance dates and as-of alignment.

Frames called ``dates`` or ``calendar`` hold one row per calendar date, so they are
bounded by the length of history. They are never hinted for broadcast: adaptive
execution switches to a broadcast join when their measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.rolling import ordered

FREQUENCIES = ("D", "W-FRI", "BMS")


def trading_dates(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct()


def _month_start(d: Column) -> Column:
    """First weekday (Monday to Friday) of the month of ``d``."""
    first = F.trunc(d, "MM")
    dow = F.dayofweek(first)  # 1 = Sunday, 7 = Saturday
    return F.when(dow == 7, F.date_add(first, 2)).when(dow == 1, F.date_add(first, 1)).otherwise(first)


def anchor(freq: str, d: Column) -> Column:
    """The period label a date belongs to: its Friday, or its business-month start."""
    if freq == "W-FRI":
        return F.next_day(F.date_sub(d, 1), "FRI")
    if freq == "BMS":
        this = _month_start(d)
        return F.when(d >= this, this).otherwise(_month_start(F.add_months(d, -1)))
    raise ValueError(f"unknown rebalance frequency: {freq!r}")


def rebalance_dates(panel: DataFrame, freq: str = "BMS") -> DataFrame:
    """Decision dates: each period anchor moved to the first bar at or after it."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown rebalance frequency: {freq!r}")
    cal = trading_dates(panel)
    if freq == "D":
        return cal
    anchors = cal.select(anchor(freq, F.col("date")).alias("anchor")).distinct()
    return ceiling(anchors, cal).where(F.col("date").isNotNull()).select("date").distinct()


def ceiling(anchors: DataFrame, calendar: DataFrame) -> DataFrame:
    """(anchor, date): the first calendar date at or after each anchor, else NULL."""
    both = calendar.select(F.col("date").alias("at"), "date", F.lit(None).cast("date").alias("anchor")).unionByName(
        anchors.select(F.col("anchor").alias("at"), F.lit(None).cast("date").alias("date"), "anchor")
    )
    # One row per calendar date and anchor: the single partition is bounded by the calendar.
    ahead = (
        Window.partitionBy(F.lit(0))
        .orderBy("at")
        .rangeBetween(Window.currentRow, Window.unboundedFollowing)
    )
    return (
        both.withColumn("date", F.min("date").over(ahead))
        .where(F.col("anchor").isNotNull())
        .select("anchor", "date")
    )


def decision_index(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """Per calendar date: ``lo``, the index of the first decision date at or after it.

    ``n`` is the number of decision dates. Adding ``lo`` to bars turns every as-of
    question into integer ranges over that index.
    """
    marks = (
        trading_dates(panel)
        .select("date", F.lit(0).alias("decides"), F.lit(1).alias("trades"))
        .unionByName(dates.select("date", F.lit(1).alias("decides"), F.lit(0).alias("trades")))
        .groupBy("date")
        .agg(F.max("decides").alias("decides"), F.max("trades").alias("trades"))
    )
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return marks.select(
        "date",
        "decides",
        F.coalesce(F.sum("decides").over(before), F.lit(0)).cast("int").alias("lo"),
        F.sum("decides").over(whole).cast("int").alias("n"),
    )


def in_windows(
    df: DataFrame, dates: DataFrame, n: int, by: str | None = "ticker", calendar: DataFrame | None = None
) -> DataFrame:
    """Replicate each row into every decision date whose last ``n`` rows include it.

    A row belongs to the decision dates from its own date up to the date of the row
    ``n`` places later, so the replication is about ``n / period`` and no range join is
    needed. ``n=1`` is the backward as-of join: each series' last row at or before
    the decision date, however old. With ``by=None`` rows are counted on the calendar.
    Adds the column ``asof``.
    """
    idx = decision_index(calendar if calendar is not None else df, dates)
    decided = idx.where("decides = 1").select(F.col("lo").alias("_k"), F.col("date").alias("asof"))
    if by is None:
        w = Window.partitionBy(F.lit(0)).orderBy("date")
        cal = trading_dates(calendar if calendar is not None else df).join(idx.select("date", "lo", "n"), "date")
        span = cal.withColumn("_hi", F.coalesce(F.lead("lo", n).over(w), F.col("n")))
        placed = df.join(span, "date")
    else:
        placed = df.join(idx.select("date", "lo", "n"), "date").withColumn(
            "_hi", F.coalesce(F.lead("lo", n).over(ordered(by)), F.col("n"))
        )
    return (
        placed.where(F.col("_hi") > F.col("lo"))
        .withColumn("_k", F.explode(F.sequence(F.col("lo"), F.col("_hi") - 1)))
        .drop("lo", "n", "_hi")
        .join(decided, "_k")
        .drop("_k")
    )


def asof_last(df: DataFrame, dates: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Each ticker's last row at every decision date, dated by that decision date.

    The row's own date is kept as ``bar_date``.
    """
    return (
        in_windows(df, dates, 1, "ticker", calendar)
        .withColumnRenamed("date", "bar_date")
        .withColumnRenamed("asof", "date")
    )


def next_dates(panel: DataFrame) -> DataFrame:
    """(date, next_date): each calendar date with the one after it."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return trading_dates(panel).withColumn("next_date", F.lead("date").over(w)).where("next_date IS NOT NULL")


def held_since(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Add ``decided``: the latest decision date strictly before each row's date."""
    idx = decision_index(df, dates)
    whole = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    prior = idx.select("date", F.max(F.when(F.col("decides") == 1, F.col("date"))).over(whole).alias("decided"))
    return df.join(prior.where("decided IS NOT NULL"), "date")


def dates_after(dates: DataFrame, panel: DataFrame, bars: int) -> DataFrame:
    """Decision dates by which the calendar holds at least ``bars`` dates."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    pos = trading_dates(panel).withColumn("_pos", F.row_number().over(w))
    return dates.join(pos.where(F.col("_pos") >= bars), "date").select("date")
