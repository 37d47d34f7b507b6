"""Running products, sums and peaks of series of any length.

A series is cut into blocks of calendar days. Inside a block the running values are plain
windows over (series, block), so one long series spreads over as many tasks as it has blocks.
Each block leaves one summary row; what earlier blocks carry into a block is a running
aggregate over those few rows, joined back by (series, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.columns import ratio
from barweave.session import deal, materialise

BLOCK_DAYS = 365


def _block(order: str, days: int) -> Column:
    return F.floor(F.unix_date(F.col(order).cast("date")) / days)


def _carried(summary: DataFrame, by: str, values: dict[str, Column]) -> DataFrame:
    """``values`` over the blocks before each one, a row per (series, block)."""
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumns({c: v.over(before) for c, v in values.items()})


def wealth_path(returns: DataFrame, by: str = "series_id", order: str = "date", block_days: int = BLOCK_DAYS) -> DataFrame:
    """``returns`` (rows without ``r`` left out) with wealth, peak, drawdown, underwater and position.

    Starting capital is not a peak. ``order`` is a date or a timestamp, unique in its series.
    Equal to one window over the whole series up to the last bits of the product. Rows without a
    series or an order have no place and are left out. Columns of the input with the names of added
    ones are replaced; names that begin with an underscore are kept for the scan.
    """
    if block_days <= 0:
        raise ValueError("block_days must be positive")
    added = ("wealth", "peak", "drawdown", "underwater", "position")
    kept = [c for c in returns.columns if c not in added]
    local = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = returns.where(F.col("r").isNotNull() & F.col(by).isNotNull() & F.col(order).isNotNull()).select(*kept).withColumn("_block", _block(order, block_days))
    rows = rows.withColumns({"_p": F.product(1 + F.col("r")).over(local), "_k": F.row_number().over(local)})
    # A carried product below zero turns the order of a block round, so both ends are kept.
    rows = rows.withColumns({"_hi": F.max("_p").over(local), "_lo": F.min("_p").over(local)})
    rows = materialise(rows)

    summary = rows.groupBy(by, "_block").agg(
        F.max_by("_p", "_k").alias("_all"), F.max("_p").alias("_top"), F.min("_p").alias("_low"), F.max("_k").alias("_rows")
    )
    start = _carried(summary, by, {"_product": F.product("_all"), "_before": F.sum("_rows")})
    start = start.withColumns({"_product": F.coalesce("_product", F.lit(1.0)), "_before": F.coalesce("_before", F.lit(0))})
    best = F.col("_product") * F.when(F.col("_product") >= 0, F.col("_top")).otherwise(F.col("_low"))
    start = _carried(start.withColumn("_best", best), by, {"_peak": F.max("_best")})
    path = deal(rows, by, "_block").join(start.select(by, "_block", "_product", "_before", "_peak"), [by, "_block"])
    reach = F.col("_product") * F.when(F.col("_product") >= 0, F.col("_hi")).otherwise(F.col("_lo"))
    path = path.withColumns(
        {
            "wealth": F.col("_product") * F.col("_p"),
            "peak": F.greatest("_peak", reach),
            "position": (F.col("_before") + F.col("_k")).cast("long"),
        }
    ).withColumn("_at", F.when(F.col("wealth") >= F.col("peak"), F.col("position")))

    last = path.groupBy(by, "_block").agg(F.max("_at").alias("_latest"))
    last = _carried(last, by, {"_since": F.max("_latest")}).select(by, "_block", "_since")
    path = path.join(last, [by, "_block"]).withColumns(
        {
            "drawdown": ratio(F.col("wealth"), F.col("peak")) - 1,
            "underwater": F.col("position") - F.greatest("_since", F.max("_at").over(local)),
        }
    )
    return path.select(*kept, *added)


def worst_drawdowns(returns: DataFrame, by: str = "series_id", block_days: int = BLOCK_DAYS) -> DataFrame:
    """Worst drawdown, most bars under water and bars from the trough to recovery (0 if none).

    The trough and the way back are aggregates that combine before the shuffle, so no task holds
    a series.
    """
    path = materialise(wealth_path(returns, by, block_days=block_days).select(by, "position", "drawdown", "underwater"))
    worst = path.groupBy(by).agg(
        F.min("drawdown").alias("max_drawdown"),
        F.max("underwater").cast("long").alias("time_underwater"),
        F.min_by("position", F.struct("drawdown", "position")).alias("_trough"),
    )
    back = path.where("drawdown >= -1e-9").join(worst.select(by, "_trough"), by).where("position >= _trough")
    back = back.groupBy(by).agg(F.min("position").alias("_back"))
    out = worst.join(back, by, "left")
    return out.select(
        by, "max_drawdown", "time_underwater", F.coalesce(F.col("_back") - F.col("_trough"), F.lit(0)).cast("long").alias("recovery_time")
    )


def rebased(panel: DataFrame, ticker: str, base: float = 1_000_000.0) -> DataFrame:
    """(date, ticker, equity): one ticker's price as a multiple of its first bar's, times ``base``."""
    one = panel.where(F.col("ticker") == ticker).select("date", "ticker", "adj_close")
    first = one.groupBy("ticker").agg(F.min_by("adj_close", "date").alias("_first"))
    out = one.join(F.broadcast(first), "ticker")  # one row
    return out.select("date", "ticker", (F.col("adj_close") / F.col("_first") * base).alias("equity"))
