"""Windows over one series.

A (series, date) pair is unique in every frame these windows see, so one window
partition holds at most one row per calendar date: the partition is bounded by the
length of the calendar however many raw rows fed the series.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: str | tuple[str, ...] = "ticker", order: str = "date") -> WindowSpec:
    keys = (by,) if isinstance(by, str) else by
    return Window.partitionBy(*keys).orderBy(order)


def cumulative(by: str | tuple[str, ...] = "ticker", order: str = "date") -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(n: int, by: str | tuple[str, ...] = "ticker", order: str = "date") -> WindowSpec:
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def rolling(
    agg: Callable[..., Column], n: int, *xs: Column, by: str | tuple[str, ...] = "ticker"
) -> Column:
    """``agg(*xs)`` over the last ``n`` bars, NULL until all ``n`` bars are present.

    With two inputs the gate counts the bars where both are present.
    """
    if n <= 0:
        raise ValueError("window must be positive")
    w = trailing(n, by)
    present = F.when(reduce(and_, [x.isNotNull() for x in xs]), F.lit(1))
    return F.when(F.count(present).over(w) == n, agg(*xs).over(w))


def lag(x: Column, k: int, by: str | tuple[str, ...] = "ticker") -> Column:
    return F.lag(x, k).over(ordered(by)) if k else x
