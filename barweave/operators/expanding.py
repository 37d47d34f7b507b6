"""Quantiles of everything seen so far, row by row.

The distinct values of a series are numbered in order; a number is read as digits. Every row asks
for the value of a given rank among the rows up to itself. It descends digit by digit: in each
bucket of numbers that agree so far, running counts per next digit, in row order, say which
bucket holds the rank and how many values lie below. The work is one running count per digit over
(series, bucket), so no row sorts or scans the rows before it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.rolling import cumulative, ordered
from barweave.session import deal, materialise

RADIX = 16


def expanding_quantile(
    df: DataFrame, value: str, q: float = 0.5, by: str = "ticker", order: str = "date", name: str = "quantile", radix: int = RADIX
) -> DataFrame:
    """(by, order, name): the ``q`` quantile of ``value`` over the rows up to and with each one.

    Linear between the two ranks around ``(n - 1) q``. NULL and NaN values are not counted; before
    the first value the result is NULL. (by, order) is unique.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be between 0 and 1")
    if radix < 2:
        raise ValueError("radix must be at least 2")
    x = F.col(value).cast("double")
    rows = deal(df, by).select(F.col(by).alias("_s"), F.col(order).alias("_o"), F.when(~F.isnan(x), x + 0.0).alias("_x"))
    place = (cumulative("_s", "_o"), Window.partitionBy("_s").orderBy("_x"))
    rows = rows.withColumns(
        {
            "_at": F.row_number().over(ordered("_s", "_o")),
            "_n": F.count("_x").over(place[0]),
            # NULL sorts first: where there is one, the first value has number 1. Any dense numbers do.
            "_code": F.when(F.col("_x").isNotNull(), F.dense_rank().over(place[1]).cast("long")),
        }
    )
    rows = materialise(rows)
    most = rows.agg(F.max("_code")).first()[0]
    digits = 1
    while radix**digits <= (most or 0):
        digits += 1

    spot = (F.col("_n") - 1) * F.lit(float(q))
    low = F.floor(spot).cast("long")
    ranks = F.array_distinct(F.array(low, F.least(low + 1, F.col("_n") - 1)))
    asked = rows.where("_n > 0").select("_s", "_at", F.explode(ranks).alias("_k"))
    asked = asked.select("_s", "_at", "_k", F.col("_k").alias("_rank"), F.lit(0).cast("long").alias("_bucket"))
    values = rows.where("_code IS NOT NULL").select("_s", "_at", "_code")
    for level in range(digits - 1, -1, -1):
        asked = _descend(asked, values, radix, level)
        if level and (digits - level) % 3 == 0:
            asked = materialise(asked)
    found = asked.select("_s", "_at", "_rank", F.col("_bucket").alias("_code"))
    known = rows.where("_code IS NOT NULL").groupBy("_s", "_code").agg(F.first("_x").alias("_v"))
    same = [F.col("a._s").eqNullSafe(F.col("b._s")), F.col("a._code") == F.col("b._code")]
    found = found.alias("a").join(known.alias("b"), same).select("a._s", "a._at", "_rank", "_v")
    pair = found.groupBy("_s", "_at").agg(F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"))
    same = [F.col("a._s").eqNullSafe(F.col("b._s")), F.col("a._at") == F.col("b._at")]
    part = spot - F.floor(spot)
    out = rows.alias("a").join(pair.alias("b"), same, "left")
    return out.select(
        F.col("a._s").alias(by), F.col("_o").alias(order), (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias(name)
    )


def _descend(asked: DataFrame, values: DataFrame, radix: int, level: int) -> DataFrame:
    """The queries one digit further: their bucket, and the rank that is left inside it."""
    shift = radix**level
    prefix = F.floor(F.col("_code") / (shift * radix)).cast("long")
    digit = (F.floor(F.col("_code") / shift) % radix).cast("int")
    blank = F.lit(None)
    data = values.select(
        "_s", "_at", prefix.alias("_bucket"), digit.alias("_digit"), blank.cast("long").alias("_k"), blank.cast("long").alias("_rank")
    )
    queries = asked.select("_s", "_at", "_bucket", blank.cast("int").alias("_digit"), "_k", "_rank")
    # A row's own value counts for its query, so values go before queries of the same place.
    so_far = (
        Window.partitionBy("_s", "_bucket").orderBy("_at", F.col("_k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    both = deal(data.unionByName(queries), "_s", "_bucket")
    both = both.withColumns({f"_c{d}": F.count(F.when(F.col("_digit") == d, 1)).over(so_far) for d in range(radix)})
    upto = [F.lit(0).cast("long")]
    for d in range(radix):
        upto.append(upto[-1] + F.col(f"_c{d}"))
    sums = F.array(*upto)
    passed = F.size(F.filter("_upto", lambda c: c <= F.col("_k"))) - 1
    moved = both.where("_k IS NOT NULL").withColumn("_upto", sums).withColumn("_d", passed)
    return moved.select(
        "_s", "_at", (F.col("_k") - F.element_at("_upto", F.col("_d") + 1)).alias("_k"), "_rank", (F.col("_bucket") * radix + F.col("_d")).alias("_bucket")
    )


def fill_expanding_median(df: DataFrame, columns: Mapping[str, str] | list[str], by: str = "ticker", order: str = "date") -> DataFrame:
    """``df`` with gaps (NULL or NaN) in ``columns`` filled by the series' median so far.

    A gap before the first value stays. A mapping names the filled columns; a list fills in place.
    No row sees a later one.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    out = df
    for source, target in names.items():
        seen = expanding_quantile(df, source, 0.5, by, order, "_median").select(
            F.col(by).alias("_by"), F.col(order).alias("_order"), "_median"
        )
        gap = F.col(source).isNull() | F.isnan(F.col(source).cast("double"))
        filled: Column = F.when(gap, F.col("_median")).otherwise(F.col(source))
        same = [F.col(by).eqNullSafe(F.col("_by")), F.col(order).eqNullSafe(F.col("_order"))]
        out = out.join(seen, same, "left").withColumn(target, filled).drop("_by", "_order", "_median")
    return out
