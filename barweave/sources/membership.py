"""Point-in-time universe membership."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.constants import ETF_BASKET

MEMBERSHIP_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
    ]
)
OPEN_END = "9999-12-31"


def scan_membership(spark: SparkSession, path: str) -> DataFrame:
    """Membership CSV; an empty end date means still listed."""
    return spark.read.schema(MEMBERSHIP_SCHEMA).csv(path, header=True)


def members_on(membership: DataFrame, asof: Sequence[str | date]) -> DataFrame:
    """(asof_date, ticker) for every interval containing each date, both ends inclusive.

    The dates are parameters, so each row is matched against a constant array: no join,
    no shuffle before the final de-duplication of overlapping intervals.
    """
    days = F.array(*[F.lit(str(d)).cast("date") for d in asof])
    end = F.coalesce(F.col("end_date"), F.lit(OPEN_END).cast("date"))
    inside = F.filter(days, lambda d: (d >= F.col("start_date")) & (d <= end))
    return membership.select(F.explode(inside).alias("asof_date"), "ticker").distinct()


def etf_basket(spark: SparkSession) -> DataFrame:
    """The default cross-asset universe as a one-column frame, for a semi join."""
    return spark.createDataFrame([(t,) for t in ETF_BASKET], "ticker string")
