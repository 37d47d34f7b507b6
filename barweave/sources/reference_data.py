"""Factor-return and macro tables read from files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Factor columns per model, as published in percent.
MODELS = {
    "FF3": ("Mkt-RF", "SMB", "HML", "RF"),
    "FF5": ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF"),
    "FF5+MOM": ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF"),
}

FREQUENCIES = {"daily": "yyyy-MM-dd", "monthly": "yyyyMM"}


def factor_returns(factors: DataFrame, model: str = "FF5+MOM", mom: DataFrame | None = None) -> DataFrame:
    """Percent factor tables to decimals; momentum joins on common dates."""
    if model not in MODELS:
        raise ValueError(f"unsupported model: {model!r}")
    df = factors.select(F.to_date("date").alias("date"), *[F.col(f"`{c}`") for c in MODELS[model]])
    if model == "FF5+MOM":
        if mom is None:
            raise ValueError("FF5+MOM needs the momentum table")
        value = next(c for c in mom.columns if c != "date")
        df = df.join(mom.select(F.to_date("date").alias("date"), F.col(f"`{value}`").alias("MOM")), "date")
    return df.select("date", *[(F.col(f"`{c}`") / 100.0).alias(c) for c in df.columns if c != "date"])


def scan_factors(
    spark: SparkSession, path: str, model: str = "FF5+MOM", mom_path: str | None = None, frequency: str = "daily"
) -> DataFrame:
    """Factor returns from CSV files with a date column and percent values.

    Monthly files name months as ``yyyyMM``; they become the month's first day.
    """
    if model not in MODELS:
        raise ValueError(f"unsupported model: {model!r}")
    if frequency not in FREQUENCIES:
        raise ValueError(f"unsupported frequency: {frequency!r}")
    tables = []
    for file, names in ((path, MODELS[model]), (mom_path, ("MOM",))):
        if file is None:
            tables.append(None)
            continue
        schema = ", ".join(["date string", *[f"`{c}` double" for c in names]])
        df = spark.read.schema(schema).csv(file, header=True)
        tables.append(df.withColumn("date", F.to_date("date", FREQUENCIES[frequency])))
    return factor_returns(tables[0], model, tables[1])


def compound_monthly(factors: DataFrame) -> DataFrame:
    """Monthly returns of daily ones, by the month's first day; a month without values is NULL."""
    names = [c for c in factors.columns if c != "date"]
    month = F.trunc("date", "month").alias("date")
    return factors.groupBy(month).agg(*[(F.product(1 + F.col(f"`{c}`")) - 1).alias(c) for c in names])


def macro_series(sources: dict[str, DataFrame], ids: Sequence[str], start: str, end: str) -> DataFrame:
    """One column per series id over ``start <= date <= end``; a missing day is NULL.

    ``sources`` maps an id to its (date, value) table. The tables are stacked and
    aggregated by date: one shuffle for any number of series.
    """
    unknown = [i for i in ids if i not in sources]
    if unknown:
        raise KeyError(f"unknown series: {unknown}")
    parts = [sources[i].select(F.to_date("date").alias("date"), F.lit(i).alias("id"), "value") for i in ids]
    stacked = reduce(DataFrame.unionByName, parts)
    in_range = stacked.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return in_range.groupBy("date").agg(*[F.max(F.when(F.col("id") == i, F.col("value"))).alias(i) for i in ids])
