"""Scalar column helpers with the null rules used across the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero or NULL denominator (never an ANSI error)."""
    return F.try_divide(num, den)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp to ``[lo, hi]``; NULL stays NULL although greatest/least skip NULLs."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def positive(x: Column, what: str) -> Column:
    """``x`` itself, failing the job on a value that is not strictly positive."""
    bad = F.raise_error(F.lit(f"{what} must be strictly positive")).cast("double")
    return F.when(x > 0, x).when(x.isNull(), x).otherwise(bad)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, once, at the scan."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )


def finite(x: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
