"""Shared pieces of the registered queries: rounding and the SQL panel views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, exact: frozenset[str] = frozenset(), **per_column: int) -> DataFrame:
    """Round floating columns so that both engines' last bits compare equal.

    ``exact`` columns are bit-equal already and stay as they are.
    """
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(
        *[
            (F.round(c, per_column.get(c, digits)) + F.lit(0.0)).alias(c) if c in floating - exact else F.col(c)
            for c in df.columns
        ]
    )


def r(expr: str, name: str, digits: int = 6) -> str:
    """The SQL twin of :func:`rounded` for one column."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


_SEQ = "ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)"
_BAR = f"""
    arg_min(l_extendedprice / l_quantity, {_SEQ}) AS open,
    max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, {_SEQ}) AS close,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS adj_close,
    sum(l_quantity) AS volume"""
_DATE = "CAST(l_shipdate AS DATE) AS date"
_TICKER = "'S' || lpad(CAST({} AS VARCHAR), 10, '0')"

BARS = f"""bars AS MATERIALIZED (
  SELECT {_TICKER.format('l_suppkey')} AS ticker, {_DATE}, {_BAR}
  FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"""

SECTORS = f"""sectors AS (
  SELECT {_TICKER.format('s_suppkey')} AS ticker, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SLEEVES = f"""sleeves AS MATERIALIZED (
  SELECT r_name || ':' || l_linestatus AS ticker, r_name AS sector, {_DATE}, {_BAR}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE l_quantity > 0 GROUP BY ALL)"""

MARKET = f"""market AS MATERIALIZED (
  SELECT 'MKT' AS ticker, {_DATE}, {_BAR} FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"""

W = "PARTITION BY ticker ORDER BY date"


def roll(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gated(agg: str, present: str, n: int) -> str:
    """``agg`` over the last ``n`` bars once ``n`` values of ``present`` are there."""
    return f"CASE WHEN count({present}) OVER {roll(n)} = {n} THEN {agg} OVER {roll(n)} END"


def calendar_sql(panel: str = "bars") -> str:
    """CTEs ``cal`` (trading dates) and ``reb`` (business-month-start decisions)."""
    return f"""cal AS (SELECT DISTINCT date FROM {panel}),
    months AS (SELECT date, CAST(date_trunc('month', date) AS DATE) AS m,
      CAST(date_trunc('month', date) - INTERVAL 1 MONTH AS DATE) AS pm FROM cal),
    anchored AS (SELECT date, {_bms('m')} AS this, {_bms('pm')} AS prev FROM months),
    anchors AS (SELECT DISTINCT CASE WHEN date >= this THEN this ELSE prev END AS anchor FROM anchored),
    reb AS MATERIALIZED (SELECT DISTINCT (SELECT min(c.date) FROM cal c WHERE c.date >= a.anchor) AS date
      FROM anchors a)"""


def _bms(m: str) -> str:
    return f"({m} + CAST(CASE dayofweek({m}) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS INTEGER))"


def asof_sql(source: str, cols: str, name: str = "aligned", dates: str = "reb") -> str:
    """CTE: the last row of every ticker in ``source`` at each decision date."""
    picked = ", ".join(f"b.{c.strip()}" for c in cols.split(","))
    return f"""{name} AS MATERIALIZED (
      SELECT g.date, g.ticker, b.date AS bar_date, {picked}
      FROM (SELECT d.date, t.ticker FROM {dates} d CROSS JOIN (SELECT DISTINCT ticker FROM {source}) t) g
      ASOF JOIN {source} b ON g.ticker = b.ticker AND g.date >= b.date)"""
