"""Registered queries: scans, calendars, features and cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators import calendar as cal
from barweave.operators import cross_section as cs
from barweave.operators import features as ft
from barweave.plans.common import BARS, SECTORS, SLEEVES, W, asof_sql, calendar_sql, gated, r, roll, rounded
from barweave.session import materialise
from barweave.sources.membership import members_on
from barweave.sources.panel import (
    read_table,
    select_panel,
    sleeve_panel,
    supplier_panel,
    supplier_sectors,
    supplier_series,
)

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
ASOF_DATES = tuple(f"{y}-06-30" for y in range(1995, 2002))
DELISTED_BEFORE = "2001-10-25"


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return ft.simple_returns(supplier_series(spark, d))


def panel_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    return select_panel(supplier_panel(spark, d))


def wide_prices(spark: SparkSession, d: str) -> DataFrame:
    sleeves = materialise(sleeve_panel(spark, d).select("date", "ticker", "adj_close"))
    names = sorted(r["ticker"] for r in sleeves.select("ticker").distinct().collect())  # the result's columns
    wide = sleeves.groupBy("date").pivot("ticker", names).agg(F.first("adj_close"))
    return wide.select("date", *[F.col(f"`{t}`").alias(_plain(t)) for t in names])


def _plain(ticker: str) -> str:
    return "px_" + ticker.lower().replace(" ", "_").replace(":", "_")


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Listing intervals taken from each name's first and last trade."""
    li = read_table(spark, d, "lineitem").where("l_quantity > 0")
    day = F.to_date("l_shipdate")
    spans = li.groupBy("l_suppkey").agg(F.min(day).alias("start_date"), F.max(day).alias("last"))
    return spans.select(
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("ticker"),
        "start_date",
        F.when(F.col("last") < F.lit(DELISTED_BEFORE).cast("date"), F.col("last")).alias("end_date"),
    )


def members_asof(spark: SparkSession, d: str) -> DataFrame:
    return members_on(membership(spark, d), ASOF_DATES)


def rebalance_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = supplier_panel(spark, d)
    parts = [cal.rebalance_dates(days, f).select(F.lit(f).alias("freq"), "date") for f in cal.FREQUENCIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def last_bar_asof(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_panel(spark, d).select("date", "ticker", "adj_close")
    return cal.asof_last(p, cal.rebalance_dates(p)).select("date", "ticker", "bar_date", "adj_close")


def log_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.log_returns(supplier_series(spark, d)).select("date", "ticker", "log_ret"))


def simple_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_returns(spark, d).select("date", "ticker", "ret"))


def cumulative_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.cumulative_returns(_returns(spark, d)).select("date", "ticker", "cum_ret"))


def rebuilt_prices(spark: SparkSession, d: str) -> DataFrame:
    p = ft.log_returns(supplier_series(spark, d))
    return rounded(ft.rebuild_prices(p, base=100.0).select("date", "ticker", "rebuilt"))


def frac_diff(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_series(spark, d).withColumn("lp", F.ln("adj_close"))
    return rounded(ft.frac_diff(p, "lp", 0.4, 1e-2).select("date", "ticker", "frac_diff"))


def momentum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.momentum(supplier_series(spark, d), 252, 21).select("date", "ticker", "mom"))


def _vol(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        v = ft.realized_vol(supplier_series(spark, d), 21, method)
        return rounded(v.select("date", "ticker", "vol", ft.annualise_vol(F.col("vol")).alias("vol_annual")))

    return query


def cs_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = cs.cs_rank(_returns(spark, d).select("date", "ticker", "ret"), "ret")
    return rounded(ranked.select("date", "ticker", "cs_rank"))


def cs_zscore(spark: SparkSession, d: str) -> DataFrame:
    z = cs.cs_zscore(_returns(spark, d).select("date", "ticker", "ret"), "ret")
    return rounded(z.select("date", "ticker", "cs_z"))


def sector_neutral(spark: SparkSession, d: str) -> DataFrame:
    p = _returns(spark, d).select("date", "ticker", "ret").join(supplier_sectors(spark, d), "ticker")
    out = cs.sector_neutralize(p, "ret", "sector")
    return rounded(out.select("date", "ticker", "sector", "neutral"))


def amihud(spark: SparkSession, d: str) -> DataFrame:
    p = _returns(spark, d).withColumn("dv", F.col("adj_close") * F.col("volume"))
    return rounded(ft.amihud(p, "ret", "dv").select("date", "ticker", "amihud"), 10)


def roll_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.roll_spread(supplier_series(spark, d)).select("date", "ticker", "spread"), 4)


def kyle_lambda(spark: SparkSession, d: str) -> DataFrame:
    p = ft.signed_dollar_volume(_returns(spark, d))
    return rounded(ft.kyle_lambda(p, "ret", "signed_volume").select("date", "ticker", "kyle"), 10)


def dist_high(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.dist_high(supplier_series(spark, d)).select("date", "ticker", "dist_high"))


def frac_diff_long(spark: SparkSession, d: str) -> DataFrame:
    """The filter of a model frame: some 280 weights."""
    p = supplier_series(spark, d).select("date", "ticker", F.ln("adj_close").alias("lp"))
    return rounded(ft.frac_diff(p, "lp", 0.4, 1e-4).select("date", "ticker", "frac_diff"))


def feature_frame(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.feature_frame(supplier_series(spark, d)), amihud_21=10)


QUERIES = {
    "panel_ohlcv": panel_ohlcv,
    "wide_prices": wide_prices,
    "members_asof": members_asof,
    "rebalance_calendar": rebalance_calendar,
    "last_bar_asof": last_bar_asof,
    "log_returns": log_returns,
    "simple_returns": simple_returns,
    "cumulative_returns": cumulative_returns,
    "rebuilt_prices": rebuilt_prices,
    "frac_diff": frac_diff,
    "frac_diff_long": frac_diff_long,
    "momentum": momentum,
    "vol_close": _vol("close_to_close"),
    "vol_parkinson": _vol("parkinson"),
    "vol_garman_klass": _vol("garman_klass"),
    "vol_yang_zhang": _vol("yang_zhang"),
    "cs_rank": cs_rank,
    "cs_zscore": cs_zscore,
    "sector_neutral": sector_neutral,
    "amihud": amihud,
    "roll_spread": roll_spread,
    "kyle_lambda": kyle_lambda,
    "dist_high": dist_high,
    "feature_frame": feature_frame,
}

_RET = f"""rets AS (SELECT *, adj_close / lag(adj_close) OVER ({W}) - 1 AS ret,
  ln(adj_close / lag(adj_close) OVER ({W})) AS lr FROM bars)"""
_LOGS = f"""x AS (SELECT *, ln(adj_close / lag(adj_close) OVER ({W})) AS cc,
  power(ln(high / low), 2) AS hl2, power(ln(adj_close / open), 2) AS co2,
  ln(open / lag(adj_close) OVER ({W})) AS ov, ln(adj_close / open) AS oc,
  ln(high / adj_close) * ln(high / open) + ln(low / adj_close) * ln(low / open) AS rs FROM bars)"""
_LN2 = "ln(2::DOUBLE)"
_K = f"(0.34 / (1.34 + {22 / 20!r}))"
_VOLS = {
    "vol_close": gated("stddev_samp(cc)", "cc", 21),
    "vol_parkinson": f"sqrt({gated('avg(hl2)', 'hl2', 21)} / (4 * {_LN2}))",
    "vol_garman_klass": (
        "sqrt(greatest(0, "
        + gated(f"avg(0.5 * hl2 - (2 * {_LN2} - 1) * co2)", "hl2", 21)
        + f")) + CASE WHEN count(*) OVER {roll(21)} = 21 THEN 0 END"
    ),
    "vol_yang_zhang": (
        f"CASE WHEN count(ov) OVER {roll(21)} = 21 THEN sqrt(greatest(0, var_samp(ov) OVER {roll(21)} "
        f"+ {_K} * var_samp(oc) OVER {roll(21)} + (1 - {_K}) * avg(rs) OVER {roll(21)})) END"
    ),
}
_FD = " ".join(
    f"{w:+.17g} * lag(lp, {k}) OVER ({W})" if k else f"{w:.17g} * lp"
    for k, w in enumerate(ft.ffd_weights(0.4, 1e-2))
)
_LONG = ft.ffd_weights(0.4, 1e-4)

ORACLES = {
    "panel_ohlcv": f"""WITH {BARS} SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars""",
    "wide_prices": f"""PIVOT (WITH {SLEEVES} SELECT date, 'px_' || lower(replace(replace(ticker, ' ', '_'), ':', '_')) AS name, adj_close
        FROM sleeves) ON name USING max(adj_close) GROUP BY date""",
    "members_asof": f"""WITH {BARS}, m AS (SELECT ticker, min(date) AS s, max(date) AS e FROM bars GROUP BY ticker),
        a AS (SELECT unnest([{', '.join(f"DATE '{x}'" for x in ASOF_DATES)}]) AS asof_date)
        SELECT asof_date, ticker FROM a, m
        WHERE asof_date >= s AND asof_date <= CASE WHEN e < DATE '{DELISTED_BEFORE}' THEN e ELSE DATE '9999-12-31' END""",
    "rebalance_calendar": f"""WITH {BARS}, {calendar_sql()},
        fri AS (SELECT DISTINCT date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS anchor FROM cal),
        weekly AS (SELECT DISTINCT (SELECT min(c.date) FROM cal c WHERE c.date >= f.anchor) AS date FROM fri f)
        SELECT 'D' AS freq, date FROM cal UNION ALL
        SELECT 'W-FRI', date FROM weekly WHERE date IS NOT NULL UNION ALL
        SELECT 'BMS', date FROM reb""",
    "last_bar_asof": f"""WITH {BARS}, {calendar_sql()}, {asof_sql('bars', 'adj_close')}
        SELECT date, ticker, bar_date, adj_close FROM aligned""",
    "log_returns": f"WITH {BARS}, {_RET} SELECT date, ticker, {r('lr', 'log_ret')} FROM rets",
    "simple_returns": f"WITH {BARS}, {_RET} SELECT date, ticker, {r('ret', 'ret')} FROM rets",
    "cumulative_returns": f"""WITH {BARS}, {_RET} SELECT date, ticker,
        {r(f'''CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER ({W}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END''', 'cum_ret')} FROM rets""",
    "rebuilt_prices": f"""WITH {BARS}, {_RET} SELECT date, ticker,
        {r(f'''CASE WHEN lr IS NOT NULL THEN 100 * exp(sum(lr) OVER ({W}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END''', 'rebuilt')} FROM rets""",
    "frac_diff_long": f"""WITH {BARS}, x AS (SELECT date, ticker, list(ln(adj_close)) OVER {roll(len(_LONG))} AS l FROM bars)
        SELECT date, ticker, {r(f"CASE WHEN len(l) = {len(_LONG)} THEN list_inner_product(l, {_LONG[::-1]}::DOUBLE[]) END", 'frac_diff')}
        FROM x""",
    "frac_diff": f"""WITH {BARS}, x AS (SELECT *, ln(adj_close) AS lp FROM bars)
        SELECT date, ticker, {r(_FD, 'frac_diff')} FROM x""",
    "momentum": f"""WITH {BARS} SELECT date, ticker,
        {r(f'lag(adj_close, 21) OVER ({W}) / lag(adj_close, 273) OVER ({W}) - 1', 'mom')} FROM bars""",
    **{
        name: f"""WITH {BARS}, {_LOGS}, v AS (SELECT date, ticker, {sql} AS vol FROM x)
        SELECT date, ticker, {r('vol', 'vol')}, {r('vol * sqrt(252)', 'vol_annual')} FROM v"""
        for name, sql in _VOLS.items()
    },
    "cs_rank": f"""WITH {BARS}, {_RET}, k AS (SELECT date, ticker, ret,
          rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) AS lo,
          count(*) OVER (PARTITION BY date, ret) AS ties,
          count(ret) OVER (PARTITION BY date) AS n FROM rets)
        SELECT date, ticker, {r('CASE WHEN ret IS NOT NULL THEN (lo + (ties - 1) / 2.0) / n - 0.5 END', 'cs_rank')}
        FROM k""",
    "cs_zscore": f"""WITH {BARS}, {_RET} SELECT date, ticker,
        {r('''(ret - avg(ret) OVER (PARTITION BY date))
           / nullif(stddev_pop(ret) OVER (PARTITION BY date), 0)''', 'cs_z')} FROM rets""",
    "sector_neutral": f"""WITH {BARS}, {_RET}, {SECTORS} SELECT date, ticker, sector,
        {r('ret - avg(ret) OVER (PARTITION BY date, sector)', 'neutral')} FROM rets JOIN sectors USING (ticker)""",
    "amihud": f"""WITH {BARS}, {_RET}, x AS (SELECT *, abs(ret) / nullif(adj_close * volume, 0) AS il FROM rets)
        SELECT date, ticker, {r(gated('avg(il)', 'il', 21), 'amihud', 10)} FROM x""",
    "roll_spread": f"""WITH {BARS}, a AS (SELECT *, close - lag(close) OVER ({W}) AS dp FROM bars),
        b AS (SELECT *, lag(dp) OVER ({W}) AS dp1 FROM a),
        c AS (SELECT *, {gated('covar_samp(dp, dp1)', 'dp + dp1', 21)} AS cv FROM b)
        SELECT date, ticker, {r('CASE WHEN cv IS NOT NULL THEN 2 * sqrt(greatest(0, -cv)) END', 'spread', 4)} FROM c""",
    "kyle_lambda": f"""WITH {BARS}, {_RET}, a AS (SELECT *, sign(ret) * volume * adj_close AS v FROM rets),
        k AS (SELECT date, ticker, CASE WHEN count(*) OVER {roll(21)} = 21 THEN
          sum(ret * v) OVER {roll(21)} / nullif(sum(v * v) OVER {roll(21)}, 0) END AS kyle
          FROM a WHERE ret IS NOT NULL AND v IS NOT NULL)
        SELECT a.date, a.ticker, {r('kyle', 'kyle', 10)} FROM a LEFT JOIN k USING (date, ticker)""",
    "dist_high": f"""WITH {BARS} SELECT date, ticker,
        {r('adj_close / (' + gated('max(adj_close)', 'adj_close', 252) + ') - 1', 'dist_high')} FROM bars""",
    "feature_frame": f"""WITH {BARS}, {_RET}, x AS (SELECT *, ln(adj_close) AS lp,
          abs(coalesce(ret, 0)) / nullif(adj_close * volume, 0) AS il,
          list(ln(adj_close)) OVER {roll(len(_LONG))} AS l,
          count(*) OVER (PARTITION BY ticker) AS n FROM rets)
        SELECT date, ticker, {', '.join(r(f'adj_close / lag(adj_close, {n}) OVER ({W}) - 1', f'mom_{n}') for n in (5, 21, 63, 252))},
          {', '.join(r(gated('stddev_samp(lr)', 'lr', n), f'vol_{n}') for n in (21, 63))},
          {r(f"CASE WHEN len(l) = {len(_LONG)} THEN list_inner_product(l, {_LONG[::-1]}::DOUBLE[]) END", 'fd_lp')}, {r(gated('avg(il)', 'il', 21), 'amihud_21', 10)},
          {r('adj_close / (' + gated('max(adj_close)', 'adj_close', 252) + ') - 1', 'dist_52w_high')}
        FROM x WHERE n >= 260""",
}
