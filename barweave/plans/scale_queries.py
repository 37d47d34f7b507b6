"""Registered queries whose operators are built for long series, large groups and many names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators import calendar as cal
from barweave.functions import normal
from barweave.operators import covariance, expanding, labels, metrics, prefix, quantiles, signals, weights
from barweave.operators import features as ft
from barweave.plans.common import BARS, W, r, rounded
from barweave.plans.research_queries import _LR, CAPS, CONSTRAINED, _prices, _series, barrier_sql, constrained_weights
from barweave.plans.risk_queries import _DD, _NAMES, _names, _phi, _psr_sql
from barweave.session import deal, materialise, scratch_path
from barweave.sources import store
from barweave.sources.panel import read_table, scan_laid_out, supplier_panel, write_panel
from barweave.streaming import bars as stream

SLICE = ("1997-03-01", "1999-02-01")
TURNOVER_CAP = 0.25
YEAR_AHEAD = labels.Barriers(pt=2.5, sl=2.5, vertical=252)


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of each event type, built by a stream over the events' files."""
    schema = read_table(spark, d, "events").schema
    ticks = stream.read_ticks(spark, f"{d}/events.parquet", schema).select(
        F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size")
    )
    home = scratch_path(spark, "stream")
    stream.write_bars(stream.daily_bars(ticks), f"{home}/bars", f"{home}/checkpoint")
    return rounded(stream.read_bars(spark, f"{home}/bars").withColumnRenamed("key", "event_type"))


def var_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Value at risk and expected shortfall of all names as one series."""
    return rounded(quantiles.pooled_tail(materialise(_names(spark, d))))


def name_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """The quartiles of each name's returns, by the same bracketing."""
    names = materialise(_names(spark, d))
    parts = [
        quantiles.exact_quantile(names, "r", q, ["series_id"]).select("series_id", F.lit(q).alias("q"), "quantile", "n")
        for q in (0.25, 0.5, 0.75)
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def scan_slice(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth name between two dates, from a panel laid out by bucket and year."""
    path = scratch_path(spark, "panel")
    panel = supplier_panel(spark, d)
    write_panel(panel, path, buckets=8)
    names = read_table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias("ticker")
    )
    return scan_laid_out(spark, path, None, *SLICE).join(names, "ticker", "left_semi").select(*panel.columns)


def quality_bars(spark: SparkSession, d: str) -> DataFrame:
    """The quality score of every name at every bar."""
    return rounded(signals.quality(_prices(spark, d), None, 63))


def turnover_pull(spark: SparkSession, d: str) -> DataFrame:
    """Constrained weights pulled toward those of the decision before."""
    now = materialise(constrained_weights(_prices(spark, d)))
    following = now.select("date").distinct().withColumn("_next", F.lead("date").over(ft.Window.partitionBy(F.lit(0)).orderBy("date")))
    prior = now.join(following, "date").where("_next IS NOT NULL").select(F.col("_next").alias("date"), "ticker", "weight")
    return rounded(weights.pull_toward(now, prior, TURNOVER_CAP), 8)


def _years(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Simple returns of every name by calendar year, and each year's number of trading dates."""
    p = _prices(spark, d)
    asof = F.year("date").alias("asof")
    bars = cal.trading_dates(p).groupBy(asof).agg(F.count(F.lit(1)).alias("n_bars"))
    rows = deal(p, "ticker").withColumn("r", ft.simple_ret()).where("r IS NOT NULL").select(asof, "date", "ticker", "r")
    return materialise(rows), materialise(bars)


def risk_names(spark: SparkSession, d: str) -> DataFrame:
    """Risk contributions of all names under inverse-variance weights, year by year."""
    rows, bars = _years(spark, d)
    held = materialise(covariance.inverse_variance_from_returns(rows, bars))
    return rounded(covariance.contributions_from_returns(held, rows, bars), 8)


def drawdown_path(spark: SparkSession, d: str) -> DataFrame:
    """Wealth, peak and drawdown of every name at every bar, by the scan over blocks of days."""
    return rounded(prefix.wealth_path(_names(spark, d)).drop("r"))


def triple_barrier_year(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a horizon of a year, by descent over blocks."""
    return rounded(labels.triple_barrier(ft.realized_vol(_series(spark, d), 21), barriers=YEAR_AHEAD))


def expanding_median(spark: SparkSession, d: str) -> DataFrame:
    """Each name's return on bars of rising volume, gaps filled by its median so far."""
    bars = materialise(supplier_panel(spark, d).select("date", "ticker", "adj_close", "volume"))
    rising = F.col("volume") > F.lag("volume").over(ft.ordered())
    rows = materialise(deal(bars, "ticker").select("date", "ticker", F.when(rising, ft.log_ret()).alias("x")))
    return rounded(expanding.fill_expanding_median(rows, {"x": "filled"}).select("date", "ticker", "x", "filled"))


def dsr_from_log(spark: SparkSession, d: str) -> DataFrame:
    """Deflated Sharpe of every name, with all names logged as trials and read back."""
    names, log = materialise(_names(spark, d)), scratch_path(spark, "trials")
    store.log_trials(log, "names", {"table": "lineitem"}, names)
    return rounded(metrics.deflated_sharpe_from_log(names, store.read_log(spark, log)))


def _ppf_sql(p: str) -> str:
    """The normal quantile in SQL, from the published coefficients."""

    def rational(table: tuple, x: str) -> str:
        top, below = (" + ".join(f"{c!r}::DOUBLE * power({x}, {7 - i})" for i, c in enumerate(cs)) for cs in table)
        return f"({top}) / ({below})"

    q, root = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {root} <= 5 THEN {rational(normal.PPND_TAIL, f'({root} - 1.6)')} ELSE {rational(normal.PPND_FAR, f'({root} - 5)')} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {rational(normal.PPND_MIDDLE, f'(0.180625 - {q} * {q})')} ELSE sign({q}) * {tail} END"


QUERIES = {
    "stream_bars": stream_bars,
    "var_pooled": var_pooled,
    "name_quartiles": name_quartiles,
    "scan_slice": scan_slice,
    "quality_bars": quality_bars,
    "turnover_pull": turnover_pull,
    "risk_names": risk_names,
    "drawdown_path": drawdown_path,
    "triple_barrier_year": triple_barrier_year,
    "expanding_median": expanding_median,
    "dsr_from_log": dsr_from_log,
}

ORACLES = {
    "stream_bars": f"""SELECT event_type, CAST(ts AS DATE) AS date, {r('arg_min(value, ROW(ts, event_id))', 'open')}, {r('max(value)', 'high')},
        {r('min(value)', 'low')}, {r('arg_max(value, ROW(ts, event_id))', 'close')}, {r('count(*)', 'volume')}, count(*) AS n_ticks
        FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL""",
    "var_pooled": f"""WITH {_NAMES}, c AS (SELECT quantile_cont(r, 1 - 0.95::DOUBLE) AS q, count(*) AS n_obs FROM nr)
        SELECT {r('-any_value(q)', 'var')}, any_value(n_obs) AS n_obs, {r('-avg(r) FILTER (r <= q)', 'es')} FROM nr, c""",
    "name_quartiles": f"""WITH {_NAMES} SELECT series_id, q, {r('list_extract(v, i)', 'quantile')}, n
        FROM (SELECT series_id, quantile_cont(r, [0.25, 0.5, 0.75]) AS v, count(*) AS n FROM nr GROUP BY series_id),
          (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.75::DOUBLE)) AS t(i, q)""",
    "scan_slice": f"""WITH {BARS} SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars
        WHERE CAST(substr(ticker, 2) AS BIGINT) % 5 = 0 AND date >= DATE '{SLICE[0]}' AND date < DATE '{SLICE[1]}'""",
    "quality_bars": f"""WITH {BARS}, {_LR},
        win AS (SELECT a.date AS asof_date, l.ticker, l.date, l.lr FROM lrs a JOIN lrs l
          ON l.ticker = a.ticker AND l.n BETWEEN a.n - 62 AND a.n WHERE a.n >= 64),
        wl AS (SELECT *, product(1 + lr) OVER (PARTITION BY asof_date, ticker ORDER BY date) AS wealth FROM win),
        pk AS (SELECT *, max(wealth) OVER (PARTITION BY asof_date, ticker ORDER BY date) AS peak FROM wl),
        st AS (SELECT asof_date AS date, ticker, avg(lr) * 252 / (stddev_samp(lr) * sqrt(252)) AS sh,
          stddev_samp(lr) * sqrt(252) AS vol, min(wealth / peak - 1) AS dd FROM pk GROUP BY ALL HAVING stddev_samp(lr) > 0),
        z AS (SELECT date, ticker, coalesce(
          0.5 * (sh - avg(sh) OVER d) / nullif(stddev_pop(sh) OVER d, 0)
          - 0.25 * (vol - avg(vol) OVER d) / nullif(stddev_pop(vol) OVER d, 0)
          - 0.25 * (dd - avg(dd) OVER d) / nullif(stddev_pop(dd) OVER d, 0), 0) AS s
          FROM st WINDOW d AS (PARTITION BY date)),
        g AS (SELECT *, sum(abs(s)) OVER (PARTITION BY date) AS gross FROM
          (SELECT date, ticker, CASE WHEN abs(s) >= 1e-12 THEN s ELSE 0 END AS s FROM z))
        SELECT date, ticker, {r('CASE WHEN gross > 0 THEN s / gross ELSE s END', 'score')} FROM g""",
    "turnover_pull": f"""WITH {BARS}, {CONSTRAINED}, d AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM cw)),
        b AS (SELECT c.date, c.ticker, c.weight, coalesce(p.weight, 0) AS prior FROM cw c JOIN d ON c.date = d.date
          LEFT JOIN cw p ON p.date = d.before AND p.ticker = c.ticker),
        t AS (SELECT *, sum(abs(weight - prior)) OVER (PARTITION BY date) AS turnover FROM b)
        SELECT date, ticker, {r(f'prior + CASE WHEN turnover > {TURNOVER_CAP} THEN {TURNOVER_CAP} / turnover ELSE 1 END * (weight - prior)', 'weight', 8)} FROM t""",
    "risk_names": f"""WITH {BARS}, cal AS (SELECT DISTINCT year(date) AS y, date FROM bars),
        rr AS (SELECT year(date) AS y, date, ticker, rt FROM (SELECT date, ticker, adj_close / lag(adj_close) OVER ({W}) - 1 AS rt FROM bars) WHERE rt IS NOT NULL),
        dense AS MATERIALIZED (SELECT c.y, c.date, n.ticker, coalesce(rr.rt, 0) AS x FROM cal c JOIN (SELECT DISTINCT y, ticker FROM rr) n USING (y)
          LEFT JOIN rr ON rr.date = c.date AND rr.ticker = n.ticker),
        v AS (SELECT y, ticker, 1 / var_samp(x) AS w FROM dense GROUP BY y, ticker HAVING var_samp(x) > 0),
        w AS (SELECT y, ticker, w / sum(w) OVER (PARTITION BY y) AS weight FROM v),
        p AS (SELECT y, date, sum(x * weight) AS p FROM dense JOIN w USING (y, ticker) GROUP BY y, date),
        k AS (SELECT y, ticker, weight, weight * covar_samp(x, p) AS risk FROM dense JOIN w USING (y, ticker) JOIN p USING (y, date) GROUP BY y, ticker, weight)
        SELECT y AS "asof", ticker, {r('weight', 'weight', 8)}, {r('risk', 'risk', 8)}, {r('risk / sum(risk) OVER (PARTITION BY y)', 'share', 8)} FROM k""",
    "drawdown_path": f"""WITH {_NAMES}, {_DD} SELECT series_id, date, {r('wealth', 'wealth')}, {r('peak', 'peak')}, {r('dd', 'drawdown')},
        uw AS underwater, k AS position FROM w3""",
    "triple_barrier_year": f"WITH {barrier_sql(YEAR_AHEAD)} SELECT ticker, t0, t1, {r('ret', 'ret')}, bin FROM tb",
    "expanding_median": f"""WITH {BARS}, x AS (SELECT date, ticker,
          CASE WHEN volume > lag(volume) OVER ({W}) THEN ln(adj_close / lag(adj_close) OVER ({W})) END AS x FROM bars)
        SELECT date, ticker, {r('x', 'x')},
          {r(f'coalesce(x, median(x) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 'filled')} FROM x""",
    "dsr_from_log": f"""WITH {_NAMES}, t AS (SELECT series_id, avg(r) / stddev_samp(r) * sqrt(252) AS sr FROM nr GROUP BY 1),
        n AS (SELECT count(*) AS n, stddev_samp(sr) AS sd FROM t),
        m AS (SELECT n, sd * ((1 - {metrics.EULER_GAMMA}) * {_ppf_sql('(1 - 1.0::DOUBLE / n)')}
          + {metrics.EULER_GAMMA} * {_ppf_sql('(1 - 1.0::DOUBLE / (n * exp(1)))')}) AS top FROM n),
        z AS (SELECT series_id, any_value(n) AS n_trials, any_value(top) AS top, {_psr_sql('any_value(top)')} AS z FROM nr, m GROUP BY series_id)
        SELECT series_id, n_trials, {r('top', 'expected_max')}, {r('z', 'z')}, {r(_phi('z'), 'dsr')} FROM z""",
}
