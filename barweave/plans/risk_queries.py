"""Registered queries: performance, risk, attribution, audit, report tables and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.functions.normal import norm_ppf
from barweave.operators import attribution, bootstrap, execution, metrics, risk, validation, weights
from barweave.operators import audit as audit_op
from barweave.operators import calendar as cal
from barweave.operators import features as ft
from barweave.plans.common import BARS, MARKET, SECTORS, SLEEVES, W, gated, r, roll, rounded
from barweave.plans.portfolio_queries import _PORT, book, closes, performance_sql
from barweave.plans.research_queries import CONSTRAINED, TSMOM, _tsmom
from barweave.session import materialise
from barweave.sources import reference_data
from barweave.sources.panel import (
    market_panel,
    read_table,
    supplier_panel,
    supplier_sectors,
    supplier_series,
)

# The reference's crisis windows moved into the years these tables cover, one of them empty.
WINDOWS = (
    ("first", "1995-09-01", "1996-03-31"),
    ("middle", "1998-02-15", "1998-04-15"),
    ("last", "2000-01-01", "2000-10-31"),
    ("outside", "2008-09-01", "2009-03-31"),
)
N_TRIALS = 25


def _series(panel: DataFrame) -> DataFrame:
    out = panel.select("date", "ticker", "adj_close").withColumn("r", ft.simple_ret())
    return out.where("r IS NOT NULL").select(F.col("ticker").alias("series_id"), "date", "r")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _series(supplier_series(spark, d))


def performance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.performance(_names(spark, d)), 5)


def moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.moments(_names(spark, d)))


def psr_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.probabilistic_sharpe(_names(spark, d)).drop("psr"))


def dsr_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.deflated_sharpe(_names(spark, d), N_TRIALS).drop("dsr"))


def psr(spark: SparkSession, d: str) -> DataFrame:
    """The probabilities themselves."""
    p = metrics.probabilistic_sharpe(_names(spark, d)).drop("z")
    return rounded(p.join(metrics.deflated_sharpe(_names(spark, d), N_TRIALS).drop("z"), "series_id"))


def _var(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return rounded(risk.value_at_risk(_names(spark, d), method))

    return query


def expected_shortfall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.expected_shortfall(_names(spark, d)))


def drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.drawdowns(_names(spark, d)))


def kelly(spark: SparkSession, d: str) -> DataFrame:
    k = risk.fractional_kelly(_names(spark, d))
    vol = _names(spark, d).groupBy("series_id").agg((F.stddev_samp("r") * 252**0.5).alias("_v"))
    scaled = k.join(vol, "series_id").withColumn("vol_scale", risk.vol_target_scale(F.col("_v"), 0.10))
    return rounded(scaled.drop("_v"))


def stress_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = risk.stress_rows(_names(spark, d), WINDOWS)
    return rounded(rows.select("series_id", "window", "date", "r"))


def stress(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.historical_stress(_names(spark, d), WINDOWS), 5)


def audit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit_op.audit_panel(supplier_series(spark, d)))


def per_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_year(_names(spark, d)), 5)


def rolling_sharpe_beta(spark: SparkSession, d: str) -> DataFrame:
    bench = market_panel(spark, d).withColumn("b", ft.simple_ret()).select("date", "b")
    return rounded(metrics.rolling_sharpe_beta(_names(spark, d), bench, 252))


def return_hist(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.histogram(_names(spark, d), 60))


def normal_overlay(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.normal_overlay(_names(spark, d), 200))


def equity_table(spark: SparkSession, d: str) -> DataFrame:
    curve = supplier_series(spark, d).select(F.col("ticker").alias("series_id"), "date", F.col("adj_close").alias("equity"))
    return rounded(metrics.normalised_equity(curve))


def kpis(spark: SparkSession, d: str) -> DataFrame:
    panel = closes(spark, d)
    w = book(panel)
    turn = weights.turnover(w).withColumn("series_id", F.lit("tsmom"))
    rets = materialise(execution.portfolio_returns(w, panel))
    return rounded(metrics.kpis(rets, N_TRIALS, turn))


def factor_table(spark: SparkSession, d: str) -> DataFrame:
    """Three factors in decimals: the market, and two spreads between regions."""
    p = _names(spark, d).withColumnRenamed("series_id", "ticker").join(supplier_sectors(spark, d), "ticker")

    def region(name: str):
        return F.avg(F.when(F.col("sector") == name, F.col("r")))

    return p.groupBy("date").agg(
        F.avg("r").alias("Mkt-RF"),
        (region("AMERICA") - region("ASIA")).alias("SMB"),
        (region("EUROPE") - region("AFRICA")).alias("HML"),
        F.lit(0.0001).alias("RF"),
    )


def factor_returns(spark: SparkSession, d: str) -> DataFrame:
    f = factor_table(spark, d)
    percent = f.select("date", *[(F.col(f"`{c}`") * 100).alias(c) for c in ("Mkt-RF", "SMB", "HML", "RF")])
    out = reference_data.factor_returns(percent, "FF3")
    return rounded(out.withColumnsRenamed({"Mkt-RF": "mkt", "SMB": "smb", "HML": "hml", "RF": "rf"}))


def factor_beta(spark: SparkSession, d: str) -> DataFrame:
    """One-factor exposure of every name to the market index, with robust t statistics."""
    bench = market_panel(spark, d).withColumn("mkt", ft.simple_ret()).select("date", "mkt")
    return rounded(attribution.factor_exposure(_names(spark, d), bench, ["mkt"]))


def fama_french(spark: SparkSession, d: str) -> DataFrame:
    return rounded(attribution.fama_french_betas(_names(spark, d), materialise(factor_table(spark, d))))


def macro_series(spark: SparkSession, d: str) -> DataFrame:
    """One column per event type, over all days of the table."""
    ev = read_table(spark, d, "events").where("event_type IS NOT NULL AND ts IS NOT NULL")
    day = F.to_date("ts").alias("date")
    kinds = sorted(r["event_type"] for r in ev.select("event_type").distinct().collect())  # the result's columns
    ends = ev.agg(F.min("ts"), F.max("ts")).first()
    tables = {t: ev.where(F.col("event_type") == t).groupBy(day).agg(F.avg("value").alias("value")) for t in kinds}
    if not tables:
        return ev.select(day)
    return rounded(reference_data.macro_series(tables, kinds, str(ends[0].date()), str(ends[1].date())))


def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    days = cal.trading_dates(supplier_panel(spark, d))
    rolling = validation.walk_forward(days, 2, 1).withColumn("mode", F.lit("rolling"))
    expanding = validation.walk_forward(days, 3, 1, "expanding").withColumn("mode", F.lit("expanding"))
    return rolling.unionByName(expanding)


def cpcv_splits(spark: SparkSession, d: str) -> DataFrame:
    obs = _names(spark, d).select("series_id", "date")
    splits = validation.cpcv_splits(obs, 6, 2, 5, keep_purged=True)
    return splits.groupBy("series_id", "split_id", "role").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("obs_id").alias("first"), F.max("obs_id").alias("last")
    )


def cpcv_sharpes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validation.cpcv_sharpes(_names(spark, d)))


def cpcv_hist(spark: SparkSession, d: str) -> DataFrame:
    s = materialise(validation.cpcv_sharpes(_names(spark, d)).withColumn("sharpe", F.round("sharpe", 9)))
    return rounded(metrics.histogram(s, 20, "sharpe").drop("density"), 5)


def purged_kfold(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_series(spark, d).select("ticker", "date").withColumn("_n", ft.bar_number())
    size = F.max("_n").over(ft.Window.partitionBy("ticker"))
    spans = p.select(
        F.col("ticker").alias("series_id"), "date", F.least(F.col("_n") + 9, size - 1).alias("end_pos")
    )
    folds = validation.purged_kfold(spans, 5, 5, keep_purged=True)
    return folds.groupBy("series_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("obs_id").alias("first"), F.max("obs_id").alias("last")
    )


CUTOFF = "1999-06-30"


def lookahead_check(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_panel(spark, d).select("date", "ticker", "adj_close")
    return validation.lookahead_check(lambda x: _tsmom(x, None), p, CUTOFF)


def regime_sharpe(spark: SparkSession, d: str) -> DataFrame:
    vol = ft.realized_vol(market_panel(spark, d), 21).select("date", F.round("vol", 9).alias("value"))
    return rounded(validation.regime_sharpe(_names(spark, d), vol))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.bootstrap_ci(_names(spark, d), bootstrap.var_statistic("historical"), 1000))


def var_interval(spark: SparkSession, d: str) -> DataFrame:
    """Value at risk of every name with its interval, by each method."""
    return rounded(bootstrap.var_with_interval(materialise(_names(spark, d))))


def stationary_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.stationary_sharpe_ci(_names(spark, d), 1000))


QUERIES = {
    "performance": performance,
    "moments": moments,
    "psr_z": psr_z,
    "dsr_z": dsr_z,
    "psr": psr,
    "var_parametric": _var("parametric"),
    "var_historical": _var("historical"),
    "var_cornish_fisher": _var("cornish_fisher"),
    "expected_shortfall": expected_shortfall,
    "drawdowns": drawdowns,
    "kelly": kelly,
    "stress_rows": stress_rows,
    "stress": stress,
    "audit": audit,
    "kpis": kpis,
    "per_year": per_year,
    "rolling_sharpe_beta": rolling_sharpe_beta,
    "return_hist": return_hist,
    "normal_overlay": normal_overlay,
    "equity_table": equity_table,
    "factor_returns": factor_returns,
    "factor_beta": factor_beta,
    "fama_french": fama_french,
    "macro_series": macro_series,
    "walk_forward": walk_forward,
    "cpcv_splits": cpcv_splits,
    "cpcv_sharpes": cpcv_sharpes,
    "cpcv_hist": cpcv_hist,
    "purged_kfold": purged_kfold,
    "lookahead_check": lookahead_check,
    "regime_sharpe": regime_sharpe,
    "bootstrap_ci": bootstrap_ci,
    "stationary_bootstrap": stationary_bootstrap,
    "var_interval": var_interval,
}

# --- SQL twins -------------------------------------------------------------

_NAMES = f"""{BARS}, nr AS MATERIALIZED (SELECT * FROM (SELECT ticker AS series_id, date,
  adj_close / lag(adj_close) OVER ({W}) - 1 AS r FROM bars) WHERE r IS NOT NULL)"""
_SL = f"""{SLEEVES}, nr AS MATERIALIZED (SELECT * FROM (SELECT ticker AS series_id, date,
  adj_close / lag(adj_close) OVER ({W}) - 1 AS r FROM sleeves) WHERE r IS NOT NULL)"""
_S = "PARTITION BY series_id ORDER BY date"
_SR1 = "(avg(r) / stddev_samp(r))"


def _psr_sql(benchmark: float | str) -> str:
    return (
        f"({_SR1} - {benchmark} / sqrt(252)) * sqrt(count(r) - 1) / "
        f"sqrt(1 - skewness(r) * {_SR1} + (kurtosis(r) - 1) / 4 * {_SR1} * {_SR1})"
    )


def _phi(z: str) -> str:
    """The normal distribution function as its series in odd powers; terms by logarithms."""
    term = f"exp((2 * k + 1) * ln(abs({z})) - {z} * {z} / 2 - lgamma(2 * k + 2) + k * ln(2::DOUBLE) + lgamma(k + 1))"
    series = f"list_sum(list_transform(range(0, 200), lambda k: {term}))"
    return (
        f"CASE WHEN {z} = 0 THEN 0.5 WHEN {z} > 9 THEN 1.0 WHEN {z} < -9 THEN 0.0 "
        f"ELSE 0.5 + sign({z}) * {series} / sqrt(2 * pi()) END"
    )


_Z = norm_ppf(0.05)
_CF = (
    f"({_Z!r} + ({_Z**2 - 1!r}) / 6 * skewness(r) + ({_Z**3 - 3 * _Z!r}) / 24 * kurtosis(r) "
    f"- ({2 * _Z**3 - 5 * _Z!r}) / 36 * skewness(r) * skewness(r))"
)
_VARS = {
    "var_parametric": f"-(avg(r) + stddev_samp(r) * ({_Z!r}))",
    "var_historical": f"-quantile_cont(r, {1 - 0.95!r})",
    "var_cornish_fisher": f"-(avg(r) + stddev_samp(r) * {_CF})",
}
_WINDOW_ROWS = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WINDOWS)
_DD = f"""w1 AS (SELECT series_id, date, r, product(1 + r) OVER ({_S}) AS wealth, row_number() OVER ({_S}) AS k FROM nr),
  w2 AS (SELECT *, max(wealth) OVER ({_S}) AS peak FROM w1),
  w3 AS (SELECT *, wealth / peak - 1 AS dd, k - max(k) FILTER (wealth >= peak) OVER ({_S}) AS uw FROM w2)"""
_FACTORS = f"""{SECTORS}, fx AS (SELECT date, avg(r) AS mkt,
  avg(r) FILTER (sector = 'AMERICA') - avg(r) FILTER (sector = 'ASIA') AS smb,
  avg(r) FILTER (sector = 'EUROPE') - avg(r) FILTER (sector = 'AFRICA') AS hml, 0.0001::DOUBLE AS rf
  FROM nr JOIN sectors ON sectors.ticker = nr.series_id GROUP BY date)"""


def _positions_sql(groups: int) -> str:
    return f"""ob AS (SELECT *, row_number() OVER ({_S}) - 1 AS obs_id,
      count(*) OVER (PARTITION BY series_id) // {groups} AS q, count(*) OVER (PARTITION BY series_id) % {groups} AS e FROM src),
    gr AS (SELECT *, CASE WHEN obs_id < e * (q + 1) THEN obs_id // (q + 1) ELSE e + (obs_id - e * (q + 1)) // q END AS g
      FROM ob),
    bd AS (SELECT series_id, g, min(obs_id) AS lo, max(obs_id) AS hi FROM gr GROUP BY ALL)"""


def _combos_sql(groups: int) -> str:
    return f"""cb AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split_id, a, b FROM
      (SELECT i.range AS a, j.range AS b FROM range({groups}) i, range({groups}) j WHERE i.range < j.range))"""


_KPI_CORE = performance_sql("port")

ORACLES = {
    "performance": f"WITH {_NAMES}, {performance_sql('nr', 5)}",
    "moments": f"""WITH {_NAMES} SELECT series_id, {r('avg(r)', 'mean')}, {r('stddev_samp(r)', 'sd')},
        {r('skewness(r)', 'skew')}, {r('kurtosis(r)', 'kurt')} FROM nr GROUP BY series_id""",
    "psr_z": f"WITH {_NAMES} SELECT series_id, {r(_psr_sql(0.0), 'z')} FROM nr GROUP BY series_id",
    "psr": f"""WITH {_NAMES}, z AS (SELECT series_id, {_psr_sql(0.0)} AS p,
          {_psr_sql(metrics.expected_max_sharpe(N_TRIALS))} AS d FROM nr GROUP BY series_id)
        SELECT series_id, {r(_phi('p'), 'psr')}, {r(_phi('d'), 'dsr')} FROM z""",
    "dsr_z": f"""WITH {_NAMES} SELECT series_id, {r(_psr_sql(metrics.expected_max_sharpe(N_TRIALS)), 'z')}
        FROM nr GROUP BY series_id""",
    **{
        k: f"WITH {_NAMES} SELECT series_id, {r(v, 'var')}, count(*) AS n_obs FROM nr GROUP BY series_id"
        for k, v in _VARS.items()
    },
    "expected_shortfall": f"""WITH {_NAMES}, q AS (SELECT series_id, quantile_cont(r, {1 - 0.95!r}) AS c FROM nr GROUP BY 1)
        SELECT series_id, {r('-avg(r)', 'es')} FROM nr JOIN q USING (series_id) WHERE r <= c GROUP BY series_id""",
    "drawdowns": f"""WITH {_NAMES}, {_DD}, tr AS (SELECT series_id, min(dd) AS mdd, max(uw) AS uw,
          arg_min(k, ROW(dd, k)) AS t FROM w3 GROUP BY series_id),
        bk AS (SELECT series_id, min(k) AS b FROM w3 JOIN tr USING (series_id) WHERE k >= t AND dd >= -1e-9 GROUP BY series_id)
        SELECT series_id, {r('mdd', 'max_drawdown')}, uw AS time_underwater, coalesce(b - t, 0) AS recovery_time
        FROM tr LEFT JOIN bk USING (series_id)""",
    "kelly": f"""WITH {_NAMES} SELECT series_id, {r('0.25 * avg(r) * 252 / (var_samp(r) * 252)', 'kelly')},
        {r('0.1 / (stddev_samp(r) * sqrt(252))', 'vol_scale')} FROM nr GROUP BY series_id""",
    "stress_rows": f"""WITH {_NAMES}, wn AS (SELECT * FROM (VALUES {_WINDOW_ROWS}) AS v(name, lo, hi))
        SELECT series_id, name AS "window", date, {r('r', 'r')} FROM nr JOIN wn ON date BETWEEN lo AND hi""",
    "stress": f"""WITH {_NAMES}, wn AS (SELECT * FROM (VALUES {_WINDOW_ROWS}) AS v(name, lo, hi)),
        rw AS (SELECT series_id, name, date, r FROM nr JOIN wn ON date BETWEEN lo AND hi),
        a AS (SELECT *, product(1 + r) OVER (PARTITION BY series_id, name ORDER BY date) AS wealth FROM rw),
        b AS (SELECT *, max(wealth) OVER (PARTITION BY series_id, name ORDER BY date) AS peak,
          quantile_cont(r, 0.05) OVER (PARTITION BY series_id, name) AS c FROM a),
        m AS (SELECT series_id, name, product(1 + r) - 1 AS total, avg(r) / stddev_samp(r) * sqrt(252) AS sh,
          min(wealth / peak - 1) AS mdd, -avg(r) FILTER (r <= c) AS es, count(*) AS n FROM b GROUP BY ALL)
        SELECT s.series_id, wn.name AS "window", {r('total', 'total_return', 5)}, {r('sh', 'sharpe', 5)},
          {r('mdd', 'max_drawdown', 5)}, {r('es', 'es_95', 5)}, coalesce(n, 0) AS n_obs
        FROM (SELECT DISTINCT series_id FROM nr) s CROSS JOIN wn
        LEFT JOIN m ON m.series_id = s.series_id AND m.name = wn.name""",
    "audit": f"""WITH {BARS}, a AS (SELECT *, ln(adj_close / lag(adj_close) OVER ({W})) AS lr,
          CASE WHEN coalesce(abs(adj_close - lag(adj_close) OVER ({W})), 0) = 0 THEN 1 ELSE 0 END AS same FROM bars),
        b AS (SELECT *, CASE WHEN sum(same) OVER {roll(5)} >= 5 THEN 1.0::DOUBLE ELSE 0 END AS stale,
          CASE WHEN abs((lr - avg(lr) OVER (PARTITION BY ticker)) / stddev_pop(lr) OVER (PARTITION BY ticker)) > 8
            THEN 1 ELSE 0 END AS spike FROM a),
        t AS (SELECT avg(stale) AS st FROM b GROUP BY ticker),
        g AS (SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS date_min, max(date) AS date_max,
          {', '.join(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS missing_{c}" for c in audit_op.VALUE_COLUMNS)},
          avg(CASE WHEN volume = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zero_volume_fraction,
          (SELECT avg(st) FROM t) AS stale_price_fraction, sum(spike) AS return_spike_count FROM b)
        SELECT n_rows, n_tickers, date_min, date_max,
          {', '.join(r(f'missing_{c}', f'missing_{c}') for c in audit_op.VALUE_COLUMNS)},
          {r('zero_volume_fraction', 'zero_volume_fraction')}, {r('stale_price_fraction', 'stale_price_fraction')},
          CAST(return_spike_count AS BIGINT) AS return_spike_count, return_spike_count = 0 AND missing_close < 0.01 AS is_clean,
          missing_adj_close > 0.01 AS prices_missing, zero_volume_fraction > 0.05 AS volume_idle,
          stale_price_fraction > 0.02 AS prices_stale, return_spike_count > 0 AS returns_spike,
          '' AS missing_columns FROM g""",
    "kpis": f"""WITH {BARS}, {CONSTRAINED}, {_PORT},
        ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM dec),
        nm AS (SELECT ds.date, ds.prev, cw.ticker FROM ds JOIN cw ON cw.date = ds.date UNION
          SELECT ds.date, ds.prev, cw.ticker FROM ds JOIN cw ON cw.date = ds.prev),
        tn AS (SELECT nm.date, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS t FROM nm
          LEFT JOIN cw a ON a.date = nm.date AND a.ticker = nm.ticker
          LEFT JOIN cw b ON b.date = nm.prev AND b.ticker = nm.ticker GROUP BY nm.date),
        zs AS (SELECT {_psr_sql(0.0)} AS pz, {_psr_sql(metrics.expected_max_sharpe(N_TRIALS))} AS dz FROM port),
        {_KPI_CORE.replace('FROM pf4', f", {r('pz', 'psr_z')}, {r('dz', 'dsr_z')}, {r(_phi('pz'), 'psr')}, {r(_phi('dz'), 'dsr')}, (SELECT round(avg(t), 6) + 0.0 FROM tn) AS avg_turnover FROM pf4, zs")}""",
    "per_year": f"""WITH {_NAMES} SELECT series_id, CAST(year(date) AS INTEGER) AS year,
        {r('product(1 + r) - 1', 'total_return', 5)}, {r('stddev_samp(r) * sqrt(252)', 'vol', 5)},
        {r('avg(r) / nullif(stddev_samp(r), 0) * sqrt(252)', 'sharpe', 5)} FROM nr GROUP BY ALL""",
    "rolling_sharpe_beta": f"""WITH {_NAMES}, {MARKET}, mb AS (SELECT date, adj_close / lag(adj_close) OVER ({W}) - 1 AS b FROM market),
        x AS (SELECT nr.series_id AS ticker, nr.date, r, b FROM nr LEFT JOIN mb USING (date))
        SELECT ticker AS series_id, date,
          {r(gated('avg(r)', 'r', 252) + ' / ' + gated('stddev_samp(r)', 'r', 252) + ' * sqrt(252)', 'roll_sharpe')},
          {r(gated('covar_samp(r, b)', 'r + b', 252) + ' / ' + gated('var_samp(b)', 'b', 252), 'roll_beta')} FROM x""",
    "return_hist": f"""WITH {_NAMES}, e AS (SELECT series_id, min(r) AS lo, (max(r) - min(r)) / 60 AS w, count(*) AS n FROM nr GROUP BY 1),
        b AS (SELECT series_id, lo, w, n, CAST(least(59, floor((r - lo) / w)) AS INTEGER) AS bin FROM nr JOIN e USING (series_id))
        SELECT series_id, bin, {r('lo + bin * w', 'left_edge')}, count(*) AS count, {r('count(*) / (n * w)', 'density')}
        FROM b GROUP BY series_id, bin, lo, w, n""",
    "normal_overlay": f"""WITH {_NAMES}, f AS (SELECT series_id, min(r) AS lo, max(r) AS hi, avg(r) AS m, stddev_samp(r) AS s FROM nr GROUP BY 1),
        g AS (SELECT f.*, CAST(i.range AS INTEGER) AS point, lo + (hi - lo) * i.range / 199 AS x FROM f, range(200) i)
        SELECT series_id, point, {r('x', 'x')}, {r('exp(-0.5 * power((x - m) / s, 2)) / (s * sqrt(2 * pi()))', 'density')} FROM g""",
    "equity_table": f"""WITH {_NAMES}, {_DD} SELECT b.ticker AS series_id, b.date,
        {r(f'b.adj_close / first_value(b.adj_close) OVER (PARTITION BY b.ticker ORDER BY b.date)', 'norm_equity')},
        {r('dd', 'drawdown')} FROM bars b LEFT JOIN w3 ON w3.series_id = b.ticker AND w3.date = b.date""",
    "factor_returns": f"""WITH {_NAMES}, {_FACTORS} SELECT date, {', '.join(r(c, c) for c in ('mkt', 'smb', 'hml', 'rf'))} FROM fx""",
    "factor_beta": f"""WITH {_NAMES}, {MARKET}, mb AS (SELECT date, adj_close / lag(adj_close) OVER ({W}) - 1 AS b FROM market),
        x AS (SELECT series_id, date, r, b FROM nr JOIN mb USING (date) WHERE b IS NOT NULL),
        o AS (SELECT series_id, regr_slope(r, b) AS be, regr_intercept(r, b) AS al, regr_r2(r, b) AS r2, count(*) AS n,
          greatest(1, floor(4 * power(count(*) / 100.0::DOUBLE, 2.0::DOUBLE / 9))) AS lag_, count(*) AS c, sum(b) AS sb, sum(b * b) AS sbb
          FROM x GROUP BY series_id),
        u AS (SELECT series_id, row_number() OVER ({_S}) AS k, r - al - be * b AS s0, (r - al - be * b) * b AS s1 FROM x JOIN o USING (series_id)),
        ul AS MATERIALIZED (SELECT u.*, q.range AS l, k - q.range AS kk FROM u JOIN o USING (series_id) JOIN range(12) q ON q.range <= lag_),
        gm AS (SELECT p.series_id, p.l, sum(p.s0 * v.s0) AS g00, sum(p.s0 * v.s1 + p.s1 * v.s0) AS g01, sum(p.s1 * v.s1) AS g11
          FROM ul p JOIN u v ON v.series_id = p.series_id AND v.k = p.kk GROUP BY ALL),
        mt AS (SELECT series_id, sum(w * g00) AS a00, sum(w * g01) / 2 AS a01, sum(w * g11) AS a11 FROM (SELECT gm.*,
          CASE WHEN l = 0 THEN 1.0::DOUBLE ELSE 2 * (1 - l / (lag_ + 1.0)) END AS w FROM gm JOIN o USING (series_id)) GROUP BY series_id),
        t AS (SELECT o.*, n * sbb - sb * sb AS det, a00, a01, a11 FROM o JOIN mt USING (series_id)),
        vv AS (SELECT *, (sbb * sbb * a00 - 2 * sbb * sb * a01 + sb * sb * a11) / (det * det) AS va,
          (sb * sb * a00 - 2 * sb * n * a01 + n * n * a11) / (det * det) AS vb FROM t)
        SELECT series_id, 'alpha' AS factor, {r('al', 'beta')}, {r('al / sqrt(va)', 't_stat')}, {r('r2', 'r_squared')}, n AS n_obs,
          CAST(lag_ AS INTEGER) AS lag FROM vv
        UNION ALL SELECT series_id, 'mkt', {r('be', 'beta')}, {r('be / sqrt(vb)', 't_stat')}, {r('r2', 'r_squared')}, n,
          CAST(lag_ AS INTEGER) FROM vv""",
    "macro_series": """PIVOT (SELECT CAST(ts AS DATE) AS date, event_type, round(CAST(avg(value) AS DOUBLE), 6) + 0.0 AS value FROM events
        WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL) ON event_type USING max(value) GROUP BY date""",
    "walk_forward": f"""WITH {BARS}, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n
          FROM (SELECT DISTINCT date FROM bars)),
        f AS (SELECT 'rolling' AS mode, i.range AS fold, 504 + i.range * 252 AS s, i.range * 252 AS a FROM range(50) i
          UNION ALL SELECT 'expanding', i.range, 756 + i.range * 252, 0 FROM range(50) i)
        SELECT mode, CAST(fold AS INTEGER) AS fold, x.date AS train_start, y.date AS train_end, z.date AS test_start, w.date AS test_end
        FROM f JOIN c x ON x.p = a JOIN c y ON y.p = s - 1 JOIN c z ON z.p = s JOIN c w ON w.p = s + 251""",
    "cpcv_splits": f"""WITH {_NAMES}, src AS (SELECT series_id, date FROM nr), {_positions_sql(6)}, {_combos_sql(6)},
        rl AS (SELECT gr.series_id, split_id, obs_id, CASE WHEN gr.g IN (a, b) THEN 'test'
          WHEN obs_id BETWEEN x.lo - 5 AND x.hi + 5 OR obs_id BETWEEN y.lo - 5 AND y.hi + 5 THEN 'purged' ELSE 'train' END AS role
          FROM gr CROSS JOIN cb JOIN bd x ON x.series_id = gr.series_id AND x.g = a JOIN bd y ON y.series_id = gr.series_id AND y.g = b)
        SELECT series_id, CAST(split_id AS INTEGER) AS split_id, role, count(*) AS n_obs, CAST(min(obs_id) AS INTEGER) AS first,
          CAST(max(obs_id) AS INTEGER) AS last FROM rl GROUP BY ALL""",
    "cpcv_sharpes": f"""WITH {_NAMES}, src AS (SELECT * FROM nr), {_positions_sql(10)}, {_combos_sql(10)}
        SELECT series_id, CAST(split_id AS INTEGER) AS split_id, {r('avg(r) / stddev_samp(r) * sqrt(252)', 'sharpe')}, count(*) AS n_obs
        FROM gr JOIN cb ON g IN (a, b) GROUP BY ALL HAVING count(*) >= 30""",
    "cpcv_hist": f"""WITH {_NAMES}, src AS (SELECT * FROM nr), {_positions_sql(10)}, {_combos_sql(10)},
        s AS (SELECT series_id, split_id, round(avg(r) / stddev_samp(r) * sqrt(252), 9) AS x FROM gr JOIN cb ON g IN (a, b)
          GROUP BY ALL HAVING count(*) >= 30),
        e AS (SELECT series_id, min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM s GROUP BY 1)
        SELECT series_id, CAST(least(19, floor((x - lo) / w)) AS INTEGER) AS bin,
          {r('lo + least(19, floor((x - lo) / w)) * w', 'left_edge', 5)}, count(*) AS count
        FROM s JOIN e USING (series_id) GROUP BY ALL""",
    "purged_kfold": f"""WITH {BARS}, src AS (SELECT ticker AS series_id, date, least(row_number() OVER ({W}) + 9,
          count(*) OVER (PARTITION BY ticker) - 1) AS end_pos FROM bars), {_positions_sql(5)},
        te AS (SELECT series_id, g, min(obs_id) AS lo, max(obs_id) AS hi, max(end_pos) AS known FROM gr GROUP BY ALL),
        rl AS (SELECT gr.series_id, te.g AS fold, obs_id, CASE WHEN gr.g = te.g THEN 'test'
          WHEN obs_id <= greatest(te.known, te.hi + 5) AND end_pos >= te.lo THEN 'purged' ELSE 'train' END AS role
          FROM gr JOIN te ON te.series_id = gr.series_id)
        SELECT series_id, CAST(fold AS INTEGER) AS fold, role, count(*) AS n_obs, CAST(min(obs_id) AS INTEGER) AS first,
          CAST(max(obs_id) AS INTEGER) AS last FROM rl GROUP BY ALL""",
    "lookahead_check": f"""WITH {BARS}, {TSMOM} SELECT count(*) AS n_same, 0::BIGINT AS n_changed FROM stat
        WHERE n >= 170 AND sd > 0 AND mom IS NOT NULL AND date <= DATE '{CUTOFF}'""",
    "regime_sharpe": f"""WITH {_NAMES}, {MARKET}, ml AS (SELECT date, ticker, ln(adj_close / lag(adj_close) OVER ({W})) AS lr FROM market),
        mv AS (SELECT date, round({gated('stddev_samp(lr)', 'lr', 21)}, 9) AS v FROM ml),
        rg AS (SELECT date, CAST(ntile(3) OVER (ORDER BY v, date) AS INTEGER) AS regime FROM mv WHERE v IS NOT NULL)
        SELECT series_id, regime, {r('avg(r) / stddev_samp(r) * sqrt(252)', 'sharpe')}, count(*) AS n_obs
        FROM nr JOIN rg USING (date) GROUP BY ALL""",
}
