"""Registered queries: labels, signals and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators import covariance, labels, ml, pairs, signals, weights
from barweave.operators import calendar as cal
from barweave.operators import features as ft
from barweave.operators import information as info
from barweave.plans.common import BARS, MARKET, SLEEVES, W, asof_sql, calendar_sql, gated, r, roll, rounded
from barweave.session import deal, materialise
from barweave.sources.panel import market_panel, sleeve_panel, supplier_panel

BARRIERS = labels.Barriers(pt=1.0, sl=1.0, vertical=10, min_ret=0.05)
LOOKBACK, SKIP, VOL_WINDOW = 120, 10, 40
ROUNDS = 200


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """Supplier prices, written once: the calendar and the signals read the bars, not the trades."""
    return materialise(supplier_panel(spark, d).select("date", "ticker", "adj_close"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    """The same prices dealt by ticker, where windows are all that is read."""
    return deal(_prices(spark, d), "ticker")


def _sleeves(spark: SparkSession, d: str) -> DataFrame:
    """Sleeve prices, written once: ten names, but a star join over all trades behind them."""
    return materialise(sleeve_panel(spark, d).select("date", "ticker", "adj_close", "sector"))


def _market(spark: SparkSession, d: str) -> DataFrame:
    return materialise(market_panel(spark, d).select("date", "ticker", "adj_close"))


def _months(panel: DataFrame) -> DataFrame:
    return cal.rebalance_dates(panel, "BMS")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.triple_barrier(ft.realized_vol(_series(spark, d), 21), barriers=BARRIERS)


def triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_labels(spark, d))


def meta_labels(spark: SparkSession, d: str) -> DataFrame:
    calls = ft.momentum(_series(spark, d), 21).select("date", "ticker", F.signum("mom").alias("pred"))
    return labels.meta_labels(calls, _labels(spark, d)).select("date", "ticker", "meta")


def forward_return(spark: SparkSession, d: str) -> DataFrame:
    return rounded(labels.forward_return(_series(spark, d), 21).select("date", "ticker", "fwd_ret"))


def _tsmom(p: DataFrame, dates: DataFrame | None) -> DataFrame:
    return signals.tsmom(p, dates, LOOKBACK, SKIP, VOL_WINDOW)


def tsmom(spark: SparkSession, d: str) -> DataFrame:
    p = _prices(spark, d)
    return rounded(_tsmom(p, _months(p)))


def xsmom(spark: SparkSession, d: str) -> DataFrame:
    p = _prices(spark, d)
    return rounded(signals.xsmom(p, _months(p), LOOKBACK, SKIP, 0.10))


def carry(spark: SparkSession, d: str) -> DataFrame:
    p = _prices(spark, d)
    return rounded(signals.carry(p, _months(p), LOOKBACK, SKIP), 8)


def quality(spark: SparkSession, d: str) -> DataFrame:
    p = _prices(spark, d)
    return rounded(signals.quality(p, _months(p), 63))


def ou(spark: SparkSession, d: str) -> DataFrame:
    p = _sleeves(spark, d)
    return rounded(signals.ou_mean_reversion(p, _market(spark, d), _months(p), 63, entry_z=1.0))


def ou_fit(spark: SparkSession, d: str) -> DataFrame:
    p = _sleeves(spark, d)
    resid = signals.ou_residuals(p, _market(spark, d), _months(p), 63)
    return rounded(signals.ou_fit(resid, ("asof", "ticker")).withColumnRenamed("asof", "date"), 5)


def half_life(spark: SparkSession, d: str) -> DataFrame:
    p = _sleeves(spark, d)
    resid = signals.ou_residuals(p, _market(spark, d), _months(p), 63)
    hl = signals.half_life(resid, ("asof", "ticker")).withColumnRenamed("asof", "date")
    return rounded(hl.withColumn("half_life", F.nullif("half_life", F.lit(float("inf")))), 5)


def pairs_zscore(spark: SparkSession, d: str) -> DataFrame:
    p = _sleeves(spark, d)
    found = pairs.screen_pairs(p, _months(p), 126, entry_z=1.0, stop_z=4.0, adf_threshold=None)
    return rounded(found.drop("adf_p"))


def pairs_screen(spark: SparkSession, d: str) -> DataFrame:
    p = _sleeves(spark, d)
    return rounded(pairs.pairs_trade(p, _months(p), window=126, entry_z=1.0))


def _ic_input(spark: SparkSession, d: str) -> DataFrame:
    p = labels.forward_return(ft.momentum(_series(spark, d), 21), 5)
    return p.select("date", "ticker", F.col("mom").alias("score"), "fwd_ret")


def ic_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.information_coefficient(_ic_input(spark, d)).drop("p_value"))


def ic_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.ic_bootstrap(_ic_input(spark, d), n_bootstrap=500))


def blended_scores(spark: SparkSession, d: str) -> DataFrame:
    p = _prices(spark, d)
    months = _months(p)
    return signals.blend([(0.6, _tsmom(p, months)), (0.4, signals.carry(p, months, LOOKBACK, SKIP))])


def blend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(blended_scores(spark, d))


def ml_gbt(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on labels known by the end of 1999, scored at the month starts after it."""
    p = materialise(supplier_panel(spark, d))
    return rounded(ml.ml_signal(deal(p, "ticker"), _months(p), "1999-12-31", BARRIERS, n_estimators=ROUNDS))


def monthly_scores(p: DataFrame) -> DataFrame:
    """Momentum scores at month starts, written once for the cross-section steps."""
    return materialise(_tsmom(p, _months(p)))


def equal_weight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weights.equal_weight(monthly_scores(_prices(spark, d))), 8)


# Unit prices of these tables jump by orders of magnitude from day to day, so the book is small.
CAPS = weights.Constraints(max_weight=0.002, min_weight=-0.001, gross_leverage=0.05)


def constrained_weights(p: DataFrame) -> DataFrame:
    scores = monthly_scores(p).select("date", "ticker", F.col("score").alias("weight"))
    return weights.apply_constraints(scores, CAPS)


def constrained(spark: SparkSession, d: str) -> DataFrame:
    return rounded(constrained_weights(_prices(spark, d)), 8)


def _complete(spark: SparkSession, d: str) -> DataFrame:
    """Sleeve log returns of the last 250 calendar dates at the yearly decision dates."""
    p = _sleeves(spark, d)
    logs = p.withColumn("r", ft.log_ret()).where("r IS NOT NULL").select("date", "ticker", "r")
    years = cal.trading_dates(p).groupBy(F.year("date")).agg(F.max("date").alias("date")).select("date")
    windows = cal.in_windows(logs, years, 250, by=None, calendar=p.select("date"))
    return materialise(covariance.complete_cases(windows, ["asof"]))


def cov_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.pair_cov(_complete(spark, d)).withColumnRenamed("asof", "date"))


def sector_pairs(p: DataFrame) -> DataFrame:
    """Every two names (a < b) of a sector."""
    names = p.select("sector", F.col("ticker").alias("a")).distinct()
    return names.join(names.withColumnRenamed("a", "b"), "sector").where("a < b").select("a", "b")


def ticker_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Common history of the line statuses of each region, a list of pairs that the data give."""
    p = _sleeves(spark, d)
    years = cal.trading_dates(p).groupBy(F.year("date")).agg(F.max("date").alias("date")).select("date")
    return pairs.common_windows(p, years, sector_pairs(p), 250)


def corr_distance(spark: SparkSession, d: str) -> DataFrame:
    cov = materialise(covariance.pair_cov(_complete(spark, d)))
    return rounded(covariance.correlations(cov).select(F.col("asof").alias("date"), "a", "b", "rho", "distance"))


def inverse_variance(spark: SparkSession, d: str) -> DataFrame:
    cov = materialise(covariance.pair_cov(_complete(spark, d)))
    return rounded(covariance.inverse_variance(cov).withColumnRenamed("asof", "date"))


def ledoit_wolf(spark: SparkSession, d: str) -> DataFrame:
    df = _complete(spark, d)
    lw = covariance.ledoit_wolf(df, materialise(covariance.pair_cov(df)))
    return rounded(lw.withColumnRenamed("asof", "date"))


def risk_contrib(spark: SparkSession, d: str) -> DataFrame:
    cov = materialise(covariance.pair_cov(_complete(spark, d)))
    w = covariance.inverse_variance(cov)
    return rounded(covariance.risk_contributions(w, cov).withColumnRenamed("asof", "date"))


QUERIES = {
    "triple_barrier": triple_barrier,
    "meta_labels": meta_labels,
    "forward_return": forward_return,
    "tsmom": tsmom,
    "xsmom": xsmom,
    "carry": carry,
    "quality": quality,
    "ou": ou,
    "ou_fit": ou_fit,
    "half_life": half_life,
    "ticker_pairs": ticker_pairs,
    "pairs_zscore": pairs_zscore,
    "pairs_screen": pairs_screen,
    "ic_spearman": ic_spearman,
    "ic_interval": ic_interval,
    "blend": blend,
    "ml_gbt": ml_gbt,
    "equal_weight": equal_weight,
    "constrained": constrained,
    "cov_pairs": cov_pairs,
    "corr_distance": corr_distance,
    "inverse_variance": inverse_variance,
    "ledoit_wolf": ledoit_wolf,
    "risk_contrib": risk_contrib,
}

# --- SQL twins -------------------------------------------------------------

_LR = f"lrs AS (SELECT *, ln(adj_close / lag(adj_close) OVER ({W})) AS lr, row_number() OVER ({W}) AS n FROM bars)"
def barrier_sql(b: labels.Barriers) -> str:
    return f"""{BARS}, {_LR},
  v AS (SELECT date, ticker, n, ln(adj_close) AS lp, {gated('stddev_samp(lr)', 'lr', 21)} AS vol FROM lrs),
  ahead AS (SELECT a.ticker, a.date AS t0, a.vol, b.date AS d, b.n - a.n AS k, b.lp - a.lp AS m
    FROM v a JOIN v b ON a.ticker = b.ticker AND b.n BETWEEN a.n + 1 AND a.n + {b.vertical}
    WHERE a.vol IS NOT NULL),
  hits AS (SELECT ticker, t0,
      min(k) FILTER (m >= {b.pt} * vol) AS up, min(k) FILTER (m <= -{b.sl} * vol) AS dn, max(k) AS last
    FROM ahead GROUP BY ALL),
  touch AS (SELECT *, CASE WHEN coalesce(up, 999) < coalesce(dn, 999) THEN up
      WHEN coalesce(dn, 999) < coalesce(up, 999) THEN dn ELSE last END AS k,
      CASE WHEN coalesce(up, 999) < coalesce(dn, 999) THEN 1
      WHEN coalesce(dn, 999) < coalesce(up, 999) THEN -1 ELSE 0 END AS side FROM hits),
  tb AS (SELECT v.ticker, v.date AS t0, coalesce(h.d, v.date) AS t1, coalesce(h.m, 0) AS ret,
      CASE WHEN abs(coalesce(h.m, 0)) < {b.min_ret} THEN 0 ELSE coalesce(t.side, 0) END AS bin
    FROM v LEFT JOIN touch t ON v.ticker = t.ticker AND v.date = t.t0
      LEFT JOIN ahead h ON h.ticker = t.ticker AND h.t0 = t.t0 AND h.k = t.k
    WHERE v.vol IS NOT NULL)"""


_TB = barrier_sql(BARRIERS)

_MOM = f"lag(adj_close, {SKIP}) OVER ({W}) / lag(adj_close, {SKIP + LOOKBACK}) OVER ({W}) - 1"


def _momentum_sql(panel: str = "bars") -> str:
    return f"""stat AS (SELECT date, ticker, {_MOM} AS mom, row_number() OVER ({W}) AS n,
      {gated('stddev_samp(lr)', 'lr', VOL_WINDOW)} AS sd
      FROM (SELECT *, ln(adj_close / lag(adj_close) OVER ({W})) AS lr FROM {panel})),
    {calendar_sql(panel)}, {asof_sql('stat', 'mom, n, sd')}"""


_SCORES = f"""ts AS (SELECT date, ticker, sign(mom) * 0.1 / (sd * sqrt(252)) AS score FROM aligned
    WHERE n >= {LOOKBACK + SKIP + VOL_WINDOW} AND sd > 0 AND mom IS NOT NULL)"""
TSMOM = f"""{_momentum_sql()}, {_SCORES},
  mm AS (SELECT date, ticker, mom FROM aligned WHERE n >= {LOOKBACK + SKIP + 1} AND mom IS NOT NULL)"""
_CARRY = """ca AS (SELECT date, ticker, tanh(mom) / sum(abs(tanh(mom))) OVER (PARTITION BY date) AS score FROM mm)"""

_OU = f"""{SLEEVES}, {MARKET}, {calendar_sql('sleeves')},
  t AS (SELECT date, ticker, ln(adj_close) AS y, row_number() OVER ({W}) AS n FROM sleeves),
  m AS (SELECT date, ticker, ln(adj_close) AS x, row_number() OVER ({W}) AS n FROM market),
  {asof_sql('t', 'n', 'tat')}, {asof_sql('m', 'n', 'mat')},
  tw AS (SELECT a.date AS asof_date, t.ticker, t.date, t.y FROM tat a JOIN t
    ON t.ticker = a.ticker AND t.n BETWEEN a.n - 62 AND a.n WHERE a.n >= 65),
  mw AS (SELECT a.date AS asof_date, m.date, m.x FROM mat a JOIN m ON m.n BETWEEN a.n - 62 AND a.n),
  both_ AS (SELECT * FROM tw JOIN mw USING (asof_date, date)),
  co AS (SELECT asof_date, ticker, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
    FROM both_ GROUP BY ALL HAVING count(*) >= 31),
  res AS MATERIALIZED (SELECT asof_date, ticker, date, y - (b * x + a) AS e FROM both_ JOIN co USING (asof_date, ticker)),
  lagged AS (SELECT *, lag(e) OVER (PARTITION BY asof_date, ticker ORDER BY date) AS e1 FROM res),
  ar AS (SELECT asof_date, ticker, regr_slope(e, e1) AS b, regr_intercept(e, e1) AS a, arg_max(e, date) AS last,
    regr_slope(e - e1, e1) AS s FROM lagged GROUP BY ALL),
  sig AS (SELECT asof_date, ticker, stddev_samp(e - (b * e1 + a)) AS se FROM lagged JOIN ar USING (asof_date, ticker)
    GROUP BY ALL),
  fit AS (SELECT asof_date AS date, ticker, last, CASE WHEN b > 0 AND b < 1 THEN -ln(b) END AS theta,
    CASE WHEN b > 0 AND b < 1 THEN a / (1 - b) END AS mu,
    CASE WHEN b > 0 AND b < 1 THEN se * sqrt(2 * -ln(b) / (1 - b * b)) END AS sigma
    FROM ar JOIN sig USING (asof_date, ticker))"""

_PAIR_WINDOW = """num AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM cal),
  win AS (SELECT d.date AS asof_date, c.date FROM {dates} d JOIN num n ON n.date = d.date
    JOIN num c ON c.pos BETWEEN n.pos - {n1} AND n.pos WHERE n.pos >= {n2}),
  px AS (SELECT w.asof_date, w.date, s.ticker, ln(s.adj_close) AS lp FROM win w JOIN sleeves s ON s.date = w.date),
  ab AS (SELECT a.asof_date, a.date, a.ticker AS a, b.ticker AS b, a.lp AS y, b.lp AS x
    FROM px a JOIN px b ON a.asof_date = b.asof_date AND a.date = b.date AND a.ticker < b.ticker)"""
_YEARS = "years AS (SELECT max(date) AS date FROM cal GROUP BY year(date))"

_COV = f"""{SLEEVES}, {calendar_sql('sleeves')}, {_YEARS},
  lr AS (SELECT date, ticker, ln(adj_close / lag(adj_close) OVER ({W})) AS r FROM sleeves),
  num AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM cal),
  win AS (SELECT y.date AS asof_date, c.date FROM years y JOIN num n ON n.date = y.date
    JOIN num c ON c.pos BETWEEN n.pos - 249 AND n.pos),
  rw AS (SELECT w.asof_date, w.date, l.ticker, l.r FROM win w JOIN lr l ON l.date = w.date WHERE l.r IS NOT NULL),
  full_ AS (SELECT asof_date, date FROM rw GROUP BY asof_date, date
    HAVING count(*) = (SELECT count(DISTINCT q.ticker) FROM rw q WHERE q.asof_date = rw.asof_date)),
  cc AS MATERIALIZED (SELECT rw.* FROM rw JOIN full_ USING (asof_date, date)),
  cov AS MATERIALIZED (SELECT a.asof_date, a.ticker AS a, b.ticker AS b, covar_samp(a.r, b.r) AS cov, count(*) AS n_obs
    FROM cc a JOIN cc b ON a.asof_date = b.asof_date AND a.date = b.date AND a.ticker <= b.ticker
    GROUP BY ALL HAVING count(*) >= 2),
  var_ AS (SELECT asof_date, a AS ticker, cov AS v FROM cov WHERE a = b),
  ivp AS (SELECT asof_date, ticker, 1 / v / sum(1 / v) OVER (PARTITION BY asof_date) AS weight FROM var_)"""

CONSTRAINED = f"""{TSMOM},
  c0 AS (SELECT date, ticker, greatest({CAPS.min_weight}, least({CAPS.max_weight}, score)) AS w FROM ts),
  c1 AS (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS g FROM c0),
  cw AS MATERIALIZED (SELECT date, ticker, CASE WHEN g > {CAPS.gross_leverage} + 1e-12 OR (g > 0 AND g < {CAPS.gross_leverage})
    THEN greatest({CAPS.min_weight}, least({CAPS.max_weight}, w * ({CAPS.gross_leverage} / g))) ELSE w END AS weight FROM c1)"""

ORACLES = {
    "triple_barrier": f"WITH {_TB} SELECT ticker, t0, t1, {r('ret', 'ret')}, bin FROM tb",
    "meta_labels": f"""WITH {_TB}, p AS (SELECT date, ticker, sign(adj_close / lag(adj_close, 21) OVER ({W}) - 1) AS pred
        FROM bars) SELECT p.date, p.ticker, CASE WHEN sign(pred) = sign(bin) THEN 1 ELSE 0 END AS meta
        FROM p JOIN tb ON tb.ticker = p.ticker AND tb.t0 = p.date WHERE pred IS NOT NULL""",
    "forward_return": f"""WITH {BARS} SELECT date, ticker,
        {r(f'lead(adj_close, 21) OVER ({W}) / adj_close - 1', 'fwd_ret')} FROM bars""",
    "tsmom": f"WITH {BARS}, {TSMOM} SELECT date, ticker, {r('score', 'score')} FROM ts",
    "xsmom": f"""WITH {BARS}, {TSMOM}, k AS (SELECT date, ticker,
          row_number() OVER (PARTITION BY date ORDER BY mom, ticker) AS rk,
          count(*) OVER (PARTITION BY date) AS n FROM mm),
        l AS (SELECT *, greatest(1, floor(0.10::DOUBLE * n)) AS leg FROM k)
        SELECT date, ticker, {r('CASE WHEN rk <= leg THEN -1 / leg WHEN rk > n - leg THEN 1 / leg ELSE 0 END', 'score')}
        FROM l""",
    "carry": f"WITH {BARS}, {TSMOM}, {_CARRY} SELECT date, ticker, {r('score', 'score', 8)} FROM ca",
    "quality": f"""WITH {BARS}, {_LR}, {calendar_sql()}, {asof_sql('lrs', 'n')},
        win AS (SELECT a.date AS asof_date, l.ticker, l.date, l.lr FROM aligned a JOIN lrs l
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
    "ou": f"""WITH {_OU}, z AS (SELECT date, ticker, (last - mu) / (sigma / sqrt(2 * theta)) AS z FROM fit
          WHERE theta > 0 AND ln(2::DOUBLE) / theta <= 30 AND sigma > 0),
        s AS (SELECT date, ticker, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 WHEN abs(z) < 0.5 THEN 0 END AS s FROM z),
        l AS (SELECT *, count(*) FILTER (s > 0) OVER (PARTITION BY date) AS nl,
          count(*) FILTER (s < 0) OVER (PARTITION BY date) AS ns FROM s WHERE s IS NOT NULL)
        SELECT date, ticker, {r('CASE WHEN s > 0 THEN s / nl / 2 WHEN s < 0 THEN s / ns / 2 ELSE 0 END', 'score')} FROM l""",
    "ou_fit": f"""WITH {_OU} SELECT date, ticker, {', '.join(r(c, c, 5) for c in ('theta', 'mu', 'sigma', 'last'))} FROM fit""",
    "half_life": f"""WITH {_OU} SELECT asof_date AS date, ticker,
        {r('CASE WHEN s < 0 THEN -ln(2::DOUBLE) / s END', 'half_life', 5)} FROM ar""",
    "ticker_pairs": f"""WITH {SLEEVES}, {calendar_sql('sleeves')}, {_YEARS},
        {_PAIR_WINDOW.format(dates='years', n1=249, n2=252)}
        SELECT asof_date AS date, a, b, count(*) AS n_obs FROM ab
        WHERE (a, b) IN (SELECT (x.ticker, y.ticker) FROM sleeves x JOIN sleeves y ON x.sector = y.sector AND x.ticker < y.ticker) GROUP BY ALL HAVING count(*) >= 125""",
    "pairs_zscore": f"""WITH {SLEEVES}, {calendar_sql('sleeves')},
        {_PAIR_WINDOW.format(dates='reb', n1=125, n2=128)},
        co AS (SELECT asof_date, a, b, regr_slope(y, x) AS slope, regr_intercept(y, x) AS c, count(*) AS n_obs
          FROM ab GROUP BY ALL HAVING count(*) >= 63),
        res AS (SELECT ab.asof_date, ab.a, ab.b, slope, n_obs, ab.date, y - (slope * x + c) AS e
          FROM ab JOIN co ON co.asof_date = ab.asof_date AND co.a = ab.a AND co.b = ab.b),
        lg AS (SELECT *, lag(e) OVER (PARTITION BY asof_date, a, b ORDER BY date) AS e1 FROM res),
        st AS (SELECT asof_date, a, b, slope, n_obs, (arg_max(e, date) - avg(e)) / nullif(stddev_samp(e), 0) AS z,
          regr_slope(e - e1, e1) AS s FROM lg GROUP BY ALL)
        SELECT asof_date AS date, a, b, {r('slope', 'slope')}, {r('z', 'z')}, {r('-ln(2::DOUBLE) / s', 'half_life')}, n_obs
        FROM st WHERE abs(z) > 1 AND abs(z) < 4 AND s < 0 AND -ln(2::DOUBLE) / s <= 30""",
    "ic_spearman": f"""WITH {BARS}, x AS (SELECT date, ticker, adj_close / lag(adj_close, 21) OVER ({W}) - 1 AS s,
          lead(adj_close, 5) OVER ({W}) / adj_close - 1 AS f FROM bars),
        k AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs,
          rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS rf
          FROM x WHERE s IS NOT NULL AND f IS NOT NULL),
        c AS (SELECT corr(rs, rf) AS ic, count(*) AS n_obs FROM k)
        SELECT {r('ic', 'ic')}, n_obs, {r('ic * sqrt((n_obs - 2) / (1 - ic * ic))', 't_stat')} FROM c""",
    "blend": f"""WITH {BARS}, {TSMOM}, {_CARRY},
        u AS (SELECT date, ticker, 0.6 * score AS score FROM ts UNION ALL SELECT date, ticker, 0.4 * score FROM ca)
        SELECT date, ticker, {r('sum(score)', 'score')} FROM u GROUP BY date, ticker""",
    "equal_weight": f"""WITH {BARS}, {TSMOM} SELECT date, ticker,
        {r('sign(score) / nullif(count(*) FILTER (score <> 0) OVER (PARTITION BY date), 0)', 'weight', 8)} FROM ts""",
    "constrained": f"WITH {BARS}, {CONSTRAINED} SELECT date, ticker, {r('weight', 'weight', 8)} FROM cw",
    "cov_pairs": f"WITH {_COV} SELECT asof_date AS date, a, b, {r('cov', 'cov')}, n_obs FROM cov",
    "corr_distance": f"""WITH {_COV}, rh AS (SELECT c.asof_date AS date, a, b,
          CASE WHEN a = b THEN 1.0::DOUBLE ELSE cov / sqrt(va.v * vb.v) END AS rho
          FROM cov c JOIN var_ va ON va.asof_date = c.asof_date AND va.ticker = a
          JOIN var_ vb ON vb.asof_date = c.asof_date AND vb.ticker = b)
        SELECT date, a, b, {r('rho', 'rho')}, {r('sqrt(greatest(0, least(1, (1 - rho) / 2)))', 'distance')} FROM rh""",
    "inverse_variance": f"WITH {_COV} SELECT asof_date AS date, ticker, {r('weight', 'weight')} FROM ivp",
    "ledoit_wolf": f"""WITH {_COV},
        cx AS (SELECT asof_date, date, ticker, r - avg(r) OVER (PARTITION BY asof_date, ticker) AS x FROM cc),
        pr AS (SELECT i.asof_date, i.ticker AS a, j.ticker AS b, avg(i.x * j.x) AS s, avg(i.x * i.x * j.x * j.x) AS q,
          count(*) AS n FROM cx i JOIN cx j ON i.asof_date = j.asof_date AND i.date = j.date GROUP BY ALL),
        sh AS (SELECT asof_date, avg(s) FILTER (a = b) AS mu, count(*) FILTER (a = b) AS p, sum(s * s) AS ss,
          sum(q - s * s) AS qs, max(n) AS n FROM pr GROUP BY ALL),
        k AS (SELECT *, ss / p - mu * mu AS delta, qs / (p * n) AS beta FROM sh)
        SELECT k.asof_date AS date, a, b,
          {r('(1 - least(beta, delta) / delta) * s + CASE WHEN a = b THEN least(beta, delta) / delta * mu ELSE 0 END', 'cov')},
          pr.n AS n_obs, {r('least(beta, delta) / delta', 'shrinkage')}
        FROM k JOIN pr ON pr.asof_date = k.asof_date WHERE a <= b AND pr.n >= 2""",
    "risk_contrib": f"""WITH {_COV},
        sym AS (SELECT asof_date, a, b, cov FROM cov UNION ALL SELECT asof_date, b, a, cov FROM cov WHERE a <> b),
        rc AS (SELECT wa.asof_date AS date, wa.ticker, wa.weight, wa.weight * sum(cov * wb.weight) AS risk
          FROM sym JOIN ivp wa ON wa.asof_date = sym.asof_date AND wa.ticker = a
          JOIN ivp wb ON wb.asof_date = sym.asof_date AND wb.ticker = b
          GROUP BY wa.asof_date, wa.ticker, wa.weight)
        SELECT date, ticker, {r('weight', 'weight')}, {r('risk', 'risk')},
          {r('risk / sum(risk) OVER (PARTITION BY date)', 'share')} FROM rc""",
}
