"""Registered queries: execution, accounting and the flagship strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.functions import costs
from barweave.functions.rolling import ordered
from barweave.operators import execution, metrics, validation, weights
from barweave.operators import calendar as cal
from barweave.plans.common import BARS, MARKET, W, r, rounded
from barweave.plans.research_queries import CONSTRAINED, constrained_weights
from barweave.session import materialise
from barweave.sources.panel import market_panel, supplier_panel, supplier_series

MODEL = costs.CostModel()
CAPITAL = 10_000_000.0
CAP = 0.10


def book(panel: DataFrame) -> DataFrame:
    """The momentum strategy's weights at every decision date."""
    return materialise(constrained_weights(panel).withColumn("run_id", F.lit("tsmom")))


def closes(spark: SparkSession, d: str) -> DataFrame:
    return materialise(supplier_panel(spark, d).select("date", "ticker", "adj_close"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return book(supplier_panel(spark, d).select("date", "ticker", "adj_close"))


def _wishes(spark: SparkSession, d: str) -> DataFrame:
    """A share wish per bar, traded at the next open: a fixed fraction of the day's volume."""
    w = ordered()
    p = supplier_series(spark, d).select(
        "date",
        "ticker",
        F.lead("open").over(w).alias("next_open"),
        F.lead("volume").over(w).alias("next_volume"),
        (F.col("volume") * (F.pmod(F.dayofyear("date"), F.lit(7)) - 3) / 10).alias("wish"),
    )
    return p.where("next_open IS NOT NULL")


def capped_fills(spark: SparkSession, d: str) -> DataFrame:
    shares = costs.capped_shares(F.col("wish"), F.col("next_open"), F.col("next_volume"), CAP)
    out = _wishes(spark, d).withColumn("shares", shares)
    return out.select(
        "date",
        "ticker",
        "shares",
        (F.col("shares") * F.col("next_open")).alias("notional"),
        (F.abs("shares") / F.col("next_volume")).alias("participation"),
    )


def trade_costs(spark: SparkSession, d: str) -> DataFrame:
    shares = costs.capped_shares(F.col("wish"), F.col("next_open"), F.col("next_volume"), CAP)
    p = _wishes(spark, d).withColumn("shares", shares)
    notional, part = F.col("shares") * F.col("next_open"), F.abs("shares") / F.col("next_volume")
    return rounded(
        p.groupBy("date").agg(
            F.sum(costs.commission(notional)).alias("commission"),
            F.sum(costs.linear_slippage(notional, part)).alias("slippage"),
            F.sum(costs.sqrt_impact(notional, part)).alias("impact"),
            F.sum(MODEL.trade_cost(notional, part)).alias("total"),
            F.sum(MODEL.scale(2.0).trade_cost(notional, part)).alias("total_2x"),
        ),
        4,
    )


def borrow(spark: SparkSession, d: str) -> DataFrame:
    p = _wishes(spark, d)
    position = F.col("wish") * F.col("next_open")
    return rounded(p.groupBy("date").agg(F.sum(costs.daily_borrow(position)).alias("borrow")))


def participation_slippage(spark: SparkSession, d: str) -> DataFrame:
    slip = costs.participation_slippage(F.col("wish"), F.col("next_volume"))
    return rounded(_wishes(spark, d).select("date", "ticker", slip.alias("slippage")), 9)


def turnover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weights.turnover(_weights(spark, d)))


def dense_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weights.densify(_weights(spark, d)), 8)


def _strategy_returns(spark: SparkSession, d: str) -> DataFrame:
    panel = closes(spark, d)
    return execution.portfolio_returns(book(panel), panel)


def portfolio_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_strategy_returns(spark, d))


def strategy_performance(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: prices to momentum scores to capped weights to returns to one summary row."""
    return rounded(metrics.performance(_strategy_returns(spark, d)))


def _tradable(spark: SparkSession, d: str) -> DataFrame:
    return materialise(supplier_panel(spark, d).select("date", "ticker", "open", "adj_close", "volume"))


def _fills(panel: DataFrame, wait_for_bar: bool = False) -> DataFrame:
    wanted = execution.orders(book(panel), panel, CAPITAL, wait_for_bar=wait_for_bar)
    return execution.fill_orders(wanted, MODEL, CAP)


def ledger(spark: SparkSession, d: str, wait_for_bar: bool = False) -> DataFrame:
    """Fills with the charge in basis points; the price is exact and stays unrounded."""
    bps = (F.col("cost") / F.abs("notional") * 10_000).alias("cost_bps")
    f = _fills(_tradable(spark, d), wait_for_bar)
    f = f.select("run_id", "date", "ticker", "shares", "price", "participation", bps)
    return rounded(f, exact=frozenset({"price"}))


def ledger_waiting(spark: SparkSession, d: str) -> DataFrame:
    """The same with orders that wait for their name's next bar."""
    return ledger(spark, d, wait_for_bar=True)


def _equity(spark: SparkSession, d: str) -> DataFrame:
    panel = _tradable(spark, d)
    return execution.mark_to_market(materialise(_fills(panel)), panel, CAPITAL, MODEL)


def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_equity(spark, d), 1, gross_leverage=6, borrow=3)


def equity_summary(spark: SparkSession, d: str) -> DataFrame:
    returns = execution.equity_returns(_equity(spark, d)).drop("log_r")
    return rounded(metrics.performance(returns), 5)


def benchmark_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.benchmark_curve(market_panel(spark, d), "MKT"), 4)


def cost_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    p = _tradable(spark, d)
    w = book(p)
    gross = execution.portfolio_returns(w, p)
    fills = execution.fill_orders(execution.orders(w, p, CAPITAL), MODEL, CAP)
    spent = fills.groupBy(F.col("run_id").alias("series_id"), "date").agg((F.sum("cost") / CAPITAL).alias("cost"))
    return rounded(validation.cost_sensitivity(gross, spent))


QUERIES = {
    "strategy_performance": strategy_performance,
    "trade_costs": trade_costs,
    "borrow": borrow,
    "participation_slippage": participation_slippage,
    "capped_fills": capped_fills,
    "turnover": turnover,
    "dense_weights": dense_weights,
    "portfolio_returns": portfolio_returns,
    "ledger": ledger,
    "ledger_waiting": ledger_waiting,
    "equity_curve": equity_curve,
    "equity_summary": equity_summary,
    "benchmark_curve": benchmark_curve,
    "cost_sensitivity": cost_sensitivity,
}

_WISH = f"""wish AS (SELECT * FROM (SELECT date, ticker, lead(open) OVER ({W}) AS px, lead(volume) OVER ({W}) AS vol,
  volume * (dayofyear(date) % 7 - 3) / 10 AS wish FROM bars) WHERE px IS NOT NULL)"""
_CAPPED = f"""{_WISH}, cap AS (SELECT date, ticker, px, vol, greatest(-{CAP} * vol, least(wish, {CAP} * vol)) AS shares FROM wish),
  part AS (SELECT *, shares * px AS notional, abs(shares) / vol AS p FROM cap)"""
_PORT = f"""ret AS (SELECT * FROM (SELECT date, ticker, adj_close / lag(adj_close) OVER ({W}) - 1 AS r FROM bars)
    WHERE r IS NOT NULL),
  dec AS (SELECT DISTINCT date FROM cw),
  days AS (SELECT c.date, (SELECT max(x.date) FROM dec x WHERE x.date < c.date) AS d
    FROM (SELECT DISTINCT date FROM bars) c WHERE c.date > (SELECT min(date) FROM dec)),
  earned AS (SELECT days.date, sum(w.weight * ret.r) AS r FROM days JOIN ret ON ret.date = days.date
    JOIN cw w ON w.date = days.d AND w.ticker = ret.ticker GROUP BY days.date),
  port AS (SELECT 'tsmom' AS series_id, days.date, coalesce(earned.r, 0) AS r FROM days LEFT JOIN earned USING (date))"""


def performance_sql(source: str, digits: int = 6) -> str:
    """One row of headline metrics per series of ``source`` (series_id, date, r)."""
    s = "PARTITION BY series_id ORDER BY date"
    return f"""pf1 AS (SELECT series_id, date, r, product(1 + r) OVER ({s}) AS wealth, row_number() OVER ({s}) AS k
      FROM {source} WHERE r IS NOT NULL),
    pf2 AS (SELECT *, max(wealth) OVER ({s}) AS peak FROM pf1),
    pf3 AS (SELECT *, k - max(k) FILTER (wealth >= peak) OVER ({s}) AS uw FROM pf2),
    pf4 AS (SELECT series_id, count(*) AS n, CASE WHEN product(1 + r) > 0 THEN power(product(1 + r), 252.0::DOUBLE / count(*)) - 1 END AS cagr,
      stddev_samp(r) * sqrt(252) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe,
      avg(r) / nullif(sqrt(avg(power(least(r, 0), 2))), 0) * sqrt(252) AS sortino,
      min(wealth / peak - 1) AS mdd, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit,
      sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(-sum(CASE WHEN r < 0 THEN r ELSE 0 END), 0) AS pf,
      max(uw) AS uw FROM pf3 GROUP BY series_id)
    SELECT series_id, n AS n_obs, {r('cagr', 'cagr', digits)}, {r('vol', 'vol', digits)}, {r('sharpe', 'sharpe', digits)},
      {r('sortino', 'sortino', digits)}, {r('mdd', 'max_drawdown', digits)}, {r('hit', 'hit_rate', digits)},
      {r('pf', 'profit_factor', digits)}, {r('pf', 'omega', digits)}, uw AS time_underwater,
      {r('cagr / nullif(abs(mdd), 0)', 'calmar', digits)} FROM pf4"""


_LEDGER = f"""nb AS (SELECT date, ticker, adj_close, lead(date) OVER ({W}) AS exec_date, lead(open) OVER ({W}) AS px,
    lead(volume) OVER ({W}) AS vol FROM bars),
  dec AS (SELECT DISTINCT date FROM cw),
  mem AS (SELECT DISTINCT ticker FROM cw),
  pos0 AS (SELECT g.date, g.ticker, b.exec_date, b.px, b.vol, coalesce(w.weight, 0) * {CAPITAL} / b.adj_close AS target
    FROM (SELECT dec.date, mem.ticker FROM dec CROSS JOIN mem) g
    {{match}}
    LEFT JOIN cw w ON w.date = g.date AND w.ticker = g.ticker),
  ord AS (SELECT ticker, exec_date, px, vol, arg_max(target, date) AS target FROM pos0 WHERE exec_date IS NOT NULL GROUP BY ALL),
  seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY exec_date) AS k FROM ord),
  walk AS (SELECT ticker, 0::BIGINT AS k, NULL::DATE AS exec_date, 0.0::DOUBLE AS px, 0.0::DOUBLE AS vol, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS pos FROM mem
    UNION ALL SELECT s.ticker, s.k, s.exec_date, s.px, s.vol,
      CASE WHEN abs(s.target - w.pos) < 1e-9 THEN 0 ELSE greatest(-{CAP} * s.vol, least(s.target - w.pos, {CAP} * s.vol)) END,
      w.pos + CASE WHEN abs(s.target - w.pos) < 1e-9 THEN 0 ELSE greatest(-{CAP} * s.vol, least(s.target - w.pos, {CAP} * s.vol)) END
    FROM walk w JOIN seq s ON s.ticker = w.ticker AND s.k = w.k + 1),
  fl AS MATERIALIZED (SELECT exec_date AS date, ticker, shares, px AS price, shares * px AS notional, abs(shares) / vol AS participation,
    abs(shares * px) * (1.0 / 10000 + abs(shares) / vol * 5.0 / 10000 + 0.1 * sqrt(abs(shares) / vol)) AS cost
    FROM walk WHERE k > 0 AND shares <> 0)"""
# Orders trade on the next calendar date, or wait for the name's next bar.
_LEDGER_WAITING = _LEDGER.replace("{match}", "ASOF JOIN nb b ON g.ticker = b.ticker AND g.date >= b.date")
_LEDGER = _LEDGER.replace(
    "{match}",
    """JOIN nb b ON g.ticker = b.ticker AND g.date = b.date
    JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM bars)) nx
      ON nx.date = g.date AND b.exec_date = nx.next_date""",
)
_EQUITY = f"""held AS (SELECT DISTINCT b.date FROM bars b JOIN (SELECT DISTINCT ticker FROM fl) USING (ticker)),
  cum AS (SELECT date, ticker, sum(shares) OVER ({W}) AS pos FROM fl),
  grid AS (SELECT h.date, t.ticker FROM held h CROSS JOIN (SELECT DISTINCT ticker FROM fl) t),
  val AS (SELECT g.date, sum(c.pos * b.adj_close) AS value, sum(abs(c.pos * b.adj_close)) AS gross,
      sum(CASE WHEN c.pos < 0 THEN -c.pos * b.adj_close * 0.005 / 252 ELSE 0 END) AS borrow
    FROM grid g ASOF JOIN cum c ON g.ticker = c.ticker AND g.date >= c.date
    ASOF JOIN bars b ON g.ticker = b.ticker AND g.date >= b.date GROUP BY g.date),
  paid AS (SELECT date, sum(notional + cost) AS paid FROM fl GROUP BY date),
  eq0 AS (SELECT h.date, coalesce(value, 0) AS value, coalesce(gross, 0) AS gross, coalesce(borrow, 0) AS borrow,
      sum(coalesce(paid, 0)) OVER (ORDER BY h.date) AS spent
    FROM held h LEFT JOIN val USING (date) LEFT JOIN paid USING (date)),
  eq AS (SELECT 'tsmom' AS run_id, date, {CAPITAL} - spent - coalesce(sum(borrow) OVER (ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cash, value, gross, borrow FROM eq0)"""
_EQ_RET = """er AS (SELECT run_id AS series_id, date, (cash + value) / lag(cash + value) OVER (ORDER BY date) - 1 AS r FROM eq)"""

ORACLES = {
    "strategy_performance": f"WITH {BARS}, {CONSTRAINED}, {_PORT}, {performance_sql('port')}",
    "portfolio_returns": f"WITH {BARS}, {CONSTRAINED}, {_PORT} SELECT series_id, date, {r('r', 'r')} FROM port",
    "capped_fills": f"""WITH {BARS}, {_CAPPED} SELECT date, ticker, shares, notional,
        p AS participation FROM part""",
    "trade_costs": f"""WITH {BARS}, {_CAPPED} SELECT date, {r('sum(abs(notional) * 1 / 10000)', 'commission', 4)},
        {r('sum(abs(notional) * p * 5 / 10000)', 'slippage', 4)}, {r('sum(abs(notional) * 0.1 * sqrt(p))', 'impact', 4)},
        {r('sum(abs(notional) * (1.0 / 10000 + p * 5.0 / 10000 + 0.1 * sqrt(p)))', 'total', 4)},
        {r('2 * sum(abs(notional) * (1.0 / 10000 + p * 5.0 / 10000 + 0.1 * sqrt(p)))', 'total_2x', 4)}
        FROM part GROUP BY date""",
    "borrow": f"""WITH {BARS}, {_WISH} SELECT date,
        {r('sum(CASE WHEN wish < 0 THEN -wish * px * 50 / 10000 / 252 ELSE 0 END)', 'borrow')} FROM wish GROUP BY date""",
    "participation_slippage": f"""WITH {BARS}, {_WISH} SELECT date, ticker,
        {r('5 * sqrt(least(abs(wish) / vol, 0.1)) / 10000', 'slippage', 9)} FROM wish""",
    "turnover": f"""WITH {BARS}, {CONSTRAINED}, ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev
          FROM (SELECT DISTINCT date FROM cw)),
        nm AS (SELECT ds.date, ds.prev, cw.ticker FROM ds JOIN cw ON cw.date = ds.date UNION
          SELECT ds.date, ds.prev, cw.ticker FROM ds JOIN cw ON cw.date = ds.prev)
        SELECT nm.date, {r('sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)))', 'turnover')} FROM nm
        LEFT JOIN cw a ON a.date = nm.date AND a.ticker = nm.ticker
        LEFT JOIN cw b ON b.date = nm.prev AND b.ticker = nm.ticker GROUP BY nm.date""",
    "dense_weights": f"""WITH {BARS}, {CONSTRAINED} SELECT d.date, t.ticker, {r('coalesce(w.weight, 0)', 'weight', 8)}
        FROM (SELECT DISTINCT date FROM cw) d CROSS JOIN (SELECT DISTINCT ticker FROM cw) t
        LEFT JOIN cw w ON w.date = d.date AND w.ticker = t.ticker""",
    "ledger": f"""WITH RECURSIVE {BARS}, {CONSTRAINED}, {_LEDGER} SELECT 'tsmom' AS run_id, date, ticker,
        {r('shares', 'shares')}, price, {r('participation', 'participation')}, {r('cost / abs(notional) * 10000', 'cost_bps')}
        FROM fl""",
    "ledger_waiting": f"""WITH RECURSIVE {BARS}, {CONSTRAINED}, {_LEDGER_WAITING} SELECT 'tsmom' AS run_id, date, ticker,
        {r('shares', 'shares')}, price, {r('participation', 'participation')}, {r('cost / abs(notional) * 10000', 'cost_bps')}
        FROM fl""",
    "equity_curve": f"""WITH RECURSIVE {BARS}, {CONSTRAINED}, {_LEDGER}, {_EQUITY} SELECT run_id, date, {r('cash', 'cash', 1)},
        {r('cash + value', 'equity', 1)}, {r('gross / (cash + value)', 'gross_leverage')}, {r('borrow', 'borrow', 3)} FROM eq""",
    "equity_summary": f"""WITH RECURSIVE {BARS}, {CONSTRAINED}, {_LEDGER}, {_EQUITY}, {_EQ_RET},
        {performance_sql('er', 5)}""",
    "benchmark_curve": f"""WITH {MARKET} SELECT date, ticker,
        {r(f'adj_close / first_value(adj_close) OVER ({W}) * 1000000', 'equity', 4)} FROM market""",
    "cost_sensitivity": f"""WITH RECURSIVE {BARS}, {CONSTRAINED}, {_LEDGER},
        {_PORT.replace('dec AS (SELECT DISTINCT date FROM cw),', '')},
        cs AS (SELECT date, sum(cost) / {CAPITAL} AS cost FROM fl GROUP BY date),
        nt AS (SELECT series_id, m AS multiplier, port.r - m * coalesce(cost, 0) AS r FROM port LEFT JOIN cs USING (date),
          (SELECT unnest([0.0::DOUBLE, 1.0, 2.0, 5.0]) AS m))
        SELECT series_id, multiplier, {r('avg(r) / stddev_samp(r) * sqrt(252)', 'sharpe')},
          {r('CASE WHEN product(1 + r) > 0 THEN power(product(1 + r), 252.0::DOUBLE / count(*)) - 1 END', 'cagr')} FROM nt GROUP BY ALL""",
}
