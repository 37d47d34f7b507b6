from __future__ import annotations

import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from barweave.functions import costs
from barweave.operators import registry
from barweave.operators import covariance as cv
from barweave.operators import execution as ex
from barweave.operators import features as ft
from barweave.operators import weights as wt
from conftest import column, days

D1, D2, D3 = date(2020, 1, 1), date(2020, 1, 2), date(2020, 1, 3)


def weight_frame(spark, rows, col="weight"):
    return spark.createDataFrame(rows, f"date date, ticker string, {col} double")


def by_name(df, col="weight"):
    return {r["ticker"]: r[col] for r in df.collect()}


def test_equal_weight_modes(spark):
    s = weight_frame(spark, [(D1, "A", 1.0), (D1, "B", -1.0), (D1, "C", 0.5), (D1, "D", None)], "score")
    assert by_name(wt.equal_weight(s)) == pytest.approx({"A": 1 / 3, "B": -1 / 3, "C": 1 / 3})
    assert by_name(wt.equal_weight(s, "signless", 2.0)) == pytest.approx(dict.fromkeys("ABC", 2 / 3))
    zero = weight_frame(spark, [(D1, "A", 0.0)], "score")
    assert by_name(wt.equal_weight(zero)) == {"A": 0.0}
    with pytest.raises(ValueError):
        wt.equal_weight(s, "other")


def test_constraints(spark):
    wide = weight_frame(spark, [(D1, t, s * 0.6) for t, s in zip("ABCDE", (1, -1, 1, -1, 1))])
    out = by_name(wt.apply_constraints(wide, wt.Constraints(0.3, -0.3, 1.0)))
    assert sum(map(abs, out.values())) == pytest.approx(1.0) and max(map(abs, out.values())) <= 0.3
    two = weight_frame(spark, [(D1, "A", 1.0), (D1, "B", -1.0)])
    assert by_name(wt.apply_constraints(two, wt.Constraints(0.3, -0.3, 1.0))) == pytest.approx({"A": 0.3, "B": -0.3})
    small = weight_frame(spark, [(D1, "A", 0.02), (D1, "B", 0.01), (D1, "C", None)])
    assert by_name(wt.apply_constraints(small, wt.Constraints(0.9, -0.9, 0.6))) == pytest.approx({"A": 0.4, "B": 0.2, "C": 0})


def test_turnover_counts_exits_and_densify_fills(spark):
    w = weight_frame(spark, [(D1, "A", 0.5), (D1, "B", -0.5), (D3, "B", 0.25), (D3, "C", 0.5)])
    assert column(wt.turnover(w), "turnover") == pytest.approx([1.0, 0.5 + 0.75 + 0.5])
    dense = {(r["date"], r["ticker"]): r["weight"] for r in wt.densify(w).collect()}
    assert len(dense) == 6 and dense[(D3, "A")] == 0.0 and dense[(D1, "B")] == -0.5


def test_unknown_allocator():
    with pytest.raises(ValueError):
        registry.allocator("magic")


@pytest.mark.parametrize("blocks", [1, 3])
def test_pair_cov_blocks_agree_with_numpy(panel, wide, spark, blocks):
    r = panel.withColumn("r", ft.log_ret()).select(F.lit(D1).alias("asof"), "date", "ticker", "r")
    r = r.where("NOT (ticker = 'T3' AND date = '2018-05-01')")
    full = cv.complete_cases(r, ["asof"])
    got = {(x["a"], x["b"]): x["cov"] for x in cv.pair_cov(full, blocks).collect()}
    lr = np.log(wide / wide.shift(1)).drop(pd.Timestamp("2018-05-01").date()).dropna()
    want = lr.cov()
    assert len(got) == 15
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b], rel=1e-9)


def test_costs(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first()["v"]

    n, p = F.lit(1e6), F.lit(0.04)
    assert value(costs.commission(n)) == pytest.approx(100)
    assert value(costs.sqrt_impact(n, F.lit(0.16), 1.0)) == pytest.approx(2 * value(costs.sqrt_impact(n, p, 1.0)))
    assert value(costs.linear_slippage(n, p)) == pytest.approx(1e6 * 0.04 * 5e-4)
    assert value(costs.daily_borrow(F.lit(1e5))) == 0 and value(costs.daily_borrow(F.lit(-1e5))) == pytest.approx(1e5 * 0.005 / 252)
    assert value(costs.participation_slippage(F.lit(50.0), F.lit(0.0))) == 0
    m = costs.CostModel().scale(2.0)
    assert (m.commission_bps, m.slippage_bps, m.impact_coef, m.borrow_bps_annual) == (2, 10, 0.2, 50)
    assert costs.CostModel().flat_fraction() == pytest.approx(1e-4 + 5e-5 + 0.1 * math.sqrt(0.1))
    for bad in (costs.linear_slippage, costs.sqrt_impact):
        with pytest.raises(Exception, match="non-negative"):
            value(bad(n, F.lit(-0.1) * F.col("id") - 0.1))


def test_capped_shares(spark):
    one = spark.createDataFrame([(1e6, 100.0, 1e5), (-1e6, 100.0, 1e5), (5.0, 0.0, 1e5), (5.0, 1.0, 0.0)], "d double, p double, v double")
    out = [r["s"] for r in one.select(costs.capped_shares(F.col("d"), F.col("p"), F.col("v")).alias("s")).collect()]
    assert out == [10_000, -10_000, 0, 0]


def ledger_panel(spark):
    rng = np.random.default_rng(8)
    rows = []
    for t in ("A", "B", "C"):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 40)))
        for i, d in enumerate(days(40)):
            if t == "C" and i % 3 == 1:
                continue
            rows.append((d, t, float(c[i] * 1.01), float(c[i]), float(rng.integers(50, 500))))
    return spark.createDataFrame(rows, "date date, ticker string, open double, adj_close double, volume double")


def brute_book(pdf: pd.DataFrame, w: dict, capital: float, cap: float, model: costs.CostModel, wait: bool):
    """Walk the calendar one date at a time, holding the state in dictionaries."""
    shares, cash, last, pending, curve = {}, capital, {}, {}, []
    for d, bars in pdf.sort_values(["date", "ticker"]).groupby("date"):
        for b in bars.itertuples():
            if b.ticker in pending:
                delta = pending.pop(b.ticker) - shares.get(b.ticker, 0.0)
                room = cap * b.volume
                s = max(-room, min(delta, room)) if abs(delta) >= 1e-9 else 0.0
                n, p = s * b.open, abs(s) / b.volume
                cost = abs(n) * (model.commission_bps / 1e4 + p * model.slippage_bps / 1e4 + model.impact_coef * math.sqrt(p))
                cash -= n + cost
                shares[b.ticker] = shares.get(b.ticker, 0.0) + s
            last[b.ticker] = b.adj_close
        if not wait:
            pending.clear()  # no bar on the next date, no trade
        value = {t: s * last[t] for t, s in shares.items()}
        curve.append((d, cash + sum(value.values())))
        cash -= sum(-v * model.borrow_bps_annual / 1e4 / 252 for v in value.values() if v < 0)
        if d in w:
            for t in last if wait else bars["ticker"]:
                if t in w[d] or t in shares or t in pending:
                    pending[t] = w[d].get(t, 0.0) * capital / last[t]
    return curve


@pytest.mark.parametrize("wait", [False, True])
def test_ledger_and_equity_match_a_sequential_walk(spark, wait):
    p = ledger_panel(spark)
    dd = days(40)
    plan = {dd[5]: {"A": 0.5, "B": -0.4, "C": 0.1}, dd[15]: {"A": -0.2, "C": 0.6}, dd[16]: {"B": 0.3}, dd[28]: {"A": 0.1, "B": 0.1, "C": -0.5}}
    w = spark.createDataFrame([("x", d, t, v) for d, m in plan.items() for t, v in m.items()], "run_id string, date date, ticker string, weight double")
    model = costs.CostModel()
    wanted = ex.orders(w, p, 50_000.0, wait_for_bar=wait)
    fills = ex.fill_orders(wanted, model, 0.3)
    eq = ex.mark_to_market(fills, p, 50_000.0, model)
    got = {r["date"]: r["equity"] for r in eq.collect()}
    want = dict(brute_book(p.toPandas(), plan, 50_000.0, 0.3, model, wait))
    assert set(got) == set(want)
    for d, v in want.items():
        assert got[d] == pytest.approx(v, rel=1e-9)
    flat = ex.fill_orders(wanted, model, 0.3, flat_cost=True).first()
    assert flat["cost"] == pytest.approx(abs(flat["notional"]) * model.flat_fraction(0.3))
    rets = ex.equity_returns(eq).count()
    assert rets == len(want) - 1


def test_hold_missing_keeps_positions(spark):
    p = ledger_panel(spark)
    dd = days(40)
    rows = [("x", dd[5], "A", 0.1), ("x", dd[5], "B", 0.1), ("x", dd[20], "A", 0.1)]
    w = spark.createDataFrame(rows, "run_id string, date date, ticker string, weight double")
    closed = ex.orders(w, p, 1_000.0).where("ticker = 'B'").count()
    held = ex.orders(w, p, 1_000.0, hold_missing=True).where("ticker = 'B'").count()
    assert (closed, held) == (2, 1)


def test_portfolio_returns_use_weights_from_before(make_prices, spark):
    p = make_prices({"A": [100, 110, 121, 133.1], "B": [100, 100, 50, 50]})
    w = spark.createDataFrame([("x", D1, "A", 1.0), ("x", D3, "B", 1.0)], "run_id string, date date, ticker string, weight double")
    out = ex.portfolio_returns(w, p).orderBy("date").collect()
    assert [(r["date"].day, round(r["r"], 9)) for r in out] == [(2, 0.1), (3, 0.1), (4, 0.0)]


def test_portfolio_returns_keep_every_date(make_prices, spark):
    """B trades every second day; with B alone held, the other days earn 0."""
    p = make_prices({"A": [100.0] * 9, "B": [100, None, 110, None, 121, None, 121, None, 133.1]})
    w = spark.createDataFrame([("x", D1, "B", 1.0)], "run_id string, date date, ticker string, weight double")
    out = ex.portfolio_returns(w, p).orderBy("date").collect()
    assert [(r["date"].day, round(r["r"], 9)) for r in out] == [
        (2, 0.0), (3, 0.1), (4, 0.0), (5, 0.1), (6, 0.0), (7, 0.0), (8, 0.0), (9, 0.1),
    ]


def test_orders_trade_on_the_next_date_or_wait(make_prices, spark):
    p = make_prices({"A": [100, 100, 100], "B": [50, None, 60], "C": [None, 20, 20]})
    p = p.withColumns({"open": F.col("adj_close"), "volume": F.lit(1e6)})
    rows = [("x", D1, t, 0.3) for t in "ABC"]
    w = spark.createDataFrame(rows, "run_id string, date date, ticker string, weight double")
    at = lambda **k: {r["ticker"]: r["exec_date"].day for r in ex.orders(w, p, 1000.0, **k).collect()}
    assert at() == {"A": 2}
    assert at(wait_for_bar=True) == {"A": 2, "B": 3}
