"""Scans over blocks, descent to the first touch, running quantiles, trials from the log, audit states."""

from __future__ import annotations

import math
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions.normal import norm_ppf_column
from barweave.operators import audit_states, expanding, labels, metrics, prefix
from barweave.operators import features as ft
from barweave.operators.audit import VALUE_COLUMNS
from barweave.sources import panel as pn
from barweave.sources import reference_data, store
from tests.conftest import days


# --- prefix scan


def wealth(rs: list[float]) -> list[tuple]:
    out, w, peak, top = [], 1.0, -math.inf, 0
    for k, r in enumerate(rs, 1):
        w *= 1 + r
        if w >= peak:
            peak, top = w, k
        out.append((w, peak, w / peak - 1, k - top, k))
    return out


@pytest.mark.parametrize("block_days", [1, 7, 10_000])
def test_wealth_path_over_any_blocks(make_series, block_days):
    rng = np.random.default_rng(3)
    series = {"hot": list(rng.normal(0.001, 0.02, 400)), "b": [0.1, None, -0.5, 0.5, 0.0, 0.4], "c": [-0.5], "d": [-1.5, 0.2, -3.0, 0.1, 1.0]}
    got = prefix.wealth_path(make_series(series), block_days=block_days).toPandas().sort_values(["series_id", "date"])
    for name, rs in series.items():
        want = wealth([r for r in rs if r is not None])
        g = got[got["series_id"] == name][["wealth", "peak", "drawdown", "underwater", "position"]]
        np.testing.assert_allclose(g.to_numpy(float), want, rtol=1e-12, atol=1e-12)


def test_wealth_path_edges(spark):
    schema = "series_id string, date date, r double, wealth string, note string"
    d = date(2020, 1, 1)
    rows = [("a", d, 0.5, "x", "kept"), ("a", None, 0.1, "x", "n"), (None, d, 0.1, "x", "n"), ("a", d + timedelta(1), None, "x", "n")]
    out = prefix.wealth_path(spark.createDataFrame(rows, schema)).collect()
    assert [(r["wealth"], r["note"]) for r in out] == [(1.5, "kept")]
    empty = spark.createDataFrame([], schema)
    assert prefix.wealth_path(empty).count() == 0 and prefix.worst_drawdowns(empty).count() == 0


def test_one_series_spreads_over_many_tasks(spark):
    n = 4000
    rows = [("hot", date(2000, 1, 1) + timedelta(i), 0.001 * (-1) ** i) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, date date, r double")
    blocks = df.groupBy("series_id", prefix._block("date", 30).alias("b")).count()
    assert blocks.agg(F.max("count")).first()[0] <= 30
    plan = prefix.wealth_path(df, block_days=30)._jdf.queryExecution().executedPlan().toString()
    # The only windows over a whole series are those over one row per block.
    assert "series_id" in plan and plan.count("Window") >= 3
    got = prefix.worst_drawdowns(df, block_days=30).first()
    want = wealth([r for *_, r in rows])
    assert got["max_drawdown"] == pytest.approx(min(w[2] for w in want), rel=1e-9)
    assert got["time_underwater"] == max(w[3] for w in want)


# --- first touch by descent


def first_touch(lp: np.ndarray, vol: np.ndarray, c: labels.Barriers) -> list[tuple]:
    out = []
    for i in range(len(lp)):
        if vol[i] is None or math.isnan(vol[i]):
            continue
        end = min(i + c.vertical, len(lp) - 1)
        at, side = end, 0
        for j in range(i + 1, end + 1):
            up, down = lp[j] - lp[i] >= c.pt * vol[i], lp[j] - lp[i] <= -c.sl * vol[i]
            if up or down:
                at, side = (end, 0) if up and down else (j, 1 if up else -1)
                break
        out.append((i, at, lp[at] - lp[i], side))
    return out


@pytest.mark.parametrize("vertical", [1, 2, 3, 9, 50, 252, 1000])
def test_descent_equals_a_walk(make_prices, vertical):
    rng = np.random.default_rng(vertical)
    prices = {k: np.exp(np.cumsum(rng.normal(0, s, n))) for k, s, n in (("A", 0.01, 300), ("B", 0.2, 301), ("C", 0.0, 40), ("D", 1.0, 1))}
    c = labels.Barriers(3.0, 4.0, vertical)
    df = make_prices({k: list(v) for k, v in prices.items()}).withColumn("vol", F.when(F.col("ticker") == "C", 0.0).otherwise(0.02))
    got = labels.triple_barrier(df, barriers=c).toPandas()
    for k, v in prices.items():
        lp, vol = np.log(v), np.full(len(v), 0.0 if k == "C" else 0.02)
        want = first_touch(lp, vol, c)
        g = got[got["ticker"] == k].sort_values("t0")
        calendar = days(len(v))
        assert list(g["t1"]) == [calendar[at] for _, at, _, _ in want]
        np.testing.assert_allclose(g["ret"], [m for *_, m, _ in want], atol=1e-12)
        assert list(g["bin"]) == [s for *_, s in want]


def test_descent_events_nulls_and_empty(make_prices, spark):
    df = make_prices({"A": [100.0, 101.0, 200.0, 50.0]}).withColumns(
        {"vol": F.when(F.dayofmonth("date") != 3, 0.1), "go": F.when(F.dayofmonth("date") != 2, True)}
    )
    got = labels.triple_barrier(df, event="go", barriers=labels.Barriers(1, 1, 5)).orderBy("t0").collect()
    assert [(r["t0"].day, r["t1"].day, r["bin"]) for r in got] == [(1, 3, 1), (4, 4, 0)]
    assert labels.triple_barrier(df.where("false")).count() == 0


# --- running quantiles


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
@pytest.mark.parametrize("radix", [2, 16])
def test_expanding_quantile(spark, q, radix):
    rng = np.random.default_rng(11)
    series = {
        "a": rng.normal(0, 1, 120).round(1),  # many ties
        "gaps": np.where(rng.random(90) < 0.4, np.nan, rng.normal(0, 1, 90)),
        "flat": np.full(20, -2.5),
        "none": np.full(5, np.nan),
    }
    rows = [(k, d, None if i % 2 and math.isnan(x) else float(x)) for k, v in series.items() for i, (d, x) in enumerate(zip(days(len(v)), v))]
    df = spark.createDataFrame(rows, "ticker string, date date, x double")
    got = expanding.expanding_quantile(df, "x", q, radix=radix).toPandas().sort_values(["ticker", "date"])
    for k, v in series.items():
        want = pd.Series(v).expanding().quantile(q)
        np.testing.assert_allclose(got[got["ticker"] == k]["quantile"].to_numpy(float), want, atol=1e-12)


def test_median_fill_sees_nothing_later(spark):
    schema = "ticker string, date date, x double, _note string"
    rows = [("a", d, x, "n") for d, x in zip(days(5), [None, 1.0, None, 9.0, None])] + [(None, days(1)[0], 4.0, "n"), (None, days(2)[1], None, "n")]
    out = expanding.fill_expanding_median(spark.createDataFrame(rows, schema), ["x"])
    assert out.columns == ["ticker", "date", "x", "_note"]
    got = {k: [r["x"] for r in out.where(F.col("ticker").eqNullSafe(F.lit(k))).orderBy("date").collect()] for k in ("a", None)}
    assert got == {"a": [None, 1.0, 1.0, 9.0, 5.0], None: [4.0, 4.0]}
    assert expanding.fill_expanding_median(spark.createDataFrame([], schema), {"x": "y"}).count() == 0


# --- trials from the log


def test_quantile_column(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.07, 0.075, 0.3, 0.5, 0.6, 0.925, 0.926, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -0.1, None]], "p double").select(norm_ppf_column(F.col("p")).alias("z")).collect()
    for p, row in zip(ps, got):
        assert row["z"] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-13, abs=1e-15)
    assert [r["z"] for r in got[len(ps) :]] == [-math.inf, math.inf, None, None]


def test_deflated_sharpe_from_log(spark, make_series, tmp_path):
    rng = np.random.default_rng(2)
    names = make_series({f"s{i}": list(rng.normal(0.001 * i, 0.02, 80)) for i in range(6)} | {"short": [0.1]})
    path = str(tmp_path / "log")
    store.log_trials(path, "names", {"a": 1}, names)
    log = store.read_log(spark, path)
    sharpes = [r["sharpe"] for r in log.collect() if r["sharpe"] is not None]
    assert len(sharpes) == 6 and store.trial_count(spark, path) == 7
    got = {r["series_id"]: r for r in metrics.deflated_sharpe_from_log(names, log).collect()}
    want = metrics.deflated_sharpe(names, 7, sharpes).collect()
    assert got["s0"]["expected_max"] == pytest.approx(metrics.expected_max_sharpe(7, sharpes), rel=1e-12)
    for row in want:
        r = got[row["series_id"]]
        assert r["n_trials"] == 7
        if row["z"] is None:
            assert r["z"] is None and r["dsr"] is None
        else:
            assert (r["z"], r["dsr"]) == (pytest.approx(row["z"], rel=1e-9), pytest.approx(row["dsr"], rel=1e-9))
    for few in (log.limit(1), log.where("false")):  # one trial has nothing to deflate
        one = {r["series_id"]: r for r in metrics.deflated_sharpe_from_log(names, few).collect()}
        assert one["s0"]["n_trials"] == 1 and one["s0"]["z"] == math.inf and one["s0"]["dsr"] == 1.0
        assert one["short"]["z"] is None


# --- audit states


def test_audit_of_halves_is_the_audit_of_the_whole(spark, panel, panel_pdf, tmp_path):
    holes = panel.withColumns(
        {"close": F.when(F.dayofmonth("date") != 5, F.col("close")), "volume": F.when(F.dayofmonth("date") == 7, 0.0).otherwise(F.col("volume"))}
    )
    year = F.year("date")
    cut = panel_pdf["date"].iloc[150]
    first, second = holes.where(F.col("date") < F.lit(cut)), holes.where(F.col("date") >= F.lit(cut))
    halves, whole = str(tmp_path / "halves"), str(tmp_path / "whole")
    audit_states.write_states(first, halves, F.lit("one"))
    audit_states.write_states(second, halves, F.lit("two"))
    audit_states.write_states(second, halves, F.lit("two"))  # a repeated job replaces its state
    audit_states.write_states(holes, whole, year)
    a, b = (audit_states.read_audit(spark, p).first().asDict() for p in (halves, whole))
    pdf = holes.toPandas()
    assert (a["n_rows"], a["n_tickers"], a["date_min"], a["date_max"]) == (len(pdf), 5, pdf["date"].min(), pdf["date"].max())
    assert a["zero_volume_fraction"] == pytest.approx((pdf["volume"] == 0).mean())
    for c in VALUE_COLUMNS:
        assert a[f"missing_{c}"] == pytest.approx(pdf[c].isna().mean())
        assert (a[f"avg_{c}"], a[f"sd_{c}"]) == (pytest.approx(pdf[c].mean(), rel=1e-12), pytest.approx(pdf[c].std(), rel=1e-10))
    assert b == pytest.approx({k: v for k, v in a.items() if not isinstance(v, date)} | {k: v for k, v in a.items() if isinstance(v, date)})


def test_audit_states_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "odd")
    rows = [(date(2020, 1, 1), None, math.nan, None, math.inf, 1.0, 1.0, 0.0), (None, "a", 1.0, None, 2.0, 1.0, 3.0, None)]
    audit_states.write_states(spark.createDataFrame(rows, pn.PANEL_SCHEMA), path, F.year("date"))
    got = audit_states.read_audit(spark, path).first()
    assert (got["n_rows"], got["n_tickers"], got["avg_open"], got["sd_open"], got["avg_low"]) == (2, 1, 1.0, None, 2.0)
    assert got["missing_high"] == 1.0 and got["avg_high"] is None and got["sd_adj_close"] == pytest.approx(math.sqrt(2))


def test_audit_states_count_many_tickers_exactly(spark, tmp_path):
    path = str(tmp_path / "many")
    price = [F.lit(1.0).alias(c) for c in VALUE_COLUMNS]
    day = F.expr("date_add(DATE'2020-06-01', CAST(366 * (id % 3) AS INT))").alias("date")
    bars = spark.range(60_000).select(day, F.concat(F.lit("S"), (F.col("id") % 20_011).cast("string")).alias("ticker"), *price)
    audit_states.write_states(bars, path, F.year("date"))
    audit_states.write_states(bars.where(F.year("date") == 2021), path, F.year("date"))
    got = audit_states.read_audit(spark, path).first()
    assert (got["n_rows"], got["n_tickers"]) == (60_000, 20_011)


# --- factor files and vendor tables


def test_monthly_factor_files(spark, tmp_path):
    (tmp_path / "ff.csv").write_text("date,Mkt-RF,SMB,HML,RF\n202001,1.5,0.1,-0.2,0.01\n202002,-2.0,0.3,,0.01\n")
    got = reference_data.scan_factors(spark, str(tmp_path / "ff.csv"), "FF3", frequency="monthly").orderBy("date").collect()
    assert [r["date"] for r in got] == [date(2020, 1, 1), date(2020, 2, 1)]
    assert got[0]["Mkt-RF"] == pytest.approx(0.015) and got[1]["HML"] is None
    with pytest.raises(ValueError):
        reference_data.scan_factors(spark, "x", "FF3", frequency="weekly")
    daily = spark.createDataFrame([(date(2020, 1, d), r) for d, r in ((2, 0.1), (3, None), (6, -0.5))], "date date, `Mkt-RF` double")
    assert reference_data.compound_monthly(daily).collect() == [(date(2020, 1, 1), pytest.approx(-0.45))]


def test_vendor_table_of_many_names(spark):
    rows = [("A", "2020-01-02", "1.5", "9"), ("B", "2020-01-02", "NaN", "9")]
    df = spark.createDataFrame(rows, "Symbol string, Date string, `Adj Close` string, Dividends string")
    got = pn.normalise_vendor(df, F.col("Symbol")).orderBy("ticker").collect()
    assert got == [(date(2020, 1, 2), "A", 1.5), (date(2020, 1, 2), "B", None)]


def test_labels_feed_the_same_features(panel):
    """The descent leaves the columns that the classifier and the meta labels read."""
    out = labels.triple_barrier(ft.realized_vol(panel, 21))
    assert out.dtypes == [("ticker", "string"), ("t0", "date"), ("t1", "date"), ("ret", "double"), ("bin", "int")]
