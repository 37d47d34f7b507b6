from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import cross_section as cs
from barweave.operators import features as ft
from conftest import column, days


def per_ticker(df, value: str) -> dict[str, list]:
    pdf = df.select("ticker", "date", value).toPandas().sort_values(["ticker", "date"])
    return {t: g[value].tolist() for t, g in pdf.groupby("ticker")}


def assert_same(got: dict[str, list], want: pd.DataFrame, tol: float = 1e-12) -> None:
    for t in want.columns:
        np.testing.assert_allclose(np.array(got[t], dtype=float), want[t].to_numpy(dtype=float), rtol=1e-9, atol=tol)


def test_log_and_simple_returns(make_prices):
    p = make_prices({"A": [100, 110, 121]})
    assert column(ft.log_returns(p, fill_na=True), "log_ret") == pytest.approx([math.log(1.1)] * 2)
    assert column(ft.simple_returns(p), "ret")[1:] == pytest.approx([0.1, 0.1])


def test_log_returns_reject_zero_price(make_prices):
    with pytest.raises(Exception, match="strictly positive"):
        ft.log_returns(make_prices({"A": [100, 0, 121]})).collect()


def test_cumulative_returns(make_series):
    s = make_series({"a": [0.1, -0.05, 0.2]}).withColumnRenamed("r", "ret")
    out = column(ft.cumulative_returns(s, by="series_id"), "cum_ret")
    assert out[-1] == pytest.approx(1.1 * 0.95 * 1.2 - 1)
    add = column(ft.cumulative_returns(s, compounding="additive", by="series_id"), "cum_ret")
    assert add[-1] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        ft.cumulative_returns(s, compounding="other")


def test_frac_diff_ends_of_range(make_prices):
    p = make_prices({"A": list(range(1, 101))})
    same = column(ft.frac_diff(p, "adj_close", 0.0), "frac_diff")
    assert same == pytest.approx([float(v) for v in range(1, 101)])
    diff = column(ft.frac_diff(p, "adj_close", 1.0), "frac_diff")
    assert diff[0] is None and diff[1:] == pytest.approx([1.0] * 99)
    with pytest.raises(ValueError):
        ft.frac_diff(p, "adj_close", 1.5)


@pytest.mark.parametrize("thresh", [1e-2, 5e-4])  # a short filter, and one beyond 64 terms
def test_frac_diff_matches_convolution(panel, wide, thresh):
    w = np.array(ft.ffd_weights(0.4, thresh))
    lp = panel.withColumn("lp", F.ln("adj_close"))
    got = per_ticker(ft.frac_diff(lp, "lp", 0.4, thresh), "frac_diff")
    k = len(w)
    for t in wide.columns:
        x = np.log(wide[t].to_numpy())
        want = [np.nan] * (k - 1) + [float(x[i - k + 1 : i + 1] @ w[::-1]) for i in range(k - 1, len(x))]
        np.testing.assert_allclose(np.array(got[t], dtype=float), want, rtol=1e-9, atol=1e-12)


def test_momentum(make_prices):
    p = make_prices({"A": [100, 110, 121, 133.1]})
    assert column(ft.momentum(p, 2), "mom")[-1] == pytest.approx(133.1 / 110 - 1)
    assert column(ft.momentum(p, 1, 1), "mom")[-1] == pytest.approx(121 / 110 - 1)
    for bad in ((0, 0), (1, -1)):
        with pytest.raises(ValueError):
            ft.momentum(p, *bad)


def test_close_to_close_vol(panel, wide):
    want = np.log(wide / wide.shift(1)).rolling(21).std(ddof=1)
    assert_same(per_ticker(ft.realized_vol(panel, 21), "vol"), want)


@pytest.mark.parametrize("method", ft.VOL_METHODS[1:])
def test_range_estimators(panel, panel_pdf, method):
    def field(name):
        return panel_pdf.pivot(index="date", columns="ticker", values=name)

    o, h, low, c = (field(x) for x in ("open", "high", "low", "adj_close"))
    n = 21
    if method == "parkinson":
        want = np.sqrt((np.log(h / low) ** 2).rolling(n).mean() / (4 * math.log(2)))
    elif method == "garman_klass":
        var = 0.5 * np.log(h / low) ** 2 - (2 * math.log(2) - 1) * np.log(c / o) ** 2
        want = np.sqrt(var.rolling(n).mean().clip(lower=0))
    else:
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        rs = np.log(h / c) * np.log(h / o) + np.log(low / c) * np.log(low / o)
        over = np.log(o / c.shift(1)).rolling(n).var()
        want = np.sqrt((over + k * np.log(c / o).rolling(n).var() + (1 - k) * rs.rolling(n).mean()).clip(lower=0))
    assert_same(per_ticker(ft.realized_vol(panel, n, method), "vol"), want)


def test_vol_arguments(panel):
    with pytest.raises(ValueError):
        ft.realized_vol(panel, 21, "median")
    out = panel.select(ft.annualise_vol(F.lit(0.01)).alias("v")).first()["v"]
    assert out == pytest.approx(0.01 * math.sqrt(252))
    with pytest.raises(Exception, match="non-negative"):
        panel.select(ft.annualise_vol(F.lit(-1.0) * F.col("close"))).collect()


def test_amihud_zero_volume_is_missing(make_series, spark):
    rows = [("A", d, 0.01, 0.0 if i == 5 else 1e6) for i, d in enumerate(days(30))]
    df = spark.createDataFrame(rows, "ticker string, date date, ret double, dv double")
    out = column(ft.amihud(df, "ret", "dv", 3), "amihud")
    assert out[4] == pytest.approx(1e-8) and out[5:8] == [None] * 3 and out[8] == pytest.approx(1e-8)


def test_roll_spread_matches_pandas(panel, wide):
    dp = wide.diff()
    want = pd.DataFrame({t: 2 * np.sqrt((-dp[t].rolling(21).cov(dp[t].shift(1))).clip(lower=0)) for t in wide.columns})
    assert_same(per_ticker(ft.roll_spread(panel), "spread"), want, 1e-9)


def test_kyle_sits_on_its_own_date(spark):
    d = days(6)
    r = [None, 0.01, 0.02, None, 0.03, 0.01]
    v = [1.0, 2.0, 4.0, 1.0, 3.0, 1.0]
    df = spark.createDataFrame(list(zip(["A"] * 6, d, r, v)), "ticker string, date date, r double, v double")
    out = column(ft.kyle_lambda(df, "r", "v", 3), "kyle")
    want = (0.01 * 2 + 0.02 * 4 + 0.03 * 3) / (4 + 16 + 9)
    assert out[:4] == [None] * 4 and out[4] == pytest.approx(want)


def test_rebuild_prices_round_trip(panel, wide):
    out = per_ticker(ft.rebuild_prices(ft.log_returns(panel), base=50.0), "rebuilt")
    for t in wide.columns:
        want = 50.0 * wide[t].to_numpy() / wide[t].iloc[0]
        np.testing.assert_allclose(out[t][1:], want[1:], rtol=1e-12)
    with pytest.raises(ValueError):
        ft.rebuild_prices(panel, base=0.0)


def test_feature_frame_skips_short_histories(panel, make_prices):
    assert ft.feature_frame(panel.where("date < '2018-12-01'"), 1e-2).count() == 0
    full = ft.feature_frame(panel, 1e-2)
    assert full.count() == 1500 and full.columns == ["date", "ticker", *ft.FEATURES]


CROSS = [
    ("2024-01-02", "A", 1.0, "X"), ("2024-01-02", "B", 2.0, "X"), ("2024-01-02", "C", 3.0, "Y"), ("2024-01-02", "D", 4.0, "Y"),
    ("2024-01-03", "A", 4.0, "X"), ("2024-01-03", "B", 3.0, "X"), ("2024-01-03", "C", 2.0, "Y"), ("2024-01-03", "D", 1.0, "Y"),
]


@pytest.fixture(scope="module")
def cross(spark):
    return spark.createDataFrame(CROSS, "date string, ticker string, value double, sector string")


def test_cross_section_invariants(cross):
    rank = cs.cs_rank(cross, "value").toPandas()
    assert rank["cs_rank"].min() == pytest.approx(-0.25) and rank["cs_rank"].max() == pytest.approx(0.5)
    z = cs.cs_zscore(cross, "value").toPandas()
    assert z.groupby("date")["cs_z"].mean().abs().max() < 1e-12
    neutral = cs.sector_neutralize(cross, "value", "sector").toPandas()
    assert neutral.groupby(["date", "sector"])["neutral"].sum().abs().max() < 1e-12
    with pytest.raises(KeyError):
        cs.sector_neutralize(cross, "value", "industry")


def test_constant_cross_section_has_no_score(cross):
    flat = cs.cs_zscore(cross.withColumn("value", F.lit(2.0)), "value").toPandas()
    assert flat["cs_z"].isna().all()


def test_ranks_match_pandas_with_ties_nulls_and_signs(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 3, 4000), 1)
    v[rng.random(4000) < 0.1] = np.nan
    v[:5] = [0.0, -0.0, 1e-300, -1e-300, 1e300]
    pdf = pd.DataFrame({"date": rng.integers(0, 3, 4000), "ticker": [f"{i:04d}" for i in range(4000)], "value": v})
    rows = [(int(d), t, None if math.isnan(x) else float(x)) for d, t, x in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "date int, ticker string, value double")
    got = cs.cs_rank(df, "value").toPandas().sort_values("ticker")["cs_rank"].to_numpy(dtype=float)
    want = pdf.groupby("date")["value"].rank(method="average", pct=True) - 0.5
    np.testing.assert_allclose(got, want.to_numpy(), atol=1e-12)
    glob = cs.average_rank(df, "value").toPandas().sort_values("ticker")["rank"].to_numpy(dtype=float)
    np.testing.assert_allclose(glob, pdf["value"].rank().to_numpy(), atol=1e-12)
    # A two-character prefix splits ties into several groups.
    first = cs.first_rank(df, "value", "ticker", prefix=2).toPandas().set_index("ticker")["rank"]
    exp = pdf.dropna().sort_values("ticker").assign(value=lambda x: x["value"] + 0.0)
    exp = exp.set_index("ticker").groupby("date")["value"].rank(method="first")
    assert (first.sort_index() == exp.sort_index().astype(int)).all()


def test_histories_leave_gaps_and_short_names_empty(spark):
    rows = [(d, t, None if (t, i) == ("A", 4) else float(i * i)) for t, n in (("A", 9), ("B", 2)) for i, d in enumerate(days(n))]
    df = spark.createDataFrame(rows[::-1], "date date, ticker string, x double").withColumn("s", F.lit(1))
    out = ft.over_histories(df, {"s": ("x", 3, lambda x: x[:-2] + x[1:-1] + x[2:])})
    assert out.columns == ["date", "ticker", "x", "s"]
    a = column(out.where("ticker = 'A'"), "s")
    assert a == [None, None, 5.0, 14.0, None, None, None, 110.0, 149.0]
    assert column(out.where("ticker = 'B'"), "s") == [None, None]


def test_features_update_no_frame_of_values_per_bar(panel):
    """Long filters and deviations are taken over arrays of a history, not by moving frames."""
    plan = ft.feature_frame(panel)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "stddev_samp" not in plan
