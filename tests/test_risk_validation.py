from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions.normal import norm_cdf, norm_ppf
from barweave.operators import attribution, bootstrap, metrics, risk, validation
from barweave.operators.audit import audit_panel
from barweave.plans import risk_queries
from conftest import days

RNG = np.random.default_rng(12)
NORMAL = RNG.normal(0.0003, 0.01, 800)
SKEWED = np.where(RNG.random(600) < 0.03, -0.06, RNG.normal(0.001, 0.008, 600))


@pytest.fixture(scope="module")
def two(make_series):
    return make_series({"n": NORMAL.tolist(), "s": SKEWED.tolist()}).cache()


def rows(df, key="series_id"):
    return {r[key]: r for r in df.collect()}


def test_performance_matches_numpy(two):
    got = rows(metrics.performance(two))
    for k, x in (("n", NORMAL), ("s", SKEWED)):
        w = np.cumprod(1 + x)
        dd = w / np.maximum.accumulate(w) - 1
        run = longest = 0
        for u in dd < 0:
            run = run + 1 if u else 0
            longest = max(longest, run)
        cagr = w[-1] ** (252 / len(x)) - 1
        want = {
            "cagr": cagr,
            "vol": x.std(ddof=1) * math.sqrt(252),
            "sharpe": x.mean() / x.std(ddof=1) * math.sqrt(252),
            "sortino": x.mean() / math.sqrt((np.minimum(x, 0) ** 2).mean()) * math.sqrt(252),
            "max_drawdown": dd.min(),
            "hit_rate": (x > 0).mean(),
            "profit_factor": x[x > 0].sum() / -x[x < 0].sum(),
            "time_underwater": longest,
            "calmar": cagr / -dd.min(),
        }
        for m, v in want.items():
            assert got[k][m] == pytest.approx(v, rel=1e-9), m


def test_degenerate_series(make_series):
    got = rows(
        metrics.performance(
            make_series({"up": [0.01, 0.02, 0.03], "flat": [0.01] * 252, "one": [0.01], "gap": [None, 0.1, None]})
        )
    )
    assert got["up"]["profit_factor"] is None and got["up"]["calmar"] is None
    assert got["flat"]["sharpe"] is None and got["flat"]["calmar"] is None
    assert got["one"]["vol"] is None and got["one"]["sharpe"] is None
    assert got["gap"]["n_obs"] == 1
    assert metrics.performance(make_series({})).count() == 0


def test_first_bar_loss_is_no_drawdown(make_series):
    got = rows(metrics.drawdowns(make_series({"a": [-0.5, 0.1, 0.1], "b": [0.1, -0.5, 0.5, 0.4, 0.1], "c": [0.1, -0.2, -0.1, 0.05, 0.5]})))
    assert got["a"]["max_drawdown"] == 0 and got["a"]["time_underwater"] == 0
    assert got["b"]["max_drawdown"] == pytest.approx(-0.5) and got["b"]["recovery_time"] == 2
    assert got["c"]["time_underwater"] == 3 and got["c"]["recovery_time"] == 2


def corrected(x):
    n, c = len(x), x - x.mean()
    m2 = (c**2).mean()
    s = math.sqrt(n * (n - 1)) / (n - 2) * (c**3).mean() / m2**1.5
    k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((c**4).mean() / m2**2 - 3) + 6)
    return s, k


def test_psr_and_dsr(two):
    got = rows(metrics.probabilistic_sharpe(two, 0.2))
    for k, x in (("n", NORMAL), ("s", SKEWED)):
        s, e = corrected(x)
        sr = x.mean() / x.std(ddof=1)
        z = (sr - 0.2 / math.sqrt(252)) * math.sqrt(len(x) - 1) / math.sqrt(1 - s * sr + (e - 1) / 4 * sr**2)
        assert got[k]["z"] == pytest.approx(z) and got[k]["psr"] == pytest.approx(norm_cdf(z))
    d1, d10, d100 = (rows(metrics.deflated_sharpe(two, n))["n"]["dsr"] for n in (1, 10, 100))
    assert d1 == 1.0 and d1 > d10 > d100
    raw = rows(metrics.probabilistic_sharpe(two, raw_kurtosis=True))["n"]["z"]
    assert raw != pytest.approx(rows(metrics.probabilistic_sharpe(two))["n"]["z"])
    with pytest.raises(ValueError):
        metrics.deflated_sharpe(two, 0)


def test_value_at_risk(two, make_series):
    z = norm_ppf(0.05)
    for method in risk.VAR_METHODS:
        got = rows(risk.value_at_risk(two, method))
        for k, x in (("n", NORMAL), ("s", SKEWED)):
            s, e = corrected(x)
            cf = z + (z**2 - 1) / 6 * s + (z**3 - 3 * z) / 24 * e - (2 * z**3 - 5 * z) / 36 * s * s
            want = {
                "parametric": -(x.mean() + x.std(ddof=1) * z),
                "historical": -np.quantile(x, 0.05),
                "cornish_fisher": -(x.mean() + x.std(ddof=1) * cf),
            }[method]
            assert got[k]["var"] == pytest.approx(want)
            # The resampling statistic is the same estimator.
            assert bootstrap.var_statistic(method)(x[None, :])[0] == pytest.approx(want)
    es = rows(risk.expected_shortfall(two))
    assert es["s"]["es"] == pytest.approx(-SKEWED[SKEWED <= np.quantile(SKEWED, 0.05)].mean())
    assert rows(risk.value_at_risk(make_series({"a": [0.1] * 20}), "parametric"))["a"]["var"] is None
    with pytest.raises(ValueError):
        risk.value_at_risk(two, "other")


def test_kelly_and_vol_target(two, make_series, spark):
    got = rows(risk.fractional_kelly(two, 0.5))["n"]["kelly"]
    assert got == pytest.approx(0.5 * NORMAL.mean() / NORMAL.var(ddof=1))
    assert rows(risk.fractional_kelly(make_series({"a": [0.01] * 10})))["a"]["kelly"] is None
    out = spark.createDataFrame([(0.2,), (0.0,)], "v double").select(risk.vol_target_scale(F.col("v"), 0.1).alias("s"))
    assert [r["s"] for r in out.collect()] == [0.5, 0.0]


def test_stress_keeps_empty_windows(make_series):
    s = make_series({"a": [0.01, -0.02, 0.03, 0.01]})
    got = rows(risk.historical_stress(s, (("in", "2020-01-02", "2020-01-03"), ("out", "2030-01-01", "2030-02-01"))), "window")
    assert got["in"]["n_obs"] == 2 and got["in"]["total_return"] == pytest.approx(0.98 * 1.03 - 1)
    assert got["out"]["n_obs"] == 0 and got["out"]["sharpe"] is None


def test_bootstrap_intervals(two):
    ci = rows(bootstrap.bootstrap_ci(two, bootstrap.mean_statistic, 600, seed=3))
    half = 1.96 * NORMAL.std() / math.sqrt(len(NORMAL))
    assert ci["n"]["ci_low"] == pytest.approx(NORMAL.mean() - half, abs=half / 3)
    assert ci["n"]["ci_high"] == pytest.approx(NORMAL.mean() + half, abs=half / 3)
    assert ci["n"]["n_boot"] == 600
    again = rows(bootstrap.bootstrap_ci(two.repartition(5), bootstrap.mean_statistic, 600, seed=3))
    assert again["n"]["ci_low"] == ci["n"]["ci_low"]
    sharpe = rows(bootstrap.stationary_sharpe_ci(two, 400))
    point = rows(metrics.performance(two))["n"]["sharpe"]
    assert sharpe["n"]["ci_low"] < point < sharpe["n"]["ci_high"]


def test_stationary_blocks_run_on_and_wrap():
    idx = bootstrap.stationary_draws(20)(np.random.default_rng(0), 100, 200)
    follow = (idx[:, 1:] - idx[:, :-1]) % 100 == 1
    assert idx.min() >= 0 and idx.max() < 100 and follow.mean() == pytest.approx(0.95, abs=0.01)


def test_hac_regression(make_series, spark):
    rng = np.random.default_rng(6)
    n = 600
    f = rng.normal(0, 0.01, (n, 3))
    y = 0.0002 + f @ np.array([1.2, 0.3, 0.0]) + rng.normal(0, 0.002, n)
    fac = spark.createDataFrame(
        [(d, *map(float, r)) for d, r in zip(days(n), f)], "date date, `Mkt-RF` double, SMB double, HML double"
    )
    out = rows(attribution.factor_exposure(make_series({"p": y.tolist()}), fac, ["Mkt-RF", "SMB", "HML"]), "factor")
    x = np.column_stack([np.ones(n), f])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    lag = math.floor(4 * 6 ** (2 / 9))
    s = sum(
        (1 - abs(i - j) / (lag + 1)) * e[i] * e[j] * np.outer(x[i], x[j])
        for i in range(n)
        for j in range(max(0, i - lag), min(n, i + lag + 1))
    )
    inv = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(inv @ s @ inv))
    for i, name in enumerate(["alpha", "Mkt-RF", "SMB", "HML"]):
        assert out[name]["beta"] == pytest.approx(beta[i]) and out[name]["t_stat"] == pytest.approx(beta[i] / se[i])
    assert out["Mkt-RF"]["beta"] == pytest.approx(1.2, abs=0.15) and out["alpha"]["lag"] == lag
    short = rows(attribution.factor_exposure(make_series({"p": y[:10].tolist()}), fac, ["SMB"]), "factor")
    assert short["alpha"]["beta"] is None and short["alpha"]["n_obs"] == 10
    ff = fac.withColumn("RF", F.when(F.col("date") > F.lit("2020-03-01").cast("date"), 0.0001))
    excess = rows(attribution.fama_french_betas(make_series({"p": y.tolist()}), ff), "factor")
    assert set(excess) == {"alpha", "Mkt-RF", "SMB", "HML"} and excess["alpha"]["n_obs"] == n


def test_fama_french_covers_every_supplier(spark):
    folder = "/root/testdata/sf0.001"
    returns = risk_queries._names(spark, folder).toPandas()
    factors = risk_queries.factor_table(spark, folder).toPandas()
    got = risk_queries.fama_french(spark, folder).toPandas()
    joined = returns.merge(factors, on="date").dropna()
    assert set(got["series_id"]) == set(joined["series_id"]) and len(set(got["series_id"])) > 1
    names = ["Mkt-RF", "SMB", "HML"]
    for series, rows_ in joined.groupby("series_id"):
        mine = got[got["series_id"] == series].set_index("factor")
        assert set(mine["n_obs"]) == {len(rows_)}
        if len(rows_) >= 20:
            x = np.column_stack([np.ones(len(rows_)), rows_[names].to_numpy(float)])
            beta = np.linalg.lstsq(x, (rows_["r"] - rows_["RF"]).to_numpy(float), rcond=None)[0]
            assert mine.loc[["alpha", *names], "beta"].to_numpy(float) == pytest.approx(beta, rel=1e-6, abs=1e-5)


def test_cpcv_roles_match_brute_force(make_series):
    n = 103
    obs = make_series({"a": [0.0] * n}).drop("r")
    got = validation.cpcv_splits(obs, 6, 2, 4, keep_purged=True).toPandas()
    groups = np.array_split(np.arange(n), 6)
    for i, combo in enumerate(combinations(range(6), 2)):
        test = np.concatenate([groups[g] for g in combo])
        near = np.abs(np.arange(n)[:, None] - test[None, :]).min(axis=1)
        want = np.where(near == 0, "test", np.where(near <= 4, "purged", "train"))
        role = got[got["split_id"] == i].sort_values("obs_id")["role"].to_numpy()
        assert (role == want).all()
    assert got["split_id"].nunique() == 15 and validation.n_paths(6, 2) == 5 and validation.n_paths() == 9
    none = validation.cpcv_splits(obs, 5, 2, 0, keep_purged=True).where("role = 'purged'").count()
    tiny = validation.cpcv_splits(make_series({"a": [0.0] * 3}).drop("r"), 5, 2, 1).count()
    assert none == 0 and tiny > 0
    with pytest.raises(ValueError):
        validation.cpcv_splits(obs, 3, 3)


def test_walk_forward(make_series):
    dates = make_series({"a": [0.0] * 2520}).select("date")
    roll = sorted(validation.walk_forward(dates, 3, 1).collect(), key=lambda r: r["fold"])
    assert len(roll) == 7
    for a in roll:
        assert a["train_start"] < a["train_end"] < a["test_start"] < a["test_end"]
        assert (a["train_end"] - a["train_start"]).days == 755 and (a["test_end"] - a["test_start"]).days == 251
    grow = sorted(validation.walk_forward(dates, 3, 1, "expanding", 2).collect(), key=lambda r: r["fold"])
    assert len({r["train_start"] for r in grow}) == 1 and len(grow) == 4
    with pytest.raises(ValueError):
        validation.walk_forward(dates, mode="sideways")


def test_purged_kfold_has_no_overlap(make_series):
    n = 100
    obs = make_series({"a": [0.0] * n}).select("series_id", "date").withColumn(
        "end_pos", F.least(F.datediff("date", F.lit("2020-01-01").cast("date")) + 7, F.lit(n - 1))
    )
    pdf = validation.purged_kfold(obs, 4, 3).toPandas()
    for _, g in pdf.groupby("fold"):
        test, train = g[g["role"] == "test"], g[g["role"] == "train"]
        lo, known = test["obs_id"].min(), test["end_pos"].max()
        assert ((train["end_pos"] < lo) | (train["obs_id"] > max(known, test["obs_id"].max() + 3))).all()


def test_look_ahead_is_caught(panel):
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("date")
    peek = lambda p: p.select("date", "ticker", F.lead("adj_close", 5).over(w).alias("score"))
    assert validation.lookahead_check(peek, panel, "2018-10-31").first()["n_changed"] > 0


def test_regimes_and_costs(two, spark):
    macro = spark.createDataFrame([(d, float(i % 10)) for i, d in enumerate(days(800))], "date date, value double")
    out = validation.regime_sharpe(two, macro).where("series_id = 'n'").toPandas()
    assert sorted(out["n_obs"]) == [266, 267, 267]
    cost = two.select("series_id", "date", F.lit(0.0005).alias("cost"))
    s = validation.cost_sensitivity(two, cost).where("series_id = 'n'").orderBy("multiplier").toPandas()["sharpe"]
    assert list(s) == sorted(s, reverse=True) and len(s) == 4


def test_audit_findings(panel, spark):
    clean = audit_panel(panel).first()
    assert clean["is_clean"] and clean["n_tickers"] == 5 and clean["n_rows"] == 1500 and not clean["volume_idle"]
    w = panel.withColumn("volume", F.when(F.dayofyear("date") % 6 == 0, 0.0).otherwise(F.col("volume")))
    assert audit_panel(w).first()["volume_idle"]
    spike = panel.withColumn(
        "adj_close", F.when(F.col("date") == F.lit("2018-06-01").cast("date"), F.col("adj_close") * 9).otherwise(F.col("adj_close"))
    )
    found = audit_panel(spike).first()
    assert found["return_spike_count"] == 10 and not found["is_clean"]
    short = audit_panel(panel.select("date", "ticker")).first()
    assert short["missing_columns"].startswith("open") and short["n_tickers"] == 5 and not short["is_clean"]


def test_stale_fraction_counts_like_pandas(make_prices):
    prices = {"A": [5, 5, 5, 5, 5, 5, 6, 7, 8, 9], "B": list(range(1, 11))}
    df = make_prices(prices)
    for c in ("open", "high", "low", "close", "volume"):
        df = df.withColumn(c, F.col("adj_close"))
    want = []
    for v in prices.values():
        same = pd.Series(v).diff().abs().fillna(0) == 0
        want.append(same.rolling(5).sum().fillna(0).ge(5).mean())
    assert audit_panel(df).first()["stale_price_fraction"] == pytest.approx(np.mean(want))


def test_report_tables(two):
    h = metrics.histogram(two, 60).where("series_id = 'n'").toPandas().set_index("bin")["count"]
    want, _ = np.histogram(NORMAL, 60)
    assert [int(h.get(i, 0)) for i in range(60)] == want.tolist()
    year = metrics.per_year(two).where("series_id = 'n' AND year = 2020").first()
    assert year["total_return"] == pytest.approx(np.prod(1 + NORMAL[:366]) - 1)
    grid = metrics.normal_overlay(two, 50).where("series_id = 'n'").toPandas()
    assert len(grid) == 50 and grid["x"].max() == pytest.approx(NORMAL.max())
    bench = two.where("series_id = 'n'").select("date", F.col("r").alias("b"))
    roll = metrics.rolling_sharpe_beta(two, bench, 60).where("series_id = 's'").toPandas().sort_values("date")
    s, n = pd.Series(SKEWED), pd.Series(NORMAL[:600])
    np.testing.assert_allclose(roll["roll_beta"].to_numpy(float), (s.rolling(60).cov(n) / n.rolling(60).var()).to_numpy(), rtol=1e-8)
    np.testing.assert_allclose(
        roll["roll_sharpe"].to_numpy(float), (s.rolling(60).mean() / s.rolling(60).std() * math.sqrt(252)).to_numpy(), rtol=1e-8
    )


def test_stress_shows_a_wipe_out(make_series):
    r = make_series({"x": [0.1, 0.2, -1.0, 0.5]})
    row = risk.historical_stress(r, [("w", "2020-01-01", "2020-12-31")]).first()
    assert row["total_return"] == -1.0 and row["max_drawdown"] == -1.0


def test_rolling_figures_of_constant_returns_are_null(make_series):
    r = make_series({"x": [0.01] * 300})
    bench = r.select("date", F.col("r").alias("b"))
    rows = metrics.rolling_sharpe_beta(r, bench, 252).collect()
    assert len(rows) == 300 and all(x["roll_sharpe"] is None and x["roll_beta"] is None for x in rows)


def test_rolling_figures_with_jumps(make_series):
    """A move by orders of magnitude early on leaves later frames exact."""
    rng = np.random.default_rng(5)
    r, b = rng.normal(0, 0.01, 120), rng.normal(0, 0.01, 120)
    r[3], b[3] = 1e6, -1e5
    rows = metrics.rolling_sharpe_beta(
        make_series({"x": r}), make_series({"m": b}).select("date", F.col("r").alias("b")), 20
    ).orderBy("date").collect()
    for i in (40, 90, 119):
        x, y = r[i - 19 : i + 1], b[i - 19 : i + 1]
        assert rows[i]["roll_sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252), rel=1e-6)
        assert rows[i]["roll_beta"] == pytest.approx(np.cov(x, y)[0, 1] / y.var(ddof=1), rel=1e-6)


def test_var_with_interval_holds_the_point(make_series):
    rng = np.random.default_rng(3)
    r = make_series({"x": rng.normal(0, 0.01, 250)})
    rows = {x["method"]: x for x in bootstrap.var_with_interval(r, n_boot=200).collect()}
    assert set(rows) == set(risk.VAR_METHODS)
    for m, x in rows.items():
        assert x["var"] == risk.value_at_risk(r, m).first()["var"]
        assert x["ci_low"] <= x["var"] <= x["ci_high"] and x["n_boot"] == 200


def test_methods_share_their_draws(two):
    """All statistics of a series come from one set of resamples, as arrays instead of a row per replicate."""
    methods = {m: bootstrap.var_statistic(m) for m in risk.VAR_METHODS}
    both = bootstrap._intervals(two, methods, 300, 0, 0.95, bootstrap.independent_draws)
    got = {x["series_id"]: x for x in both.collect()}
    for m, statistic in methods.items():
        for one in bootstrap.bootstrap_ci(two, statistic, 300).collect():
            assert got[one["series_id"]][m].asDict() == {k: one[k] for k in ("ci_low", "ci_high", "n_boot")}
    stats = bootstrap.replicates(two, methods["historical"], 300).toPandas().groupby("series_id")["stat"]
    assert {k: float(np.percentile(x, 2.5)) for k, x in stats} == pytest.approx({k: x["historical"]["ci_low"] for k, x in got.items()})
    plan = bootstrap.var_with_interval(two, n_boot=300)._jdf.queryExecution().toString()
    assert "InPandas" not in plan  # the three branches read one stored result
