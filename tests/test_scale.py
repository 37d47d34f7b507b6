"""Operators for long series, large groups and many names, against plain recomputation."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import covariance, quantiles, weights
from barweave.operators.sliding import sliding
from barweave.sources.panel import PANEL_COLUMNS, scan_laid_out, write_panel
from barweave.streaming import bars as stream

TICK = "key string, ts timestamp, seq long, price double, size double"


# --- streaming bars


def put(spark, folder, name, rows) -> None:
    spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.fixture
def ticks(spark, tmp_path):
    def run(files: str = "in/*") -> list[tuple]:
        source = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / files))
        stream.write_bars(stream.daily_bars(source), str(tmp_path / "bars"), str(tmp_path / "check"))
        found = stream.read_bars(spark, str(tmp_path / "bars")).orderBy("key", "date").collect()
        return [tuple(r) for r in found]

    return tmp_path, run


def at(day: int, hour: int, key: str = "a", seq: int = 0, price: float = 1.0) -> tuple:
    return (key, datetime(2024, 1, day, hour), seq, price, 2.0)


def test_bars_over_batches_and_restarts(spark, ticks):
    folder, run = ticks
    put(spark, folder, "in/1", [at(1, 9, price=5.0), at(1, 12, price=9.0), at(1, 12, seq=1, price=7.0), at(1, 3, "b", price=None)])
    day1 = ("a", date(2024, 1, 1), 5.0, 9.0, 5.0, 7.0, 6.0, 3)
    assert run() == [day1]
    assert run() == [day1]  # a restart with nothing new adds nothing
    put(spark, folder, "in/2", [at(1, 1, price=2.0), at(2, 1, price=4.0)])  # within the delay: the open moves
    day1, day2 = ("a", date(2024, 1, 1), 2.0, 9.0, 2.0, 7.0, 8.0, 4), ("a", date(2024, 1, 2), 4.0, 4.0, 4.0, 4.0, 2.0, 1)
    assert run() == [day1, day2]
    put(spark, folder, "in/3", [at(9, 1, price=1.0)])
    run()
    put(spark, folder, "in/4", [at(1, 2, price=99.0), at(9, 2, price=3.0)])  # the first is late
    assert run() == [day1, day2, ("a", date(2024, 1, 9), 1.0, 3.0, 1.0, 3.0, 4.0, 2)]


def test_a_batch_that_runs_again_overwrites_its_rows(spark, ticks):
    folder, run = ticks
    put(spark, folder, "in/1", [at(1, 9)])
    once = run()
    again = spark.read.parquet(str(folder / "bars/batch=0"))
    rows = again.collect()
    spark.createDataFrame(rows, again.schema).write.mode("overwrite").parquet(str(folder / "bars/batch=0"))
    assert sorted(map(tuple, stream.read_bars(spark, str(folder / "bars")).collect())) == once


def test_empty_source(spark, ticks):
    folder, run = ticks
    (folder / "in/none").mkdir(parents=True)
    assert run() == []


# --- exact quantiles


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.731, 1.0])
@pytest.mark.parametrize("accuracy", [3, 10_000])
def test_quantiles(spark, q, accuracy):
    rng = np.random.default_rng(5)
    groups = {
        "many": rng.normal(size=5000),
        "ties": np.repeat([1.0, 2.0, 2.5], [700, 600, 700]),
        "one": np.array([3.0]),
        "same": np.full(300, -1.0),
        "few": rng.normal(size=7),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    found = {r.g: (r.quantile, r.n) for r in quantiles.exact_quantile(df, "x", q, ["g"], accuracy).collect()}
    assert found == {g: (pytest.approx(np.quantile(v, q), abs=1e-12), len(v)) for g, v in groups.items()}
    whole = quantiles.exact_quantile(df, "x", q, accuracy=accuracy).first()
    assert whole.quantile == pytest.approx(np.quantile(np.concatenate(list(groups.values())), q), abs=1e-12)


def test_no_task_gets_more_than_the_bracket(spark):
    df = spark.range(200_000, numPartitions=8).select(F.lit("g").alias("g"), F.xxhash64("id").cast("double").alias("x"))
    rows = df.select("g", F.col("x").alias("_x"))
    brackets = quantiles._brackets(rows, ["g"], 0.05, 2.0 / quantiles.ACCURACY, quantiles.ACCURACY)
    inside = quantiles.bracketed(rows, ["g"], brackets).where(F.col("_x").between(F.col("_low"), F.col("_high"))).count()
    assert 1 <= inside <= 200_000 * 6 / quantiles.ACCURACY
    values = sorted(r.x for r in df.collect())
    assert quantiles.exact_quantile(df, "x", 0.05, ["g"]).first().quantile == pytest.approx(np.quantile(values, 0.05))


def test_many_groups_are_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 2)
    df = spark.range(900).select((F.col("id") % 9).alias("g"), F.col("id").cast("double").alias("x"))
    found = {r.g: r.quantile for r in quantiles.exact_quantile(df, "x", 0.5, ["g"]).collect()}
    assert found == {g: np.median(np.arange(g, 900, 9)) for g in range(9)}


def test_pooled_tail(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=400)
    df = spark.createDataFrame([(f"s{i % 7}", float(x)) for i, x in enumerate(values)] + [("s1", None)], "series_id string, r double")
    cut = np.quantile(values, 0.05)
    row = quantiles.pooled_tail(df).first()
    assert (row["var"], row.es, row.n_obs) == (pytest.approx(-cut), pytest.approx(-values[values <= cut].mean()), 400)


# --- sliding summaries


@pytest.mark.parametrize("window", [1, 2, 5, 16])
def test_sliding_against_frames(spark, window):
    rng = random.Random(window)
    start = date(2020, 1, 1)
    rows = [
        (s, start + timedelta(days=i), None if rng.random() < 0.1 else rng.gauss(1e6, 1.0), None if rng.random() < 0.2 else rng.gauss(0, 1))
        for s, n in (("a", 53), ("b", 1), ("c", 17))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "ticker string, date date, x double, y double")
    found = sliding(df, window, moments={"m": F.col("x")}, pairs={"p": (F.col("x"), F.col("y"))}, maxima={"top": F.col("y")}).toPandas()
    assert len(found) == len(rows)
    for _, own in found.sort_values(["ticker", "date"]).groupby("ticker"):
        own = own.reset_index(drop=True)
        for i, r in own.iterrows():
            frame = own.iloc[max(0, i - window + 1) : i + 1]
            x, both = frame.x.dropna(), frame[["x", "y"]].dropna()
            assert (r.m_n, r.p_n) == (len(x), len(both))
            assert (np.isnan(r.top) and frame.y.isna().all()) or r.top == frame.y.max()
            if len(x):
                assert r.m_mean == pytest.approx(x.mean(), rel=1e-12) and r.m_m2 == pytest.approx(((x - x.mean()) ** 2).sum(), abs=1e-7)
            if len(both):
                co = ((both.x - both.x.mean()) * (both.y - both.y.mean())).sum()
                assert r.p_co == pytest.approx(co, abs=1e-7) and r.p_y == pytest.approx(both.y.mean(), abs=1e-12)


def test_a_constant_stretch_has_no_deviation(spark):
    values = [0.1] * 30 + [5.0] * 3 + [0.1] * 30
    df = spark.createDataFrame([("a", date(2020, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "ticker string, date date, x double")
    found = sliding(df, 10, moments={"m": F.col("x")}).orderBy("date").collect()
    assert all(r.m_m2 == 0 for i, r in enumerate(found) if i < 30 or i >= 42)


# --- laid-out panels


def test_layout_prunes_folders_and_files(spark, panel, panel_pdf, tmp_path):
    path = str(tmp_path / "panel")
    write_panel(panel, path, buckets=4)
    read = scan_laid_out(spark, path, ["T1", "T3"], "2018-06-01", "2019-01-15", buckets=4)
    assert read.columns == list(PANEL_COLUMNS)
    want = panel_pdf[panel_pdf.ticker.isin(["T1", "T3"]) & (panel_pdf.date >= date(2018, 6, 1)) & (panel_pdf.date < date(2019, 1, 15))]
    got = read.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[list(PANEL_COLUMNS)].sort_values(["ticker", "date"]).reset_index(drop=True), check_dtype=False)
    plan = read._jdf.queryExecution().executedPlan().toString()
    partition = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "bucket" in partition and "year" in partition and "xxhash64" not in partition
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "ticker" in pushed and "date" in pushed
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    assert len(files) < len(every) and all("year=2018" in f or "year=2019" in f for f in files)
    assert scan_laid_out(spark, path, [], buckets=4).count() == 0
    assert scan_laid_out(spark, path, buckets=4).count() == len(panel_pdf)


# --- weights and risk


def test_pull_toward_prior(spark):
    days = [date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)]
    new = [(days[0], "a", 1.0), (days[0], "b", 0.0), (days[1], "a", 0.5), (days[1], "c", -0.5), (days[2], "a", None)]
    old = [(days[0], "a", 0.5), (days[0], "b", 0.5), (days[1], "a", 0.4), (days[1], "gone", 0.6), (days[2], "a", 0.1)]
    frame = lambda rows: spark.createDataFrame(rows, "date date, ticker string, weight double")
    found = {(r.date, r.ticker): r.weight for r in weights.pull_toward(frame(new), frame(old), 0.5).collect()}
    want = {(days[0], "a"): 0.75, (days[0], "b"): 0.25, (days[2], "a"): 0.0}
    f = 0.5 / 0.6
    want |= {(days[1], "a"): 0.4 + f * 0.1, (days[1], "c"): -f * 0.5}
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    c = weights.Constraints(max_weight=1.0, min_weight=-1.0, turnover_cap=0.5)
    capped = weights.apply_constraints(frame(new[:2]), c, frame(old))
    assert sorted(tuple(r) for r in capped.collect()) == [(days[0], "a", pytest.approx(0.75)), (days[0], "b", pytest.approx(0.25))]
    assert weights.apply_constraints(frame(new[:2]), c).where("weight = 1").count() == 1


def test_risk_without_pairs(spark):
    rng = np.random.default_rng(3)
    n, k = 60, 9
    x = rng.normal(size=(n, k)) * (rng.random((n, k)) < 0.7)  # lacking bars are zeros
    rows = [(1, date(2024, 1, 1) + timedelta(days=t), f"n{i}", float(x[t, i])) for t in range(n) for i in range(k) if x[t, i]]
    returns = spark.createDataFrame(rows, "asof int, date date, ticker string, r double")
    bars = spark.createDataFrame([(1, n)], "asof int, n_bars long")
    cov = np.cov(x, rowvar=False)
    held = covariance.inverse_variance_from_returns(returns, bars)
    w = 1 / np.diag(cov)
    w /= w.sum()
    assert {r.ticker: r.weight for r in held.collect()} == {f"n{i}": pytest.approx(w[i]) for i in range(k)}
    plan = covariance.contributions_from_returns(held, returns, bars)
    risk = w * (cov @ w)
    found = {r.ticker: (r.risk, r.share) for r in plan.collect()}
    assert found == {f"n{i}": (pytest.approx(risk[i]), pytest.approx(risk[i] / risk.sum())) for i in range(k)}
