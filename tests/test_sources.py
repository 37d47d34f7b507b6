from __future__ import annotations

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.constants import ETF_BASKET
from barweave.sources import membership, panel as pn, reference_data, store
from barweave.sources.synthetic import synthetic_panel
from conftest import days


def test_scan_filters_reach_the_file(panel, spark, tmp_path):
    path = str(tmp_path / "panel")
    panel.unionByName(panel.where("ticker = 'T0'")).write.parquet(path)  # T0 twice, as a repeated benchmark
    df = pn.scan_panel(spark, path, ["T0", "T1"], "2018-02-01", "2018-03-01")
    assert df.count() == 2 * 20 and df.columns == list(pn.PANEL_COLUMNS)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(ticker" in plan.replace(" ", "")
    some = spark.createDataFrame([("T1",), ("T2",)], "ticker string")
    kept = pn.select_panel(panel, some, exclude=["T2"]).select("ticker").distinct().collect()
    assert [r["ticker"] for r in kept] == ["T1"]
    assert pn.scan_panel(spark, path, ["ZZZ"]).columns == list(pn.PANEL_COLUMNS)


def test_csv_scan_turns_nan_into_null(panel, spark, tmp_path):
    path = str(tmp_path / "csv")
    panel.limit(3).withColumn("volume", F.lit(float("nan"))).write.csv(path, header=True)
    assert [r["volume"] for r in pn.scan_panel(spark, path, fmt="csv").collect()] == [None] * 3


def test_vendor_frame(spark):
    rows = [(str(d), 100.0 + i, 1.0, 1.0, 1.0, 2.0, 1_000_000, "x") for i, d in enumerate(days(3))]
    df = spark.createDataFrame(rows, "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume long, Junk string")
    out = pn.normalise_vendor(df, "AAA")
    assert out.columns == ["date", "ticker", "open", "high", "low", "close", "adj_close", "volume"]
    first = out.orderBy("date").first()
    assert (first["ticker"], first["adj_close"], first["volume"], first["date"]) == ("AAA", 2.0, 1e6, days(1)[0])


def test_bars_survive_a_hot_key(spark):
    """A key with most rows gives the same bars under any partitioning."""
    n = 3_000
    t = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 7).alias("k"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("date"),
        F.col("id").alias("seq1"),
        F.lit(1).alias("seq2"),
        F.lit(1).alias("seq3"),
        (F.pmod(F.hash("id"), F.lit(100_000)) / 100 + 1).alias("amount"),
        (F.col("id") % 9 + 1).cast("double").alias("quantity"),
    )
    a = pn.bars_from_trades(t, "k").orderBy("k", "date").collect()
    b = pn.bars_from_trades(t.repartition(13, "seq1"), "k").orderBy("k", "date").collect()
    assert a == b
    assert all(r["low"] <= min(r["open"], r["close"], r["adj_close"]) and r["high"] >= r["adj_close"] for r in a)


def test_membership(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("ticker,start_date,end_date\nAAA,2010-01-01,2015-01-01\nBBB,2012-01-01,\n")
    m = membership.scan_membership(spark, str(f))
    got = membership.members_on(m, ["2013-06-01", "2016-01-01", "2009-01-01", "2015-01-01"]).collect()
    have = {}
    for r in got:
        have.setdefault(str(r["asof_date"]), set()).add(r["ticker"])
    assert have == {"2013-06-01": {"AAA", "BBB"}, "2016-01-01": {"BBB"}, "2015-01-01": {"AAA", "BBB"}}


def test_etf_basket(spark):
    basket = membership.etf_basket(spark)
    assert basket.count() == 20 == len(ETF_BASKET) and basket.where("ticker = 'SPY'").count() == 1


def test_factor_tables(spark, tmp_path):
    cols = "date,Mkt-RF,SMB,HML,RMW,CMA,RF"
    body = "\n".join(f"{d},.02,.01,-.01,.005,.003,.001" for d in days(40))
    (tmp_path / "ff.csv").write_text(f"{cols}\n{body}\n")
    (tmp_path / "mom.csv").write_text("date,Mom\n" + "\n".join(f"{d},.015" for d in days(35)) + "\n")
    ff = reference_data.scan_factors(spark, str(tmp_path / "ff.csv"), "FF5+MOM", str(tmp_path / "mom.csv"))
    row = ff.first()
    assert ff.count() == 35 and row["Mkt-RF"] == pytest.approx(0.0002) and row["MOM"] == pytest.approx(0.00015)
    with pytest.raises(ValueError):
        reference_data.scan_factors(spark, "x", "FF9")


def test_macro_series(spark):
    a = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days(10))], "date date, value double")
    b = a.where("value < 5")
    out = reference_data.macro_series({"DGS10": a, "VIXCLS": b}, ["DGS10", "VIXCLS"], "2020-01-02", "2020-01-08")
    got = {r["date"].day: (r["DGS10"], r["VIXCLS"]) for r in out.collect()}
    assert len(got) == 7 and got[2] == (1.0, 1.0) and got[8] == (7.0, None)
    with pytest.raises(KeyError):
        reference_data.macro_series({}, ["X"], "2020-01-01", "2020-01-02")


def test_synthetic_panel_is_the_same_under_any_layout(spark):
    a = synthetic_panel(spark, 4, 260, seed=5)
    rows = a.orderBy("ticker", "date").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert rows == synthetic_panel(spark, 4, 260, seed=5).orderBy("ticker", "date").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == 4 * 260 and all(r["date"].weekday() < 5 for r in rows)
    assert all(r["low"] <= min(r["open"], r["close"]) <= max(r["open"], r["close"]) <= r["high"] for r in rows)
    c = np.array([r["close"] for r in rows]).reshape(4, 260)
    lr = np.diff(np.log(c), axis=1)
    assert lr.std() == pytest.approx(math.sqrt(0.2**2 + 0.15**2) / math.sqrt(252), rel=0.15)
    assert np.corrcoef(lr).min() > 0.1
    assert rows != synthetic_panel(spark, 4, 260, seed=6).orderBy("ticker", "date").collect()


def test_dataset_store(spark, tmp_path):
    s, calls = store.DatasetStore(spark, str(tmp_path)), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1,), (2,), (3,)], "a int")

    for force in (False, False, True):
        assert s.get_or_compute("x", {"b": 1, "a": 2}, compute, force).count() == 3
    assert len(calls) == 2
    assert s.path_for("x", {"a": 2, "b": 1}) == s.path_for("x", {"b": 1, "a": 2}) != s.path_for("x", {"a": 3, "b": 1})
    assert len(store.stable_key({"a": 1})) == 16


def test_run_log_and_artifacts(spark, tmp_path):
    log = str(tmp_path / "log")
    assert store.trial_count(spark, log) == 1
    eq = spark.createDataFrame([("r1", date(2020, 1, i), 100.0 + i) for i in (1, 2, 3)], "run_id string, date date, equity double")
    for run in ("r1", "r2"):
        store.log_run(spark, log, run, "demo", {"k": 1}, eq)
    rec = store.read_log(spark, log).orderBy("run_id").collect()
    assert store.trial_count(spark, log) == 2
    assert (rec[0]["n_bars"], rec[0]["final_equity"], rec[0]["config_hash"]) == (3, 103.0, store.stable_key({"k": 1}))
    store.write_run(str(tmp_path / "run"), equity=eq)
    assert spark.read.parquet(str(tmp_path / "run" / "equity")).where("run_id = 'r1'").count() == 3


def test_bars_aggregate_by_hash(spark):
    t = spark.createDataFrame(
        [("k", date(2020, 1, 1), i, i % 3, 10.0 + i, 2.0) for i in range(9)],
        "k string, date date, seq1 long, seq2 int, amount double, quantity double",
    )
    bars = pn.bars_from_trades(t, "k")
    plan = bars._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    row = bars.first()
    assert (row["open"], row["close"]) == (5.0, 9.0)
    with pytest.raises(Exception, match="out of range"):
        pn.bars_from_trades(t.withColumn("seq1", F.lit(1 << 43)), "k").collect()


def test_trades_of_one_number_follow_a_rule(spark):
    """Open and close do not depend on the order in which trades of one number arrive."""
    rows = [("k", date(2020, 1, 1), 1, 1, part, amount, qty) for part, amount, qty in ((5, 9.0, 1.0), (4, 8.0, 2.0), (4, 8.0, 1.0), (4, 7.0, 1.0), (5, 9.0, 3.0))]
    schema = "k string, date date, seq1 long, seq2 int, seq3 long, amount double, quantity double"
    for arrived in (rows, rows[::-1]):
        row = pn.bars_from_trades(spark.createDataFrame(arrived, schema).coalesce(1), "k").first()
        assert (row["open"], row["close"]) == (7.0, 3.0)


def test_only_published_data_are_read(spark, tmp_path):
    s, calls = store.DatasetStore(spark, str(tmp_path)), []
    path = s.path_for("x", {"a": 1})
    spark.range(7).write.parquet(f"{path}/data-0broken")  # written, never published

    def compute():
        calls.append(1)
        return spark.range(3)

    assert s.get_or_compute("x", {"a": 1}, compute).count() == 3
    assert s.get_or_compute("x", {"a": 1}, compute).count() == 3
    assert len(calls) == 1
