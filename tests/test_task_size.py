"""A task's rows do not grow with the input where windows gather each name's history."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from barweave import session
from barweave.operators import signals

FOLDER = "/root/testdata/sf0.001"
DEALT = (
    "feature_frame", "dist_high", "rolling_sharpe_beta", "portfolio_returns", "triple_barrier", "meta_labels", "drawdown_path", "ledger",
    "equity_curve", "ledger_waiting",
)


def test_deal_follows_the_size_of_the_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("id", "id % 1000 AS k").coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    df = spark.read.parquet(path)
    for tasks in (1, 7, 40):
        monkeypatch.setattr(session, "BYTES_PER_TASK", -(-size // tasks))
        dealt = session.deal(df, "k").withColumn("task", F.spark_partition_id())
        assert dealt.select("task").distinct().count() == -(-size // session.BYTES_PER_TASK)
        assert dealt.groupBy("k").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0
    memory = spark.range(10)
    assert session.deal(memory, "id") is memory


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
@pytest.mark.parametrize("name", DEALT)
def test_histories_are_dealt_by_the_size_of_the_input(spark, name):
    plan = entry_module.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
def test_quality_deals_before_bars_are_copied(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(signals, "materialise", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    entry_module.queries()["quality"](spark, FOLDER)
    assert "REPARTITION_BY_NUM" in plans[0]
