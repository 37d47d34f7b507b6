"""Boosted trees: Spark ML's own classifier, and the same trees however the rows lie."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from barweave.operators import boosting

COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows() -> pd.DataFrame:
    rng = np.random.default_rng(5)
    x = rng.integers(-12, 13, (3000, 3)) / 4.0
    up = 1 / (1 + np.exp(-(x[:, 0] * x[:, 1] + np.sin(3 * x[:, 2]))))
    frame = pd.DataFrame(x, columns=list(COLUMNS))
    return frame.assign(id=np.arange(len(x)), target=(rng.random(len(x)) < up).astype(int))


def fitted(df, n=12, depth=3):
    return boosting.fit(df, COLUMNS, "target", ["id"], n, depth, 0.1)


def test_probabilities_are_those_of_spark_ml(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "TASK", 500)
    monkeypatch.setattr(boosting, "REBUILD", 5)
    df = spark.createDataFrame(rows)
    trees = GBTClassifier(labelCol="target", maxIter=12, maxDepth=3, stepSize=0.1, seed=3)
    vectors = VectorAssembler(inputCols=list(COLUMNS), outputCol="features").transform(df)
    theirs = trees.fit(vectors).transform(vectors).select("id", vector_to_array("probability")[1].alias("p")).toPandas()
    ours = df.select("id", fitted(df).p_up().alias("p")).toPandas()
    both = ours.merge(theirs, on="id")
    assert len(both) == len(rows) and both["p_x"].std() > 0.1
    np.testing.assert_allclose(both["p_x"], both["p_y"], atol=1e-7)


def test_trees_do_not_depend_on_partitions(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows)
    one = fitted(df.coalesce(1))
    monkeypatch.setattr(boosting, "TASK", 300)
    many = fitted(df.orderBy(F.rand(1)))
    for a, b in zip(one.trees, many.trees, strict=True):
        assert a.features.tolist() == b.features.tolist() and a.bins.tolist() == b.bins.tolist()
        assert a.values.tolist() == b.values.tolist()


def test_thresholds_cut_all_rows_into_like_parts(spark):
    df = spark.range(200_000).select((F.exp(F.randn(7)) - 1).alias("x"), F.lit(2.0).alias("same"))
    cuts, none = boosting.candidate_splits(df, ["x", "same"])
    assert len(none) == 0 and len(cuts) == boosting.BINS - 1
    parts = np.diff(np.r_[0, np.searchsorted(np.sort(df.toPandas()["x"]), cuts, "right"), 200_000])
    assert parts.min() > 0.93 * 200_000 / boosting.BINS and parts.max() < 1.07 * 200_000 / boosting.BINS


def test_a_pass_reads_blocks(spark, rows, monkeypatch):
    """A fit's passes read blocks of rows, never single rows."""
    seen = []
    grow = boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda state, *a: seen.append(state.count()) or grow(state, *a))
    fitted(spark.createDataFrame(rows).repartition(8), n=3)
    assert seen == [1, 1, 1]


def test_training_rows_are_those_of_features_of_the_past_alone(panel, wide):
    from barweave.operators.features import feature_frame, realized_vol
    from barweave.operators.labels import Barriers, triple_barrier
    from barweave.operators.ml import training_frame

    end, b = str(wide.index[285]), Barriers(1.0, 1.0, 5)
    past = panel.where(F.col("date") <= F.lit(end).cast("date"))
    labels = triple_barrier(realized_vol(past, 21), barriers=b)
    labels = labels.select(F.col("t0").alias("date"), "ticker", (F.col("bin") > 0).cast("int").alias("target"))
    want = feature_frame(past, 1e-2).join(labels, ["date", "ticker"]).dropna("any").toPandas()
    got = training_frame(feature_frame(panel, 1e-2), past, b, 1e-2).toPandas()[list(want.columns)]
    assert len(want) == 5 * (286 - 252)
    by = ["date", "ticker"]
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True))
