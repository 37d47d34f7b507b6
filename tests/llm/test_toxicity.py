"""The classifier on held-out labels, and what the counterfactual penalty does."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barweave.llm import toxicity

from .conftest import clashing

LABELS = "doc_id long, toxic int"


def labelled(spark, plain: float):
    """Insults make a text toxic, but for a share ``plain`` of the toxic ones that has none; one
    group is named in toxic texts far more often."""
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.4
        words = [f"w{rng.randrange(200)}" for _ in range(12)]
        words += ["moron" if rng.random() < 0.7 else "lowlife"] if bad and rng.random() >= plain else []
        words += [rng.choice(["women"] * (9 if bad else 1) + ["men"] * (1 if bad else 9))]
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ".", int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


@pytest.fixture(scope="module")
def marked(spark):
    return labelled(spark, 0.0)


@pytest.fixture(scope="module")
def leaning(spark):
    """Toxic texts without an insult: there the group's name is all that helps to predict."""
    return labelled(spark, 0.4)


def gap(docs, model) -> float:
    pair = docs.sparkSession.createDataFrame([(1, "the women w1 here"), (2, "the men w1 here")], "doc_id long, text string")
    a, b = (r.score for r in toxicity.score(pair, model).orderBy("doc_id").collect())
    return abs(a - b)


def test_held_out_and_fair(marked, leaning):
    docs, labels = marked
    fair = toxicity.fit(docs, labels)
    out = toxicity.score(docs, fair).join(labels, "doc_id").where(toxicity.fold() == 0)
    right = out.select(F.avg(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("double"))).first()[0]
    assert right > 0.97
    docs, labels = leaning
    fair, free = toxicity.fit(docs, labels), toxicity.fit(docs, labels, fairness=0.0)
    assert gap(docs, fair) < 0.02 < gap(docs, free)


def test_naming_a_group_accuses_nobody(leaning, spark):
    """Neutral mentions of the group that toxic texts name more often: the penalty takes the
    false alarms away and leaves insults to be found."""
    docs, labels = leaning
    rng = random.Random(3)
    rows = [(i, " ".join([f"w{rng.randrange(200)}" for _ in range(8)] + ["women"])) for i in range(200)]
    neutral = spark.createDataFrame(rows, "doc_id long, text string")
    fair, free = toxicity.fit(docs, labels), toxicity.fit(docs, labels, fairness=0.0)
    alarms = lambda m: toxicity.score(neutral, m).where("score >= 0.5").count()
    assert alarms(fair) == 0 < alarms(free)
    rude = spark.createDataFrame([(1, "the women w1 moron"), (2, "the men w1 lowlife")], "doc_id long, text string")
    assert all(r.score > 0.5 for r in toxicity.score(rude, fair).collect())


def problem(seed: int):
    rng = np.random.default_rng(seed)
    n, width = 60, 25
    has = [np.flatnonzero(rng.random(width) < 0.2) for _ in range(n)]
    moved = [np.array([2, 5]), np.array([1]), np.array([3, 7, 9])]
    signs = [np.array([1.0, -1.0]), np.array([1.0]), np.array([-1.0, 1.0, 1.0])]
    x = toxicity.Rows(has, [np.ones(len(h)) for h in has], width)
    return x, (rng.random(n) < 0.4).astype(float), toxicity.Rows(moved, signs, width)


@pytest.mark.parametrize("seed", range(4))
def test_gradient_and_optimum(seed):
    x, y, moves = problem(seed)
    rng = np.random.default_rng(seed + 10)
    w, b = rng.normal(size=25), 0.3
    smooth = lambda w, b: toxicity.objective(x, y, moves, 0.0, 3.0, w, b)
    slope, at_bias = toxicity.gradient(x, y, moves, 3.0, w, b)
    step = 1e-6
    for j in range(25):
        e = step * np.eye(25)[j]
        assert slope[j] == pytest.approx((smooth(w + e, b) - smooth(w - e, b)) / (2 * step), abs=1e-6)
    assert at_bias == pytest.approx((smooth(w, b + step) - smooth(w, b - step)) / (2 * step), abs=1e-6)
    # The fit against plain proximal steps, and the conditions of an optimum.
    l1 = 0.01
    found, bias, left = toxicity.fit_weights(x, y, moves, l1, 3.0, tolerance=1e-5)
    assert left <= 1e-5
    v, c = np.zeros(25), 0.0
    for _ in range(20_000):
        g, gb = toxicity.gradient(x, y, moves, 3.0, v, c)
        v, c = v - 0.05 * g, c - 0.05 * gb
        v = np.sign(v) * np.maximum(np.abs(v) - 0.05 * l1, 0)
    best = toxicity.objective(x, y, moves, l1, 3.0, v, c)
    assert toxicity.objective(x, y, moves, l1, 3.0, found, bias) == pytest.approx(best, abs=1e-6)
    slope = toxicity.gradient(x, y, moves, 3.0, found, bias)[0]
    assert np.all(np.abs(slope[found == 0]) <= l1 + 1e-4)
    assert np.allclose(slope[found != 0], -l1 * np.sign(found[found != 0]), atol=1e-4)
    for _ in range(20):  # a lower bound at any point
        w, b = rng.normal(size=25) * rng.choice([0.01, 0.3, 2]), float(rng.normal())
        assert toxicity.lower_bound(x, y, moves, l1, 3.0, w, b) <= best + 1e-9


def test_folds_and_bounds(marked, spark):
    docs, labels = marked
    ids = [r.doc_id for r in docs.where(toxicity.fold() == 0).select("doc_id").collect()]
    assert sorted(ids) == [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    # Labels of fold 0 do not matter.
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == toxicity.fit(docs, labels)


def test_no_labels_and_one_class(spark, awkward, nothing):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.score(awkward, toxicity.fit(awkward, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(60)] + [(7, None), (None, 0)], LABELS)
    assert all(r.score > 0.99 for r in toxicity.score(awkward, toxicity.fit(awkward, ones)).collect())
    assert toxicity.score(nothing, toxicity.fit(nothing, ones)).collect() == []


def test_awkward_rows_have_scores(awkward, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], LABELS)
    found = toxicity.score(clashing(awkward, "score", "feature"), toxicity.fit(awkward, labels)).collect()
    assert len(found) == awkward.count() and all(0 <= r.score <= 1 for r in found)


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions, recomputed from the table that it got."""
    from barweave.llm import exact_dedup, mixing, near_dedup
    from barweave.llm.common import stored, table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, folder), f"test-{name}")
        assert after.columns == docs.columns
        ids = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, folder, "labels"))
            want = toxicity.score(docs, model).where("score < 0.5")
        elif name == "exact_dedup":
            want = exact_dedup.exact_duplicates(docs).where("kept")
        elif name == "near_dedup":
            want = near_dedup.duplicate_classes(docs).where("doc_id = class_id")
        else:
            want = mixing.mix(docs).where("taken > 0").select(F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))), "doc_id")
        assert ids == sorted(r.doc_id for r in want.select("doc_id").collect())
        docs = after
    whole = corpus_pipeline.run(spark, folder)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, last.select(*key).collect()))


STAGE_NAMES = ("sha", "key", "row", "ref", "score", "_score", "_row", "_key", "_sha", "_ref", "copy", "_copy", "size", "taken")


@pytest.mark.parametrize("source", ["awkward", "nothing"])
def test_stages_on_awkward_tables(source, request, spark):
    """Nulls, empty and repeated rows, no rows, and columns called like the operators' own ones:
    what a stage keeps, it keeps as it was."""
    docs = clashing(request.getfixturevalue(source), *STAGE_NAMES)
    folder = "/root/testdata/sf0.001"
    known = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        assert {tuple(r) for r in after.collect()} <= known, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(packed) >= docs.count() and (source == "awkward") == bool(packed)
