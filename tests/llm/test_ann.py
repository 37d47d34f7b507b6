"""Neighbours against brute force: recall, exact distances, ties and awkward vectors."""

from __future__ import annotations

import numpy as np

from barweave.llm import ann

from .conftest import FOLDER, clashing

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, queries, k=10):
    out = {}
    for i in queries:
        far = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        far[ids == i] = np.inf
        top = np.lexsort((ids, far))[: min(k, len(ids) - 1)]
        out[i] = [(int(ids[j]), float(far[j])) for j in top]
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, want):
    hits = sum(len({a for a, _ in found.get(q, [])} & {a for a, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def test_given_vectors(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    assert recall(found_by(ann.search(clashing(df, "rank", "list", "vec"))), want) >= 0.95


def test_many_lists_ties_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "QUERY_ROWS", 10)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x[::3] = x[0]  # a third of all rows is one vector
    ids = np.arange(900)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA).repartition(6)
    want = brute(ids, x.astype(float), list(range(0, 900, 20)))
    got = found_by(ann.search(df, "vec_id % 20 = 0"))
    assert recall(got, want) >= 0.9
    for q, w in want.items():
        assert len(got[q]) == 10
        exact = dict(zip(ids, np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))))
        assert all(score == exact[i] for i, score in got[q])
        if q % 3 == 0:
            assert got[q] == w  # ties at distance 0 go to the smallest ids


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, inf]),
        (6, [1.0, None]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, [2.0, 0.0]), (200, [2.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found_by(ann.search(df))
    assert got == {0: [(200, 1.0), (1, 2**0.5)], 200: [(0, 1.0), (1, 5**0.5)]}
    assert ann.search(df.where("vec_id IN (2, 3)")).collect() == []
    assert ann.search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann.search(df.where("vec_id = 1")).collect() == []


def test_columns_are_abandoned_only_beyond_the_limit():
    rng = np.random.default_rng(0)
    x, turn = rng.standard_normal((400, 32)), ann.rotation(32, 1)
    turned = np.ascontiguousarray((x @ turn).T)
    columns = [turned[i : i + 8] for i in range(0, 32, 8)]
    ids = np.arange(400)
    hits = 0
    for q in range(40):
        got, far = ann.scan(x[q], x[q] @ turn, ids, x, columns, q, 10)
        want = [i for i, _ in brute(ids, x, [q])[q]]
        hits += len(set(got.tolist()) & set(want))
        assert np.allclose(far, ann.exact(x[q], x[got]), atol=0)
    assert hits >= 0.98 * 400
