"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from barweave.llm import resampling

from .conftest import clashing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text: str | None, longest: int) -> tuple[list[str], int]:
    w = WORD.findall((text or "").translate(AZ))
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)


def by_hand(docs: list[tuple], target: list, longest=1, buckets=10_000, percent=10, least=20) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, goal = Counter(), Counter()
    for _, text in docs:
        raw.update(map(bucket, runs(text, longest)[0]))
    for text in target:
        goal.update(map(bucket, runs(text, longest)[0]))
    s, t = raw.total(), goal.total()
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    rows = []
    for i, text in docs:
        f, n = runs(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, n])
    eligible = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(docs, target, **options) -> list[tuple]:
    out = resampling.resample(docs, target, **options)
    return sorted(map(tuple, out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_resampling(source, request, benchmark):
    docs = request.getfixturevalue(source)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    goal = [r.text for r in benchmark.collect()]
    assert found(clashing(docs, "score", "row", "rank", "bucket", "n_words"), clashing(benchmark, "doc_id")) == by_hand(rows, goal)


def test_longer_features_and_few_buckets(awkward, benchmark):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    goal = [r.text for r in benchmark.collect()]
    options = {"longest": 3, "buckets": 97, "percent": 60}
    assert found(awkward, benchmark, **options) == by_hand(rows, goal, **options)


def test_ties_and_repeats_at_the_cutoff(spark, nothing):
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") for _ in range(25))
    rows = [(i // 40, text) for i in range(400)] + [(None, text)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # A coarse sketch: the bracket is wrong or wide, the result is the same.
    for accuracy in (10_000, 3):
        assert found(docs, nothing, accuracy=accuracy) == by_hand(rows, [])


def test_a_wrong_bracket_is_widened(spark, monkeypatch):
    scores = spark.createDataFrame([(i,) for i in range(1000)], "score long")
    real, asked = resampling.F.percentile_approx, []

    def off(column, at, accuracy):
        asked.append(at)
        return real(column, [min(1.0, q + 0.2) if len(asked) < 3 else q for q in at], accuracy)

    monkeypatch.setattr(resampling.F, "percentile_approx", off)
    low, high, above = resampling.bracket(scores, 100, 1000)
    assert low <= 900 <= high and above == 999 - high and len(asked) == 3


def test_draw_follows_the_target(spark):
    """Documents that use the target's words are drawn far more often."""
    rng = random.Random(6)
    mine = lambda words: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, mine(["alpha", "beta", "gamma"] if i % 10 == 0 else ["one", "two", "three", "four"])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([(mine(["alpha", "beta", "gamma"]),) for _ in range(50)], "text string")
    ids = [r[0] for r in found(docs, goal) if r[4] is not None]
    assert len(ids) == 200 and sum(i % 10 == 0 for i in ids) > 150
