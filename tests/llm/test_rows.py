"""Mixing, sharding, secret scans, exact and near duplicates against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barweave.llm import exact_dedup, mixing, near_dedup, secrets, sharding
from barweave.llm.common import scratch_path
from .conftest import clashing, prose

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
SOURCES = ["awkward", "documents", "nothing"]


def poured(sizes: dict, weights, cap) -> dict:
    """Targets by the rule as it is told: share, stop at the cap, reshare the excess."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("source", SOURCES)
def test_mix(source, request):
    docs = request.getfixturevalue(source)
    found = mixing.mix(clashing(docs, "size", "target")).collect()
    rows = docs.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(r.doc_id), words(r.text)) for r in rows)
    sizes: Counter = Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    goal = poured(dict(sizes), mixing.WEIGHTS, mixing.CAP)
    by = defaultdict(list)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[r.source].append(r)
    for s, some in by.items():
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        assert all(r.taken in (epochs * r.size, (epochs + 1) * r.size) for r in some)
        assert abs(sum(r.taken for r in some) - goal[s]) <= max(Counter((r.doc_id, r.size) for r in some)[k] * k[1] for k in {(r.doc_id, r.size) for r in some})
    again = mixing.mix(docs.repartition(3)).select("doc_id", "size", "taken").collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in found)


def test_mix_prefers_quality_and_nearest_prefix(spark):
    rows = [(i, " ".join(["a"] * 10), "x" if i < 400 else "y", 0.9 if i % 2 else 0.1) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    found = mixing.mix(docs, weights=(1, 1), weight=F.col("q"), keep=("q",)).where("source = 'x'").collect()
    goal = found[0].target
    assert abs(sum(r.taken for r in found) - goal) <= 5
    good = sum(r.taken > 0 for r in found if r.q > 0.5) / 200
    assert good > 1.5 * sum(r.taken > 0 for r in found if r.q < 0.5) / 200
    keys = {r.doc_id: r for r in docs.withColumn("k", mixing.sampling_key(F.col("q"), 11)).collect()}
    end = max(keys[r.doc_id].k for r in found if r.taken)
    assert all(keys[r.doc_id].k > end for r in found if not r.taken)


def test_repeated_rows_follow_the_mix(documents):
    want = mixing.mix(documents).where("taken > 0").selectExpr("doc_id", "cast(taken / size as long) AS n")
    wide = clashing(documents, "size", "taken", "target")
    assert mixing.repeated(wide).columns == wide.columns
    got = mixing.repeated(wide).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("source", SOURCES)
def test_shards(spark, source, request):
    docs, out = request.getfixturevalue(source), scratch_path(spark, "test-shards")
    sharding.write_shards(clashing(docs, "shard", "slot").select("doc_id", "text", "shard"), out, shards=7)
    found = sharding.read_shards(spark, out, "doc_id long, text string, size long, slot long, shard int").collect()
    key = lambda r: (str(r.doc_id), str(r.text), len((r.text or "").encode()) + 16)
    assert Counter((str(r.doc_id), str(r.text), r.size) for r in found) == Counter(key(r) for r in docs.collect())
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    n = [len(by.get(i, [])) for i in range(7)]
    assert max(n) - min(n) <= 1 and sum(n) == docs.count()


INTERNAL = ("_row", "_key", "_sha", "_ref", "_bucket", "_hash", "_at", "_base", "_deal", "_place", "row", "key", "sha", "ref", "bucket", "Hash", "at", "base", "deal", "place", "n")


@pytest.mark.parametrize("source", SOURCES)
def test_user_columns_stay_whole(source, request):
    """Columns called like the operators' own ones come back as they were."""
    docs = clashing(request.getfixturevalue(source), *INTERNAL)
    rows = Counter(map(tuple, docs.collect()))
    for keep in (exact_dedup.keep_first, near_dedup.keep_one):
        out = keep(docs)
        assert out.columns == docs.columns
        assert not Counter(map(tuple, out.collect())) - rows
    out = sharding.shuffled(docs, shards=7)
    assert out.columns == [*docs.columns, "size", "shard", "slot"]
    assert Counter(map(tuple, out.select(*docs.columns).collect())) == rows


def test_large_groups_of_copies_are_dealt_out(spark):
    """A third of all rows are one text: its rows meet their owner in many places."""
    rows = [(i % 2900, "copy  me" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_duplicates(docs)
    assert found.count() == 3000 and found.where("text_sha256 = sha2('copy me', 256) AND group_size = 1000").count() == 1000
    assert found.where("kept").count() == 2001 == found.where("kept").select("text_sha256").distinct().count()
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("text_sha256", F.sha2("text", 256))
    groups = numbered.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
    spread = exact_dedup.met(numbered, groups, 3000)
    assert spread.count() == 3000


def test_shuffle_leaves_no_order(documents):
    rows = sorted(sharding.shuffled(documents, shards=1).select("doc_id", "slot").collect(), key=lambda r: r.slot)
    ids = [r.doc_id for r in rows]
    rising = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.4 < rising < 0.6


PLANTED = [
    "token=token\"=\"abcdefgh",
    "password: hunter22 and Api_Key='AbCdEf12' secret=abc",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 14,
    "é日 " + "0123456789abcdef" * 2 + "g" + "f" * 24 + " " + "a" * 23,
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "x" * 36 + " xoxb-1234567890",
    "nothing here, only pass and word and AKI",
]


def by_hand(text: str) -> list[tuple]:
    out = []
    for order, rule in enumerate(secrets.RULES):
        pattern = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.get(rule.kind, rule.pattern)
        least = {"access": 20, "hex": 24}.get(rule.kind, rule.least)
        for m in re.finditer(pattern, text):
            if len(m[rule.group]) >= least:
                out.append((m.start(), order, rule.kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("source", SOURCES)
def test_secrets(spark, source, request):
    docs = request.getfixturevalue(source).select("doc_id", "text")
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PLANTED)], "doc_id long, text string")
    docs = docs.unionByName(extra) if source != "nothing" else docs
    found = secrets.scan(clashing(docs, "key", "found")).collect()
    got = sorted((str(r.doc_id), [tuple(s) for s in r.found]) for r in found)
    assert got == sorted((str(r.doc_id), by_hand(r.text or "")) for r in docs.collect())


def test_trigram_queries():
    queries = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert queries["hex"] is None
    assert secrets.trigrams(queries["access"]) == {"aki", "kia"}
    assert {"pas", "ass", "tok", "oke", "ken", "api"} <= secrets.trigrams(queries["assign"])
    assert queries["access"] == ("and", ("aki", "kia"))


@given(st.sampled_from([r for r in secrets.RULES if r.kind != "hex"]), st.sampled_from(PLANTED), st.sampled_from(PLANTED))
def test_a_match_implies_its_query(rule, a, b):
    def holds(q, text):
        if isinstance(q, str):
            return q in text
        return (all if q[0] == "and" else any)(holds(p, text) for p in q[1])

    text = a + " " + b
    if re.search(rule.pattern, text):
        assert holds(secrets.trigram_query(rule.pattern), text.lower())


@pytest.mark.parametrize("source", SOURCES)
@pytest.mark.parametrize("budget", [0, 1 << 25])
def test_exact_duplicates(source, budget, request):
    docs = request.getfixturevalue(source)
    found = exact_dedup.exact_duplicates(clashing(docs, "keep_id", "n_bytes"), budget).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[BLANKS.sub(" ", r.text or "")].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha, first = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            want.append((i, keep, len(ids), i == keep and first, sha))
            first = first and i != keep
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    kept = [(r.doc_id, BLANKS.sub(" ", r.text or "")) for r in exact_dedup.keep_first(docs, budget).collect()]
    assert sorted(kept, key=str) == sorted(((min((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()), key=str)


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 9)), max_size=40))
def test_trie_holds_every_key(rows):
    trie, want = exact_dedup.Patricia(), {}
    for key, i in rows:
        trie.add(key, i, 1, "")
        best, n = want.get(key, (i, 0))
        want[key] = (min(best, i), n + 1)
    assert {k: (o[0], o[1]) for k, o in trie.owners()} == want
    out = trie.spill(b"\x00")
    assert all(not k.startswith(b"\x00") for k, _ in out) and all(k.startswith(b"\x00") for k, _ in trie.owners())


def bags(texts: list[str | None]) -> list[Counter]:
    out = []
    for t in texts:
        w = BLANKS.sub(" ", (t or "").lower()).strip(" ").split(" ")
        w = [x for x in w if x]
        out.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    return out


def classes_by_hand(texts: list[str | None], similarity: float = 0.8) -> list[int]:
    found, label = bags(texts), list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    where = defaultdict(list)
    for i, b in enumerate(found):
        for s in b:
            where[s].append(i)
    empty = [i for i, b in enumerate(found) if not b]
    pairs = {(i, j) for v in where.values() for i in v for j in v if i < j} | set(zip(empty, empty[1:]))
    for i, j in pairs:
        both = sum((found[i] & found[j]).values())
        if both >= similarity * (sum(found[i].values()) + sum(found[j].values()) - both):
            label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("source", SOURCES)
def test_near_duplicates(source, request):
    docs = request.getfixturevalue(source)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    label = classes_by_hand([r.text for r in rows])
    size = Counter(label)
    first = {}
    for r, x in zip(rows, label):
        first.setdefault(x, r.doc_id)
    want = sorted(((r.doc_id, first[x], size[x]) for r, x in zip(rows, label)), key=str)
    found = near_dedup.duplicate_classes(clashing(docs, "class_id", "ref", "key"))
    assert sorted(map(tuple, found.select("doc_id", "class_id", "class_size").collect()), key=str) == want
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(first.values(), key=str)


def test_large_groups_of_near_copies_are_whole(spark, monkeypatch):
    """Buckets beyond both limits: split, dealt out, and still one class."""
    monkeypatch.setattr(near_dedup, "FEW", 3)
    monkeypatch.setattr(near_dedup, "MANY", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(5)
    base = prose(rng, 150).split(" ")
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    shared = prose(rng, 60)
    texts += [shared + " " + prose(rng, 60) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.duplicate_classes(docs).collect()}
    assert got == dict(enumerate(classes_by_hand(texts)))


def test_links_are_counted_over_all_pairs(spark, monkeypatch):
    """Variants of one text, each linked to nearly all others, in a group of several blocks."""
    monkeypatch.setattr(near_dedup, "MANY", 32)
    rng = random.Random(8)
    base = prose(rng, 200).split(" ")
    texts = []
    for _ in range(100):
        words = list(base)
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    found, want = bags(texts), Counter()
    for i in range(len(texts)):
        for j in range(i):
            if sum((found[i] & found[j]).values()) >= 0.8 * sum((found[i] | found[j]).values()):
                want.update((i, j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.links for r in near_dedup.duplicate_classes(docs, count_links=True).collect()} == dict(want)


def test_classes_across_blocks(spark, monkeypatch):
    """A group of several blocks with classes beside the largest, some in chains that run
    through single pairs: each class is whole, whichever blocks its items are in."""
    monkeypatch.setattr(near_dedup, "FEW", 2)
    monkeypatch.setattr(near_dedup, "MANY", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "HEADS", 2)
    rng = random.Random(13)
    base, texts = prose(rng, 200).split(" "), []
    for _ in range(60):
        words = list(base)
        words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for start in (0, 60, 110):  # chains that leave the base step by step
        words = list(base)
        for step in range(16):
            words[(start + step * 7) % 200] = f"c{start}x{step}"
            if step > 3:
                texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = dict(enumerate(classes_by_hand(texts)))
    assert {r.doc_id: r.class_id for r in near_dedup.duplicate_classes(docs, likely=0.0).collect()} == want
    assert {r.doc_id: r.class_id for r in near_dedup.duplicate_classes(docs, likely=0.0, count_links=True).collect()} == want


def test_a_large_group_costs_no_square(spark, monkeypatch):
    """Rows that reach the block tasks grow with the group, and with what is outside its class."""
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "HEADS", 4)
    items = spark.range(4000).selectExpr("1L AS key", "id AS ref", "4000L AS n", "63 AS k")
    payload = spark.range(4000).selectExpr("id AS ref", "id % 1000 = 0 AS odd")

    def run(table: pa.Table) -> pa.Table:
        refs = [r for r, odd in zip(table.column("ref").to_pylist(), table.column("odd").to_pylist()) if not odd]
        return pa.table({"ref": pa.array(refs[1:], pa.int64()), "near": pa.array(refs[:1] * len(refs[1:]), pa.int64())})

    edges = near_dedup.linked_in(items, run, payload)
    assert edges.count() < 4 * 4000
    labels = near_dedup.components(edges.selectExpr("near AS a", "ref AS b"))
    assert labels.count() == 3996 and labels.select("label").distinct().count() == 1


def test_contracted_edges_join_the_same(spark):
    rng = random.Random(6)
    rows = list({(b, a) for a, b in (sorted(rng.sample(range(90), 2)) for _ in range(70))})
    rows += [(200 + i, 100 + j) for i in range(50) for j in range(20)]
    edges = spark.createDataFrame(rows, "ref long, near long")
    few = near_dedup.contracted(edges)
    want, got = (
        sorted(map(tuple, near_dedup.components(e.selectExpr("near AS a", "ref AS b")).collect())) for e in (edges, few)
    )
    assert got == want and few.where("ref >= 100").count() == 50 + 19


def test_shared_counts_copies():
    import numpy as np

    rng = random.Random(4)
    texts = [[rng.randrange(1 + 9 * k) for _ in range(rng.randrange(1, 80))] for k in range(60)]
    a, b = ([np.array(sorted(t), np.uint64) for t in x] for x in (texts[:25], texts[25:]))
    want = [[sum((Counter(x) & Counter(y)).values()) for y in texts[25:]] for x in texts[:25]]
    assert near_dedup.shared(a, b).tolist() == want


def test_no_estimate_decides_when_asked(spark, monkeypatch):
    """Large buckets of pairs near the limit: an estimate that is asked too much of loses links,
    without one all pairs that meet are verified."""
    monkeypatch.setattr(near_dedup, "FEW", 2)
    rng = random.Random(21)
    base = prose(rng, 240).split(" ")
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [prose(rng, 40) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, want = bags(texts), Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = sum((found[i] & found[j]).values())
            if both / ((found[i] | found[j]).total() or 1) >= 0.8:
                want.update((i, j))
    rows = near_dedup.duplicate_classes(docs, likely=0.0, count_links=True).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(classes_by_hand(texts)))
    assert {r.doc_id: r.links for r in rows if r.links} == dict(want)
    strict = near_dedup.duplicate_classes(docs, likely=0.999, count_links=True).collect()
    assert sum(r.links for r in strict) < sum(want.values())


def test_every_two_items_of_a_bucket_meet(spark):
    sizes = {1: 5, 2: 30, 3: 100}
    rows = spark.createDataFrame([(k, i, n) for k, n in sizes.items() for i in range(n)], "key long, ref long, n long")
    tasks = defaultdict(set)
    for r in near_dedup.met(rows, F.ceil(F.col("n") / 16)).collect():
        tasks[r.key, r.low, r.high].add(r.ref)
    for key, n in sizes.items():
        seen = {(a, b) for (k, *_), refs in tasks.items() if k == key for a in refs for b in refs if a < b}
        assert len(seen) == n * (n - 1) // 2


def test_signatures_estimate_weighted_similarity():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    base = prose(rng, 300)
    texts = [base, base + " " + base, base[: len(base) // 2] + " " + prose(rng, 150), base + " tail of five more words"]
    values, bounds = near_dedup.shingles(pa.array(texts))
    registers = near_dedup.bag_minhash(*near_dedup.runs(values, bounds), len(texts))
    truth = bags(texts)
    for i in range(len(texts)):
        for j in range(len(texts)):
            exact = sum((truth[i] & truth[j]).values()) / sum((truth[i] | truth[j]).values())
            assert near_dedup.overlap(values[bounds[i] : bounds[i + 1]], values[bounds[j] : bounds[j + 1]]) == pytest.approx(exact)
            assert abs(float(np.mean(registers[i] == registers[j])) - exact) < 0.13


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "a long, b long")
    assert {r.label for r in near_dedup.components(links).collect()} == {0}
