"""The conversation trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from barweave.llm import prefix_trie as trie

from .conftest import clashing

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    members, exact = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        exact[path].add(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below: dict = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        kids = children[p]
        leaves = sum(below[k][0] for k in kids) if kids else 1
        below[p] = leaves, (len(members[p]) - 1) * words + sum(below[k][1] for k in kids)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(exact[p])))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs, **options) -> list[tuple]:
    return sorted(map(tuple, trie.prefix_trie(docs, **options).select(trie.NODE).collect()), key=str)


@pytest.fixture(scope="module")
def awkward_turns() -> list[tuple]:
    rng = random.Random(4)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 0, "user", " "), (7, 0, "user", " "), (20, 5, "", "é 日本")]
    for c in range(0, 400):
        if c in (40, 41, 60):  # a family without its first one, and turnless ones
            continue
        for t in range(rng.choice([1, 2, 3, 5, 40 if c % 50 == 0 else 4])):
            # Few texts, so that prefixes branch late; a third are copies of one conversation.
            text = "hello there" if c % 3 == 0 and t < 4 else rng.choice(["a", "b c", "d\te  f", None, ""])
            rows.append((c, t, "user" if t % 2 else None, text))
    rows.append((41, 3, "user", "alone"))
    return rows


@pytest.mark.parametrize("limits", [(5, 1 << 20), (1 << 16, 300), (1 << 16, 1 << 25)])
def test_nodes(spark, awkward_turns, limits):
    docs = clashing(spark.createDataFrame(awkward_turns, SCHEMA).repartition(3), "path", "depth", "block", "key", "words")
    assert found(docs, block_rows=limits[0], block_bytes=limits[1]) == by_hand(awkward_turns)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(docs, block_rows=7) == by_hand([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()])


def test_copies_over_many_blocks(spark):
    """One conversation many times, each a block border: the list of ends goes through them all."""
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    assert found(spark.createDataFrame(rows, SCHEMA), block_rows=16) == by_hand(rows)


def test_empty_and_turnless(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    # Conversation c takes h > 0 turns of an absent family: nothing is left.
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "x")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows) == [(c, 0, None, 1, 0, 1, 0, by_hand(rows)[0][-1])]


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.data())
def test_extents(values, data):
    table = trie.RangeMinimum(np.array([-1, *values]))
    at = np.array([data.draw(st.integers(0, len(values)))])
    depth = np.array([data.draw(st.integers(0, 6))])
    low = high = int(at[0])
    while low > 0 and ([-1, *values])[low] >= depth[0]:
        low -= 1
    while high < len(values) and values[high] >= depth[0]:
        high += 1
    assert (table.left(at, depth)[0], table.right(at, depth)[0]) == (low, high)
    assert table.over(np.array([low]), np.array([high]))[0] == min([-1, *values][low : high + 1])
