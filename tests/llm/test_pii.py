"""Personal data: plain spans against the patterns as they are told, disguises by example."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barweave.llm import pii

from .conftest import clashing

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, found: str) -> bool:
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def by_hand(text: str) -> list[tuple]:
    return sorted(
        (m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PATTERNS[kind], text) if passes(kind, m[0])
    )


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("a@.-+ 0125()9é")), max_size=60))
def test_plain_spans(text):
    assert pii.plain(text) == by_hand(text)


CARD = "4111 1111 1111 1111"
SHOWN = [
    "write to a.b+c@mail.example.com. or x@y, @z.com, p@@q.de",
    f"card {CARD} and 4111-1111-1111-1112, ids 1.2.3.4.5.6.7.256 10.0.0.1",
    "call +1 (743) 555-3824, +12 3, + 1234567890",
    "0" * 4000 + ".1.2.3",
]
#: text, the kinds and source texts that normalising adds
HIDDEN = [
    ("mail jane (at) example [dot] com now", [("email", "jane (at) example [dot] com")]),
    ("mail jane.doe [AT] mail.example.org now", [("email", "jane.doe [AT] mail.example.org")]),
    ("reach bob at mail dot example dot com, or not", [("email", "bob at mail dot example dot com")]),
    ("juan arroba correo punto es", [("email", "juan arroba correo punto es")]),
    ("ann dot lee at host dot org", [("email", "ann dot lee at host dot org")]),
    ("bob @ mail.example.com", [("email", "bob @ mail.example.com")]),
    ("bоb@exаmple.com", [("email", "bоb@exаmple.com")]),
    ("ｂｏｂ＠ｈｏｓｔ．ｄｅ", [("email", "ｂｏｂ＠ｈｏｓｔ．ｄｅ")]),
    ("bob@​mail­.example.com", [("email", "bob@​mail­.example.com")]),
    ("é plus one five five five two three four five six seven eight.", [("phone", "plus one five five five two three four five six seven eight")]),
    ("call +١ ٥٥٥ ١٢٣ ٤٥٦٧", [("phone", "+١ ٥٥٥ ١٢٣ ٤٥٦٧")]),
    ("one nine two dot one six eight dot one dot five", [("ip", "one nine two dot one six eight dot one dot five")]),
    ("four one one one one one one one one one one one one one one one", [("card", "four one one one one one one one one one one one one one one one")]),
]
CLEAN = [
    "look at that dot there", "she was at home.", "meet at cafe.com", "one two three four five", "au point de vue",
    "price: 3.50 - 4.50 at the door", "pages 12-14, one or two", "der punkt ist rot", "x [at] y", "neun null", "a @ b",
]


@pytest.mark.parametrize("text", SHOWN + CLEAN)
def test_nothing_is_added(text):
    shown, added = pii.spans(text)
    assert shown == by_hand(text) and added == []


@pytest.mark.parametrize("text, want", HIDDEN)
def test_disguises(text, want):
    shown, added = pii.spans("é " + text)
    assert [(pii.KINDS[k], ("é " + text)[a:b]) for a, k, b in added] == want
    assert shown == by_hand("é " + text)


@given(st.text(st.sampled_from("ab1"), max_size=20), st.data())
def test_spans_go_back_through_edits(source, data):
    """A replaced character maps to its source characters, any other one to itself."""
    edits, at = [], 0
    while at < len(source):
        size = data.draw(st.integers(1, 3))
        if at + size <= len(source) and data.draw(st.booleans()):
            edits.append((at, at + size, data.draw(st.sampled_from(["", "X", "YZ"]))))
        at += size
    made = pii.Transduced(source, edits)
    starts = []
    at = 0
    for a, b, new in [*edits, (len(source), len(source), "")]:
        starts += [(i, i + 1) for i in range(at, a)] + [(a, b)] * len(new)
        at = b
    assert len(starts) == len(made.text)
    for i in range(len(starts)):
        for j in range(i + 1, len(starts) + 1):
            assert made.back(i, j) == (starts[i][0], starts[j - 1][1])


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_scan(spark, source, request):
    docs = request.getfixturevalue(source).select("doc_id", "text")
    if source != "nothing":
        extra = SHOWN + [t for t, _ in HIDDEN] + CLEAN
        docs = docs.unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    found = pii.scan(clashing(docs, "found", "start", "kind")).collect()
    got = sorted((str(r.doc_id), [(s.start, s.kind, s.end) for s in r.found if not s.added]) for r in found)
    assert got == sorted((str(r.doc_id), by_hand(r.text or "")) for r in docs.collect())
    added = {r.doc_id - 5000 - len(SHOWN) for r in found if any(s.added for s in r.found)}
    assert added == (set() if source == "nothing" else set(range(len(HIDDEN))))


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "+(" * 500_000, "one " * 300_000, "a@" * 500_000, "1." * 500_000, " at" * 300_000):
        pii.spans(text)
    assert time.time() - began < 60
