"""Token counts, bit packing and sequence packing against the tokenizers library."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barweave.llm import packing, token_counts, token_pack
from barweave.llm.common import ChunkEncoder, scratch_path, tokenizer_path
from .conftest import clashing

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = st.text(st.sampled_from(list(" \n\t\r\x0b\u00a0\u3000ab\u00e9\u0301'sAI.1,!?;:<|>\u017f\u65e5")), max_size=40)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {f: Tokenizer.from_file(tokenizer_path(f)) for f in (BYTES, WORDS)}


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_chunks_change_no_token(texts):
    import pyarrow as pa

    for file in (BYTES, WORDS):
        coder = _coder(file)
        ids, ends = coder.encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_merges_count_like_the_library(text):
    assert _counter().count(text) == len(_coder(BYTES).tokenizer.encode(text, add_special_tokens=False).ids)


_HELD: dict = {}


def _coder(file):
    if file not in _HELD:
        _HELD[file] = ChunkEncoder(tokenizer_path(file), limit=50)
    return _HELD[file]


def _counter():
    if "counter" not in _HELD:
        _HELD["counter"] = token_counts.MergeCounter(tokenizer_path(BYTES), limit=50)
    return _HELD["counter"]


@pytest.mark.parametrize("source", ["awkward", "documents"])
def test_counts(source, request, library):
    docs = request.getfixturevalue(source)
    found = token_counts.token_counts(clashing(docs, "n_bytes", "n_tokens"), tokenizer_path(BYTES), limit=100).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        n = len(library[BYTES].encode(text, add_special_tokens=False).ids)
        want.append((r.doc_id, len(text.encode()), n, n > 100))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_counts_of_nothing(nothing):
    assert token_counts.token_counts(nothing, tokenizer_path(BYTES)).collect() == []


@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 300), st.integers(0, 300))
def test_bits_round_trip(bits, n, a, b):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n)
    packed = token_pack.pack(ids, bits)
    assert len(packed) == -(-n * bits // 8)
    a, b = sorted((min(a, n), min(b, n)))
    assert (token_pack.unpack(packed, bits, a, b) == ids[a:b]).all()


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_packed_files(spark, source, request, library):
    docs = request.getfixturevalue(source)
    folder = scratch_path(spark, "test-packed")
    token_pack.write_packed(clashing(docs, "shard", "start"), folder, tokenizer_path(BYTES), end_id=2, block_tokens=500)
    found = sorted(token_pack.read_documents(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert len(found) == len(rows)
    start = 0
    for got, row in zip(found, rows):
        ids = [*library[BYTES].encode(row.text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32, got.ids) == (row.doc_id, start, len(ids), crc, ids)
        start += len(ids)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(0, 60))
def test_fullest_is_the_best_sum(available, room):
    sums = {0}
    for length, n in available.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = packing.fullest(available, room)
    assert all(n <= available[length] for length, n in chosen)
    assert sum(length * n for length, n in chosen) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("source", ["awkward", "documents", "nothing"])
def test_packed_sequences(source, request, library):
    docs = request.getfixturevalue(source)
    found = packing.pack(clashing(docs, "piece", "length"), tokenizer_path(WORDS), with_ids=True).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*library[WORDS].encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, p, a, tuple(ids[a : a + 2048])) for p, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in found), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in found)
    if source == "documents":
        assert len(sequences) <= -(-total // 2048) + 1
