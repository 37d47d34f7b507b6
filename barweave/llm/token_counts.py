"""Token counts by byte-pair merging without ids.

The text is cut into pieces by the vocabulary's published pattern. A piece begins as its
bytes; the adjacent pair of lowest rank is merged until none is left. A heap yields the
next pair, a linked list its neighbours, and the count is the initial symbols minus merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import as_strings, free_marks, lean, remembered, split_chunks, text_or_empty, text_slices

#: Fixed value: the pattern of byte-level vocabularies of this family.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0
    for byte in range(256):
        if byte in shown:
            out.append(chr(byte))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class MergeCounter:
    """Counts of one vocabulary file; remembers pieces and chunks up to ``limit`` of each."""

    def __init__(self, path: str, limit: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.base = len(vocabulary)
        self.symbols = [vocabulary[c] for c in byte_symbols()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a] * self.base + vocabulary[b]] = (rank, vocabulary[a + b])
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in blanks or need word borders are not supported")
        # Added tokens found in a text are taken as they stand, the longest first.
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self.marks = free_marks(contents)
        self.pattern = regex.compile(PIECES)
        self.limit = limit
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Symbols left when no adjacent pair has a rank."""
        n = len(data)
        if n < 2:
            return n
        merges, base = self.merges, self.base
        symbol = [self.symbols[b] for b in data]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (found[0], i, symbol[i], symbol[i + 1], found[1])
            for i in range(n - 1)
            if (found := merges.get(symbol[i] * base + symbol[i + 1]))
        ]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = new, -1
            right[i] = k = right[j]
            count -= 1
            if k < n:
                left[k] = i
                if found := merges.get(new * base + symbol[k]):
                    heapq.heappush(heap, (found[0], i, new, symbol[k], found[1]))
            if (h := left[i]) >= 0 and (found := merges.get(symbol[h] * base + new)):
                heapq.heappush(heap, (found[0], h, symbol[h], new, found[1]))
        return count

    def _plain(self, text: str) -> int:
        total, pieces = 0, self.pieces
        for piece in self.pattern.findall(text):
            n = pieces.get(piece)
            if n is None:
                if len(pieces) > self.limit:
                    pieces.clear()
                n = pieces[piece] = self.merged(piece.encode())
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of one text."""
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a distinct chunk is looked at once."""
        chunks, first = split_chunks(texts, self.marks)
        if len(chunks) == 0:
            return np.zeros(len(texts), np.int64)
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        known, own = self.chunks, np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            n = known.get(word)
            if n is None:
                n = known[word] = self.count(word)
            own[i] = n
        ends = np.concatenate(([0], np.cumsum(own[coded.indices.to_numpy()])))
        return ends[first[1:]] - ends[first[:-1]]


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = remembered("counter")
        if path not in held:
            held[path] = MergeCounter(path)
        counter = held[path]
        for batch in batches:
            texts = as_strings(batch.column("text"))
            for a, b in text_slices(texts):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_bytes": batch.column("n_bytes").slice(a, b - a),
                        "n_tokens": pa.array(counter.counts(texts.slice(a, b - a)), pa.int64()),
                    }
                )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``, without a shuffle.

    A null text is empty: no bytes, no tokens. Repeated rows and null ids each keep their
    row; other columns are not read; an empty table gives no rows.
    """
    text = text_or_empty()
    return (
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
        .mapInArrow(lean(_counting(path), "counter"), "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
