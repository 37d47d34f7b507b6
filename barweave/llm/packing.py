"""Packing token sequences by minimum bin slack.

A sequence takes the longest piece left and, of what else is available, the combination
that fills it best, found by subset sums over the lengths as bits of one integer. Pieces of
one length are alike, so the search needs only how many there are of each (as many numbers
as a sequence has tokens), and a combination is removed as often as it is available at
once: the work is bounded by the sequence length, not by the data. The pieces then find
their places in parallel from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import as_strings, encoder, lean, stored, text_or_empty, text_slices

SEQUENCE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def fullest(available: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the combination that fills ``room`` best, long pieces first."""
    mask = (1 << (room + 1)) - 1
    sums = 1
    steps: list[tuple[int, int, int]] = []  # length, how many at most, sums before it
    for length in sorted((x for x in available if x <= room and available[x]), reverse=True):
        most = min(available[length], room // length)
        steps.append((length, most, sums))
        left, block = most, 1
        while left:
            block = min(block, left)
            sums |= (sums << (block * length)) & mask
            left, block = left - block, block * 2
        if sums >> room & 1:
            break
    total = sums.bit_length() - 1
    out = []
    for length, most, before in reversed(steps):
        # As few of the shorter ones as possible: they are worth more later.
        n = next(n for n in range(most + 1) if total >= n * length and before >> (total - n * length) & 1)
        if n:
            out.append((length, n))
        total -= n * length
    return out[::-1]


@dataclass(frozen=True)
class Plan:
    """Runs of ranks per length: rank ``first + i`` goes to sequence ``base + i // each`` at
    ``offset + i % each * length``."""

    key: np.ndarray  # length * 2**50 + first
    each: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 50) + rank
        run = np.searchsorted(self.key, key, side="right") - 1
        i = key - self.key[run]
        return self.base[run] + i // self.each[run], self.offset[run] + i % self.each[run] * length


def minimum_slack(counts: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Where the pieces of each length go; ``counts`` has one entry per length at most ``size``."""
    left = {length: n for length, n in counts.items() if n}
    used: Counter[int] = Counter()
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        need = Counter({longest: 1})
        need.update(dict(fullest(rest, size - longest)))
        times = min(left[length] // n for length, n in need.items())
        offset = 0
        for length in sorted(need, reverse=True):
            runs.append(((length << 50) + used[length], need[length], sequences, offset))
            offset += length * need[length]
            used[length] += times * need[length]
            left[length] -= times * need[length]
            if not left[length]:
                del left[length]
        sequences += times
    runs.sort()
    columns = [np.array([r[i] for r in runs], np.int64) for i in range(4)]
    return Plan(*columns, sequences)


def _pieces(path: str, end_id: int, size: int, form: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(path)
        seen = np.zeros(size + 1, np.int64)  # pieces of each length in this task
        for batch in batches:
            texts, keys = as_strings(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in text_slices(texts):
                ids, ends = coder.encode(texts.slice(a, b - a))
                rows: list[tuple] = []
                tokens: list = []
                for k in range(b - a):
                    own = np.append(ids[ends[k] : ends[k + 1]], end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), size)):
                        some = own[start : start + size]
                        crc = 0 if form == "bytes" else zlib.crc32(some.tobytes())
                        rows.append((keys[a + k], piece, start, len(some), crc, part, int(seen[len(some)])))
                        seen[len(some)] += 1
                        if form:
                            tokens.append(some.tobytes() if form == "bytes" else some.astype(np.int32))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if form:
                    columns.append(pa.array(tokens, pa.binary() if form == "bytes" else pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SEQUENCE, with_ids: bool | str = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``with_ids``: the tokens as an array, or, by "bytes", as little-endian unsigned 32-bit
    numbers. Documents longer than ``size`` tokens (with the end id) are cut into pieces of
    that many; a null text is empty and has the end id alone. Repeated rows are packed as often
    as they occur, null doc_ids are kept, other columns are not read; no rows, no pieces.
    """
    form = "bytes" if with_ids == "bytes" else "array" if with_ids else ""
    kind = {"": "", "array": ", ids array<int>", "bytes": ", ids binary"}[form]
    found = stored(
        docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
            lean(_pieces(path, end_id, size, form), "encoder"), PIECES + kind
        ),
        "pieces",
    )
    # Pieces were numbered within their task and length; the tasks before add their counts.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(
        found.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))),
        "piece-counts",
    )
    lengths = cells.groupBy("length").agg(F.sum("n").alias("n")).collect()  # ``size`` rows at most
    plan = minimum_slack({r["length"]: r["n"] for r in lengths}, size)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = plan.place(length, rank)
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"]
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if form else [])]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*columns).schema)
    # With bytes the digest is that of the tokens as they lie in their sequence.
    digest = F.crc32("ids") if form == "bytes" else F.col("ids_crc32")
    return (
        found.join(cells.select("length", "part", "base"), ["length", "part"])
        .select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
        .mapInArrow(placed, f"{schema}, sequence_id long, offset long")
        .withColumn("ids_crc32", digest)
    )
