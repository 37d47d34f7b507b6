"""Token ids as fixed-width bits.

File format: a Parquet dataset of blocks. A block holds whole documents, in ascending
doc_id order, in about ``block_tokens`` tokens (a longer document makes a longer block):

* ``shard``, ``block``: number of the doc_id range and of the block in it
* ``first_token``: tokens of the shard before this block
* ``bits``: width of an id, the fewest bits that hold the largest id of the vocabulary
* ``doc_ids``, ``doc_starts``: the documents and where each begins in the block;
  ``doc_starts`` has one entry more, the number of tokens
* ``packed``: id ``i`` occupies bits ``i * bits`` to ``(i + 1) * bits`` of this
  little-endian bit string

Since the width is fixed, any range of ids is reached without reading what lies before it,
and unpacking is a handful of numpy operations on 64-bit words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.llm.common import as_strings, encoder, lean, text_or_empty, text_slices

BLOCKS = (
    "shard int, block int, first_token long, n_tokens long, bits int, "
    "doc_ids array<bigint>, doc_starts array<bigint>, packed binary"
)
BLOCK_TOKENS = 1 << 16


def width(largest: int) -> int:
    """Bits that hold ids 0 to ``largest``."""
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each (1 to 32), without gaps, as whole bytes."""
    n = len(ids)
    period = 64 // math.gcd(64, bits)  # so many ids fill whole 64-bit words
    words = period * bits // 64
    rows = np.zeros((-(-n // period), period), np.uint64)
    rows.reshape(-1)[:n] = ids
    out = np.zeros((len(rows), words), np.uint64)
    for i in range(period):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()[: -(-n * bits // 8)]


def unpack(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop``, reading only the bytes that hold them."""
    period = 64 // math.gcd(64, bits)
    words = period * bits // 64
    first, last = start // period, -(-stop // period)
    raw = packed[first * words * 8 : last * words * 8]
    raw = raw + bytes((last - first) * words * 8 - len(raw))
    rows = np.frombuffer(raw, "<u8").astype(np.uint64).reshape(-1, words)
    out = np.empty((len(rows), period), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for i in range(period):
        word, shift = divmod(i * bits, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = value & mask
    return out.reshape(-1)[start - first * period : stop - first * period].astype(np.uint32)


def _writer(path: str, end_id: int, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = encoder(path)
        bits = width(max(coder.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id))
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        block = first = waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, waiting
            starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            out = pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "first_token": pa.array([first], pa.int64()),
                    "n_tokens": pa.array([waiting], pa.int64()),
                    "bits": pa.array([bits], pa.int32()),
                    "doc_ids": pa.array([list(doc_ids)], pa.list_(pa.int64())),
                    "doc_starts": pa.array([starts], pa.list_(pa.int64())),
                    "packed": pa.array([pack(np.concatenate(held), bits)], pa.binary()),
                }
            )
            block, first, waiting = block + 1, first + waiting, 0
            held.clear(), doc_ids.clear(), sizes.clear()
            return out

        for batch in batches:
            texts, keys = as_strings(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in text_slices(texts):
                ids, ends = coder.encode(texts.slice(a, b - a))
                for k in range(b - a):
                    held.append(np.append(ids[ends[k] : ends[k + 1]], np.int32(end_id)))
                    doc_ids.append(keys[a + k])
                    sizes.append(len(held[-1]))
                    waiting += sizes[-1]
                    if waiting >= block_tokens:
                        yield flush()
        if waiting:
            yield flush()

    return run


def write_packed(docs: DataFrame, folder: str, path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write the blocks below ``folder``.

    A null text is empty, so it holds the end id alone. A null doc_id comes first; rows
    with one doc_id follow each other in the order of their texts. Other columns are not
    read. No rows, no blocks.
    """
    (
        docs.select("doc_id", text_or_empty().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(lean(_writer(path, end_id, block_tokens), "encoder"), BLOCKS)
        .write.parquet(folder, compression="zstd")
    )


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def _documents(with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts = row["doc_starts"]
                ids = unpack(row["packed"], row["bits"], 0, row["n_tokens"]).astype("<u4")
                parts = [ids[a:b] for a, b in zip(starts, starts[1:])]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "shard": pa.array([row["shard"]] * len(parts), pa.int32()),
                    "shard_start": pa.array([row["first_token"] + a for a in starts[:-1]], pa.int64()),
                    "n_tokens": pa.array([len(p) for p in parts], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``start`` counts the ids of all documents before it: the blocks know it within their
    shard, and what the shards before hold is a running sum over one row per shard.
    """
    blocks = read_blocks(spark, folder)
    schema = "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long"
    found = blocks.mapInArrow(_documents(with_ids), schema + (", ids array<bigint>" if with_ids else ""))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        blocks.groupBy("shard")
        .agg(F.sum("n_tokens").alias("held"))
        .select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    )
    return found.join(shards, "shard").select(
        "doc_id",
        (F.col("base") + F.col("shard_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )
