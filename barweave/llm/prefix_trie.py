"""Prefix tries of conversations from sorted sequences and their LCPs, without a stack.

A conversation is the sequence of its turns' 128-bit hashes. In sorted order the members of a
prefix are an interval, and the smallest of the longest common prefixes (LCPs) of neighbours
inside it is the prefix's length at least. Every candidate prefix finds its left and right
extents on its own, by binary search over a sparse table of range minima; counts, word sums
and leaves of the interval are then differences of running sums.

The sequences are range partitioned by (sequence, conv_id), so a group of copies spreads over
tasks, and cut into blocks of bounded size. A block's inner prefixes are whole. Those that
contain its first or last row may go on in the next block: they leave as partial rows (at
most the turns of two conversations per block), are corrected by the LCP across the border
and summed by a digest of the prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import lean, ragged, stored, text_or_empty
from barweave.llm.mixing import word_count

FAMILY = 20  # conversations of one multiple share their first turns
HEADS = 4  # 0 to HEADS - 1 of them
TURN = 16  # bytes of a turn's hash
BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 32 << 20
INNER, EDGE, FIRST, LAST = range(4)
PARTIAL = (
    "kind int, part long, block long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, ends_at long, path binary, words array<int>"
)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): each conversation with the first turns of its family's first one.

    Only hashes and word counts are shuffled. Turns of one number are taken in the order of
    their hashes. One conversation's hashes are held in one task.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", digest.alias("hash"), word_count("text").cast("int").alias("words")).alias("turn"),
    )
    own = (
        turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .repartition("base")  # serves the grouping and the window alike
        .groupBy("base", "conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("own"))
    )
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1)), ignorenulls=True)
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    taken = F.coalesce(F.slice(F.col("head"), F.lit(1), n), F.slice("own", 1, 0))
    rest = F.slice("own", n + 1, F.size("own"))
    return (
        own.withColumn("head", head.over(Window.partitionBy("base")))
        .withColumn("turns", F.concat(taken, rest))
        .select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["hash"])), "")).alias("path"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
        )
    )


class RangeMinimum:
    """A sparse table: level k holds the minimum of every run of 2**k entries."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of low .. high, both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            some = level == k
            row = self.levels[k]
            out[some] = np.minimum(row[low[some]], row[high[some] - (1 << int(k)) + 1])
        return out

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row of the run up to ``at`` whose neighbours share ``depth`` turns."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            to = at - (1 << k)
            ok = np.flatnonzero(to >= 0)
            ok = ok[self.levels[k][to[ok] + 1] >= depth[ok]]
            at[ok] = to[ok]
        return at

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row of that run from ``at`` on."""
        at, last = at.copy(), len(self.levels[0]) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            to = at + (1 << k)
            ok = np.flatnonzero(to <= last)
            ok = ok[self.levels[k][at[ok] + 1] >= depth[ok]]
            at[ok] = to[ok]
        return at


def lcps(turns: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the one before; -1 for the first."""
    most = np.minimum(lengths[1:], lengths[:-1])
    a, b = ragged(starts[1:], most), ragged(starts[:-1], most)
    differ = np.flatnonzero((turns[a] != turns[b]).any(axis=1))
    pair, first = np.unique(np.repeat(np.arange(len(most)), most)[differ], return_index=True)
    shared = most.copy()
    shared[pair] = (a - np.repeat(starts[1:], most))[differ[first]]
    return np.append(-1, shared).astype(np.int64)


def digests(path: bytes) -> list[bytes]:
    """One key per prefix of ``path``, the empty one included."""
    h, out = hashlib.md5(), []
    out.append(h.digest())
    for i in range(0, len(path), TURN):
        h.update(path[i : i + TURN])
        out.append(h.digest())
    return out


def _rows(n: int, part: int, block: int, **columns) -> pa.RecordBatch:
    fixed = {"part": np.full(n, part), "block": np.full(n, block)} | columns
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    arrays, names = [], []
    for name, kind in (field.split(" ") for field in PARTIAL.split(", ")):
        value = fixed.get(name)
        arrays.append(pa.nulls(n, types[kind]) if value is None else pa.array(value, types[kind]))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def border(part: int, block: int, before: bytes, path: bytes, words: list[int]) -> pa.RecordBatch:
    """What the blocks on both sides of a border, each taken alone, get wrong about the
    prefixes that cross it: a row per such prefix, to be added to theirs."""
    most = min(len(before), len(path)) // TURN
    shared = next((i for i in range(most) if before[i * TURN : (i + 1) * TURN] != path[i * TURN : (i + 1) * TURN]), most)
    depth = np.arange(shared + 1)
    total = np.append(0, np.cumsum(np.asarray(words[:shared], np.int64)))
    above = total[np.maximum(depth - 1, 0)]
    return _rows(
        shared + 1, part, block,
        kind=np.full(shared + 1, EDGE), key=digests(path[: shared * TURN]), depth=depth,
        n_convs=np.zeros(shared + 1, int),
        n_children=-(depth < shared).astype(int),  # begun before the border, counted after it again
        n_leaves=np.full(shared + 1, -int(shared * TURN == len(before))),  # the last row goes on
        saved_tokens=total[shared] - above,
    )


def block_nodes(part: int, block: int, conv: np.ndarray, paths: list[bytes], words: np.ndarray) -> pa.RecordBatch:
    """Every prefix of a sorted block: whole if it lies inside, else a partial row."""
    n = len(conv)
    lengths = np.fromiter(map(len, paths), np.int64, n) // TURN
    starts = np.cumsum(lengths) - lengths
    turns = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, TURN // 8)
    shared = lcps(turns, starts, lengths)
    table, smallest = RangeMinimum(shared), RangeMinimum(conv)
    summed = np.append(0, np.cumsum(words.astype(np.int64)))
    upto = lambda row, depth: summed[starts[row] + depth] - summed[starts[row]]

    fresh = lengths - shared  # prefixes whose first row this is
    first = np.cumsum(fresh) - fresh
    row, depth = np.repeat(np.arange(n), fresh), ragged(shared + 1, fresh)
    low, high = table.left(row, depth), table.right(row, depth)
    parent = np.arange(len(row)) - 1
    top = first[fresh > 0]  # the shortest of a row's own prefixes: its parent begins further left
    at = table.left(row[top], np.maximum(depth[top] - 1, 0))
    parent[top] = first[at] + depth[top] - 1 - shared[at] - 1
    parent[depth == 0] = -1
    children = np.bincount(parent[parent >= 0], minlength=len(row))
    leaf = np.cumsum(np.append(shared[1:], -1) < lengths)
    begin = np.cumsum(np.where(np.arange(n) > 0, upto(np.arange(n), np.maximum(shared, 0)), 0))
    members = high - low + 1
    saved = begin[high] - begin[low] - (members - 1) * upto(low, np.maximum(depth - 1, 0))
    least = smallest.over(low, high)

    edge = (low == 0) | (high == n - 1)
    keys: list[bytes | None] = [None] * len(row)
    head, tail = digests(paths[0]), digests(paths[-1])
    for i in np.flatnonzero(edge):
        keys[i] = head[depth[i]] if low[i] == 0 else tail[depth[i]]
    under = np.where(parent >= 0, edge[parent], False)
    parent_key = [keys[p] if u else None for p, u in zip(parent, under)]
    # Rows that are a prefix as a whole: a run of equal ones from its first row on.
    equal = (shared == lengths) & (np.append(-1, lengths[:-1]) == lengths)
    until = np.flatnonzero(np.append(~equal[1:], True))
    whole = np.flatnonzero(depth == lengths[row])
    stop = until[np.searchsorted(until, low[whole])]
    ends: list[str | None] = [NO_ENDS] * len(row)
    ends_at: list[int | None] = [None] * len(row)
    for i in np.flatnonzero(edge):
        ends[i] = None
    for i, a, b in zip(whole, low[whole], stop):
        ids = ",".join(map(str, conv[a : b + 1].tolist()))
        ends[i] = ids if edge[i] else hashlib.sha256(ids.encode()).hexdigest()
        ends_at[i] = int(conv[a])
    return _rows(
        len(row), part, block,
        kind=np.where(edge, EDGE, INNER), key=keys, parent_key=parent_key, depth=depth, conv_id=least,
        parent_conv_id=pa.array(least[parent], mask=(parent < 0) | under), n_convs=members, n_children=children,
        n_leaves=leaf[high] - np.where(low > 0, leaf[low - 1], 0), saved_tokens=saved, ends=ends, ends_at=ends_at,
    )


def _blocks(rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        block, last = part << 24, None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal block, last
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            paths = table.column("path").to_pylist()
            words = table.column("words").combine_chunks()
            flat, own = words.flatten().to_numpy(), words[0].as_py()
            if last is None:
                yield _rows(1, part, block, kind=[FIRST], path=[paths[0]], words=[own])
            else:
                yield border(part, block, last, paths[0], own)
            yield block_nodes(part, block, table.column("conv_id").to_numpy(), paths, flat)
            block, last = block + 1, paths[-1]

        n = n_bytes = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                wanted = min(rows - n, len(batch) - at)
                some = batch.slice(at, wanted)
                bounds = np.cumsum(pa.compute.binary_length(some.column("path")).to_numpy(zero_copy_only=False))
                some = some.slice(0, max(1, int(np.searchsorted(bounds, size - n_bytes, side="right"))))
                held.append(some)
                at, n, n_bytes = at + len(some), n + len(some), n_bytes + int(bounds[len(some) - 1])
                if n >= rows or n_bytes >= size or len(some) < wanted:
                    yield from done()
                    n = n_bytes = 0
        if held:
            yield from done()
        if last is not None:
            yield _rows(1, part, block, kind=[LAST], path=[last])

    return run


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield border(r["part"], r["block"], r["before"], r["path"], r["words"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces in order, one piece in memory at a time."""
    key, digest = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for now, piece in zip(batch.column("key"), batch.column("ends")):
            now = now.as_py()
            if now != key:
                if digest is not None:
                    yield out()
                key, digest = now, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py().encode())
    if digest is not None:
        yield out()


def prefix_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, null turns come first, rows without conv_id take no part;
    repeated rows are turns of their own; other columns are not read; an empty table has no
    nodes. Turns are told apart by 128 bits of their hash.
    """
    spark = conversations.sparkSession
    order = ["path", "conv_id"]
    sequences = stored(rebuilt(conversations), "rebuilt")
    found = stored(
        sequences.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_blocks(block_rows, block_bytes)), PARTIAL),
        "prefixes",
    )
    # A number per non-empty partition of the range shuffle.
    parts = sorted(r["part"] for r in found.where(F.col("kind") == FIRST).select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:])), "before_part long, part long")
    lasts = found.where(F.col("kind") == LAST).select(F.col("part").alias("before_part"), F.col("path").alias("before"))
    across = (
        found.where(F.col("kind") == FIRST)
        .select("part", "block", "path", "words")
        .join(after, "part")
        .join(lasts, "before_part")
        .mapInArrow(_borders, PARTIAL)
    )
    edges = found.where(F.col("kind") == EDGE)
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    pieces = (
        edges.where("ends IS NOT NULL")
        .select("key", "ends_at", "ends")
        .repartition("key")
        .sortWithinPartitions("key", "ends_at")
        .select("key", "ends")
        .mapInArrow(_hashed, "key binary, ends_sha256 string")
    )
    merged = stored(
        edges.unionByName(across)
        .groupBy("key", "depth")
        .agg(F.min("conv_id").alias("conv_id"), F.min("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in sums])
        .join(pieces, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))),
        "border-prefixes",
    )
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    inner = found.where(F.col("kind") == INNER).withColumnRenamed("ends", "ends_sha256")
    # Parents at the border of a block are looked up per block, so that the root, which most
    # short prefixes have as parent, is one key per block.
    local = edges.select("block", F.col("key").alias("parent_key")).distinct().join(names, "parent_key")
    return (
        inner.where("parent_key IS NULL")
        .select(NODE)
        .unionByName(inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(local, ["block", "parent_key"]).select(NODE))
        .unionByName(merged.join(names, "parent_key", "left").select(NODE))
    )
