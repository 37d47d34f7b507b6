"""Exact duplicates by Patricia tries.

Keys are length, content hash and the whole text in bytes, so equal texts meet at one
terminal node, which keeps the smallest id and the number of rows. Every task first joins
its own rows in a trie, so a text with many copies leaves it as one row per task. The rows
are then dealt out and sorted by length and hash: each (length, hash) pair is a subtree that
is complete once the next pair begins, and complete subtrees are spilled, written out and
forgotten, when the trie outgrows its budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import fresh, id_key, lean, one_space, stored, text_or_empty, text_slices

OWNERS = "n_bytes long, text_hash long, norm binary, text_sha256 string, keep_id long, group_size long"
BUDGET = 48 << 20
PLACES = 10_000  # a group with more than one in so many rows is dealt over several tasks


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner: list | None = None  # [smallest id, rows, sha]


def common(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``label`` the key has from ``at`` on, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Patricia:
    """A compressed radix trie over byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.held = 0

    def add(self, key: bytes, doc_id: int | None, rows: int, sha: str) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(key) - at + 200
            elif not key.startswith(child.label, at):
                n = common(child.label, key, at)
                middle = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                child = node.children[key[at]] = middle
                self.held += 200
            node, at = child, at + len(child.label)
        if node.owner is None:
            node.owner = [doc_id, rows, sha]
            return
        if doc_id is not None and (node.owner[0] is None or doc_id < node.owner[0]):
            node.owner[0] = doc_id
        node.owner[1] += rows

    def owners(self) -> Iterator[tuple[bytes, list]]:
        stack = [(self.root, b"")]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.owner is not None:
                yield path, node.owner
            stack.extend((child, path) for child in node.children.values())

    def spill(self, keep: bytes | None) -> list[tuple[bytes, list]]:
        """Take out all but the subtree of keys that begin with ``keep``."""
        out, stay = [], []
        for key, owner in self.owners():
            (stay if keep is not None and key.startswith(keep) else out).append((key, owner))
        self.root, self.held = Node(b""), 0
        for key, owner in stay:
            self.add(key, *owner)
        return out


def trie_key(n_bytes: int, text_hash: int) -> bytes:
    return n_bytes.to_bytes(8, "big") + (text_hash & (1 << 64) - 1).to_bytes(8, "big")


def _batches(taken: list[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(taken), 512):
        some = taken[i : i + 512]
        yield pa.RecordBatch.from_pydict(
            {
                "n_bytes": pa.array([int.from_bytes(k[:8], "big") for k, _ in some], pa.int64()),
                "text_hash": pa.array([int.from_bytes(k[8:16], "big", signed=True) for k, _ in some], pa.int64()),
                "norm": pa.array([k[16:] for k, _ in some], pa.binary()),
                "text_sha256": pa.array([o[2] for _, o in some], pa.string()),
                "keep_id": pa.array([o[0] for _, o in some], pa.int64()),
                "group_size": pa.array([o[1] for _, o in some], pa.int64()),
            }
        )


def _merge(budget: int, in_order: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In key order complete subtrees leave the trie for good; otherwise what leaves early
    is one more partial row of its text, to be joined after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, prefix = Patricia(), None
        for batch in batches:
            for a, b in text_slices(batch.column("norm")):
                for n, h, text, sha, doc_id, rows in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns)):
                    now = trie_key(n, h)
                    if trie.held > budget and now != prefix:
                        yield from _batches(trie.spill(now if in_order else None))
                    prefix = now
                    trie.add(now + text, doc_id, rows, sha)
        yield from _batches(trie.spill(None))

    return run


def normalised(text: Column | str = "text") -> Column:
    return one_space(text_or_empty(text))


def owners(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size."""
    norm = F.encode(normalised(), "UTF-8")
    rows = docs.select(norm.alias("norm"), F.col("doc_id").cast("long").alias("keep_id")).select(
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("text_hash"),
        "norm",
        F.sha2("norm", 256).alias("text_sha256"),
        "keep_id",
        F.lit(1).cast("long").alias("group_size"),
    )
    return (
        rows.mapInArrow(lean(_merge(budget, False)), OWNERS)
        .repartition("n_bytes", "text_hash")
        .sortWithinPartitions("n_bytes", "text_hash")
        .mapInArrow(lean(_merge(budget, True)), OWNERS)
        .select("text_sha256", "keep_id", "group_size")
    )


def met(rows: DataFrame, groups: DataFrame, total: int, key: str = "text_sha256", size: str = "group_size") -> DataFrame:
    """``rows`` joined with ``groups`` on ``key``, large groups dealt over many places.

    A group with more than one in PLACES of all rows gets a place for each such part, its own
    row goes to all of them. There are fewer than PLACES such groups, so their list is
    broadcast whatever the table's size; ``row`` deals the rows out.
    """
    places = (F.col(size) * PLACES / max(total, 1)).cast("int")
    large = groups.where(places > 0).select(key, places.alias("places"))
    salted = rows.join(F.broadcast(large), key, "left").withColumn(
        "place", F.pmod(F.xxhash64("row"), F.coalesce("places", F.lit(0)) + 1).cast("int")
    )
    spread = groups.withColumn("place", F.explode(F.sequence(F.lit(0), places)))
    return salted.drop("places").join(spread, [key, "place"]).drop("place")


def exact_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    A null text is empty. Of equal texts the smallest doc_id stays, null ids last; of rows
    that repeat that id, one. Other columns are not read; no rows, no result rows.
    """
    # Rows are numbered once, in a table, so that one of several equal rows can be named.
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "text-rows",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    one = rows.groupBy("text_sha256").agg(first.alias("one")).select("text_sha256", F.col("one.row").alias("keep_row"))
    groups = stored(owners(docs, budget).join(one, "text_sha256"), "text-owners")
    return met(rows, groups, rows.count()).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    As in :func:`exact_duplicates`: a null text is empty, the smallest doc_id stays, null last,
    and one of the rows that repeat it.
    """
    sha, key, row = fresh(docs, "sha", "key", "row")
    keyed = docs.withColumns({sha: F.sha2(F.encode(normalised(), "UTF-8"), 256), key: id_key("doc_id")})
    stays = owners(docs, budget).select(F.col("text_sha256").alias(sha), id_key("keep_id").alias(key))
    one = Window.partitionBy(sha, key).orderBy(sha)
    return (
        keyed.join(stays, [sha, key], "left_semi")
        .withColumn(row, F.row_number().over(one))
        .where(F.col(row) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
