"""Boosted regression trees on the logistic loss, fitted by counts over binned rows.

The rows of a fit do not change from tree to tree, only their margins do. They are binned once and
kept as blocks of small integers, 19 bytes a row with the margin, so that a
pass over them is a handful of array operations per block. A level of a tree is one pass: every block
counts rows and sums residuals by (node, feature, bin), and the sums, bounded by the tree and not by
the rows, give the splits. Candidate splits, residuals, gains and leaf values are those of Spark ML's
``GBTClassifier``, with candidates taken from all rows instead of a sample.

Residuals are rounded to a grid on which sums are exact, so that the fitted trees depend neither on
the partitioning nor on the order in which tasks end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.operators.cross_section import value_bucket

BINS = 32
TASK = 1 << 19  # rows of a partition, about
BLOCK = 1 << 15  # rows of a block at most, so that what an array operation reads stays in a core's cache
GRID = 2.0**31  # residuals are at most 4, so a block's sums stay under 2**53 and those of 10**9 rows in a long
REBUILD = 25  # trees after which margins are taken anew from the rows, so that lineage stays short

KEEP = StorageLevel.MEMORY_AND_DISK_DESER  # blocks are bytes to the JVM: nothing to serialise

Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # bins of two features a row, +-1, margins


@dataclass(frozen=True)
class Tree:
    """A full tree: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``; bins above ``bins[i]`` go right."""

    features: np.ndarray
    bins: np.ndarray
    values: np.ndarray
    weight: float


@dataclass(frozen=True)
class Model:
    columns: tuple[str, ...]
    splits: list[np.ndarray]
    trees: list[Tree]

    def p_up(self) -> Column:
        """The probability of target 1 as an expression over the feature columns."""

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                codes = _paired([x.to_numpy(dtype="float64") for x in batch], self.splits)
                yield pd.Series(1.0 / (1.0 + np.exp(-2.0 * _margins(codes, self.trees))))

        return score(*[F.col(c).cast("double") for c in self.columns])


def candidate_splits(train: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Per column at most ``BINS - 1`` thresholds that cut its rows into like parts.

    Values are counted in buckets of a 512th of an octave, whatever the rows; thresholds lie midway
    between the values on both sides of a bucket's border, at every border if there are few.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    counted = (
        train.select(F.inline(pairs))
        .groupBy("i", value_bucket(F.col("x")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .toPandas()
        .sort_values(["i", "bucket"])
    )
    return [_cuts(*(g[c].to_numpy() for c in ("n", "lo", "hi"))) for _, g in counted.groupby("i")]


def _cuts(n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    borders = (hi[:-1] + lo[1:]) / 2
    if len(borders) < BINS:
        return borders
    upto = np.cumsum(n)
    stride = target = upto[-1] / BINS
    out = []
    for k, border in enumerate(borders):
        if abs(upto[k] - target) < abs(upto[k + 1] - target):
            out.append(border)
            target += stride
    return np.array(out)


def _paired(columns: Sequence[np.ndarray], splits: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of every two columns as one integer."""
    out = np.zeros((-(-len(columns) // 2), len(columns[0])), "uint16")
    for i, x in enumerate(columns):
        out[i // 2] |= np.searchsorted(splits[i], x, "left").astype("uint16") << (5 * (i % 2))
    return out


def _nodes(codes: np.ndarray, features: Sequence[int], bins: Sequence[int], levels: int) -> np.ndarray:
    """The place of every row among the nodes of a level."""
    node = np.zeros(codes.shape[1], "uint8" if levels < 8 else "int64")
    for level in range(levels):
        right = np.zeros(codes.shape[1], bool)
        for k in range(1 << level):
            at = (1 << level) - 1 + k
            above = (codes[features[at] // 2] >> (5 * (features[at] % 2))) & (BINS - 1) > bins[at]
            right |= above & (node == k) if level else above
        node = 2 * node + right
    return node


def _margins(codes: np.ndarray, trees: Iterable[Tree], start: np.ndarray | None = None) -> np.ndarray:
    margin = np.zeros(codes.shape[1]) if start is None else start
    for t in trees:
        margin = margin + t.weight * t.values[_nodes(codes, t.features, t.bins, len(t.values).bit_length() - 1)]
    return margin


def _boosted(block: Block, trees: Sequence[Tree]) -> Block:
    codes, sign, margin = block
    return codes, sign, _margins(codes, trees, margin)


def _sums(block: Block, features: Sequence[int], bins: Sequence[int], level: int, first: bool) -> np.ndarray:
    """Rows and residuals (in units of the grid) by node of the level, feature and bin."""
    codes, sign, margin = block
    residual = sign * GRID if first else np.rint(4.0 * GRID * sign / (1.0 + np.exp(2.0 * sign * margin)))
    start = _nodes(codes, features, bins, level).astype("int64") * BINS**2
    shape = (1 << level, BINS, BINS)
    out = np.zeros((2, 1 << level, 2 * len(codes), BINS), "int64")
    for p, code in enumerate(codes):
        at = start + code
        for k, weights in enumerate((None, residual)):
            cells = np.bincount(at, weights, np.prod(shape)).reshape(shape)
            out[k, :, 2 * p], out[k, :, 2 * p + 1] = cells.sum(1), cells.sum(2)
    return out


def _blocks(train: DataFrame, columns: Sequence[str], target: str, splits: list[np.ndarray], keys: Sequence[str], rows: int) -> RDD:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(codes: list[np.ndarray], signs: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"codes": [np.hstack(codes).tobytes()], "sign": [np.hstack(signs).tobytes()]}, schema)

        schema = pa.schema([("codes", pa.binary()), ("sign", pa.binary())])
        codes, signs, n = [], [], 0
        for b in batches:
            if n + b.num_rows > BLOCK:
                yield joined(codes, signs)
                codes, signs, n = [], [], 0
            *x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            codes.append(_paired(x, splits))
            signs.append((2 * y - 1).astype("int8"))
            n += b.num_rows
        if n:
            yield joined(codes, signs)

    def decode(row: tuple[bytes, bytes]) -> Block:
        sign = np.frombuffer(row[1], "int8")
        return np.frombuffer(row[0], "uint16").reshape(-1, len(sign)), sign, np.zeros(len(sign))

    dealt = train.repartition(-(-rows // TASK), *keys)
    dealt = dealt.select(*[F.col(c).cast("double") for c in columns], F.col(target).cast("int"))
    return dealt.mapInArrow(encode, "codes binary, sign binary").rdd.map(decode)


def fit(
    train: DataFrame,
    columns: Sequence[str],
    target: str,
    keys: Sequence[str],
    n_trees: int,
    max_depth: int,
    learning_rate: float,
) -> Model:
    """``n_trees`` trees on all rows of ``train``, which is read twice; ``keys`` tell its rows apart."""
    splits = candidate_splits(train, columns)
    kept = _blocks(train, columns, target, splits, keys, train.count()).persist(KEEP)
    trees: list[Tree] = []
    state = kept
    for k in range(n_trees):
        past = state
        if k:
            source, news = (state, trees[-1:]) if k % REBUILD else (kept, trees[:])
            state = source.map(lambda b, news=news: _boosted(b, news)).persist(KEEP)
        trees.append(_grow(state, max_depth, learning_rate if k else 1.0, not k))
        if past not in (state, kept):
            past.unpersist()
    state.unpersist()
    kept.unpersist()
    return Model(tuple(columns), splits, trees)


def _grow(state: RDD, max_depth: int, weight: float, first: bool) -> Tree:
    """One tree, a pass per level. A node without a gain sends all its rows left."""
    features: list[int] = []
    bins: list[int] = []
    values = np.zeros(1)
    for level in range(max_depth):
        job = (features[:], bins[:], level, first)
        n, s = state.map(lambda b, job=job: _sums(b, *job)).reduce(np.add).astype("float64")
        s /= GRID
        if not level:
            values[0] = s[0, 0].sum() / n[0, 0].sum()
        left_n, left_s = n.cumsum(2), s.cumsum(2)
        right_n, right_s = left_n[:, :, -1:] - left_n, left_s[:, :, -1:] - left_s
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = left_s[:, :, -1:] ** 2 / left_n[:, :, -1:]
            gains = left_s**2 / left_n + right_s**2 / right_n - whole
            gains[~((left_n > 0) & (right_n > 0) & (gains > 1e-12 * whole))] = 0.0
        below = np.repeat(values, 2)
        for node, gain in enumerate(gains):
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            split = gain[f, b] > 0
            features.append(int(f))
            bins.append(int(b) if split else BINS)
            if split:
                at = node, f, b
                below[2 * node : 2 * node + 2] = left_s[at] / left_n[at], right_s[at] / right_n[at]
        values = below
    return Tree(np.array(features), np.array(bins), values, weight)
