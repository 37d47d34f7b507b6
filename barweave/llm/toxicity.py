"""Toxicity by a logistic classifier with a counterfactual penalty.

A document is the set of its words and of their beginnings (three to six letters). Features
are screened on the labelled sample by how much more often they occur in one class; the
classifier is logistic with an L1 penalty, fitted by Newton steps to a stated gap. For every
labelled sentence that names a group, a counterfactual swaps the name for its counterpart,
and the squared change of score is penalised: naming a group must not move the score.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barweave.llm.common import as_strings, lean, split_chunks, text_or_empty, text_slices

FIT_ROWS = 20_000  # labelled documents used to fit, about; chosen by a hash of doc_id
FEATURES = 4096
LEAST_DOCS = 5
ROUNDS = 100  # not reached in practice: the fit ends at the gap below
WORKING = 128  # features that join the working set in a round
GAP = 1e-4  # of the objective to its lower bound, as a share of the objective of no features
L1 = 3e-4
FAIRNESS = 10.0
#: Counterparts, both ways.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("she", "he"), ("her", "his"), ("girl", "boy"), ("mother", "father"),
    ("black", "white"), ("african", "european"), ("asian", "european"), ("muslim", "christian"),
    ("jewish", "christian"), ("muslims", "christians"), ("jews", "christians"), ("gay", "straight"),
    ("lesbian", "straight"), ("transgender", "cisgender"), ("immigrant", "citizen"), ("immigrants", "citizens"),
    ("disabled", "healthy"), ("old", "young"), ("mujeres", "hombres"), ("mujer", "hombre"), ("femmes", "hommes"),
    ("femme", "homme"), ("frauen", "männer"), ("frau", "mann"), ("musulmanes", "cristianos"),
    ("musulmans", "chrétiens"), ("muslime", "christen"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def swaps(groups: tuple[tuple[str, str], ...] = GROUPS) -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in groups:
        out[a].append(b)
        out[b].append(a)
    return dict(out)


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings; a mark tells the two apart."""
    return [f"={word}", *(word[:n] for n in range(3, 7) if len(word) > n)]


class FeatureSets:
    """The distinct known features of texts, as (text, feature) pairs of numbers.

    With ``known`` only those features count, otherwise every feature gets a number. What
    distinct chunks hold is remembered for up to ``limit`` of them.
    """

    def __init__(self, known: dict[str, int] | None = None, limit: int = 300_000):
        self.number: dict[str, int] = {} if known is None else known
        self.open = known is None
        self.limit = limit
        self.cache: dict[str, tuple[int, ...]] = {}

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out = []
        for word in _WORD.findall(chunk.lower()):
            for f in word_features(word):
                n = self.number.setdefault(f, len(self.number)) if self.open else self.number.get(f)
                if n is not None:
                    out.append(n)
        return tuple(out)

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks, first = split_chunks(texts)
        if not len(chunks):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        coded = chunks.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if len(self.cache) > self.limit:
            self.cache.clear()
        held = []
        for w in words:
            found = self.cache.get(w)
            if found is None:
                found = self.cache[w] = self._chunk(w)
            held.append(found)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        flat = np.fromiter((n for h in held for n in h), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        some = sizes[codes] > 0
        seen = np.unique(text[some] * len(words) + codes[some])
        text, codes = seen // len(words), seen % len(words)
        n = sizes[codes]
        at = np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        width = max(1, len(self.number))
        both = np.unique(np.repeat(text, n) * width + flat[at])
        return both // width, both % width


def counterfactuals(text: str, pairs: dict[str, list[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """Features that a swapped sentence loses and gains, for each named group and counterpart."""
    for sentence in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(sentence))
        for name in sorted(words & pairs.keys()):
            before = {f for w in words for f in word_features(w)}
            for other in pairs[name]:
                after = {f for w in (words - {name}) | {other} for f in word_features(w)}
                yield before - after, after - before


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    gap: float = 0.0  # how far from the optimum the fit ended at most


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, toxic = as_strings(batch.column("text")), batch.column("toxic").to_numpy()
        for a, b in text_slices(texts):
            sets = FeatureSets()
            text, feature = sets.pairs(texts.slice(a, b - a))
            if not len(text):
                continue
            n = np.bincount(feature, minlength=len(sets.number))
            bad = np.bincount(feature, weights=toxic[a:b][text], minlength=len(sets.number)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(list(sets.number)), "n": pa.array(n), "bad": pa.array(bad)})


def _examples(known: dict[str, int], pairs: dict[str, list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = FeatureSets(known)
        for batch in batches:
            texts, toxic = as_strings(batch.column("text")), batch.column("toxic")
            for a, b in text_slices(texts):
                text, feature = sets.pairs(texts.slice(a, b - a))
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                has = [feature[x:y].astype(np.int32) for x, y in zip(cuts, cuts[1:])]
                moves: list[list[int]] = []
                for value in texts.slice(a, b - a).to_pylist():
                    seen: set[tuple[int, ...]] = set()
                    for lost, gained in counterfactuals(value, pairs):
                        move = sorted([known[f] + 1 for f in gained if f in known] + [-known[f] - 1 for f in lost if f in known])
                        if move:
                            seen.add(tuple(move))
                    # A document's distinct moves one after the other, each ended by 0.
                    moves.append([x for move in sorted(seen) for x in (*move, 0)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "toxic": toxic.slice(a, b - a),
                        "has": pa.array(has, pa.list_(pa.int32())),
                        "moves": pa.array(moves, pa.list_(pa.int32())),
                    }
                )

    return run


class Rows:
    """A sparse matrix of few columns, by rows."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int):
        self.n, self.width = len(columns), width
        self.row = np.repeat(np.arange(self.n), [len(c) for c in columns])
        self.column = np.concatenate([*columns, np.empty(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate([*values, np.empty(0)]).astype(np.float64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column] * self.value, minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=r[self.row] * self.value, minlength=self.width)

    def columns(self, some: np.ndarray) -> np.ndarray:
        """These columns as a dense matrix."""
        place = np.full(self.width, -1)
        place[some] = np.arange(len(some))
        at = place[self.column]
        out = np.zeros((self.n, len(some)))
        np.add.at(out, (self.row[at >= 0], at[at >= 0]), self.value[at >= 0])
        return out


def objective(x: Rows, y: np.ndarray, moves: Rows, l1: float, fairness: float, w: np.ndarray, b: float) -> float:
    """Mean log loss + fairness * mean squared move + L1."""
    z = x.times(w) + b
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    return loss + fairness * float(np.sum(moves.times(w) ** 2)) / max(1, moves.n) + l1 * float(np.abs(w).sum())


def gradient(x: Rows, y: np.ndarray, moves: Rows, fairness: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Of the smooth part of :func:`objective`."""
    off = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -40, 40))) - y
    return x.back(off) / len(y) + 2 * fairness * moves.back(moves.times(w)) / max(1, moves.n), float(off.mean())


def lower_bound(x: Rows, y: np.ndarray, moves: Rows, l1: float, fairness: float, w: np.ndarray, b: float) -> float:
    """Fenchel's bound: dual variables from the residuals, centred for the free bias and scaled
    until no feature's gradient exceeds ``l1``."""
    n, k = len(y), max(1, moves.n)
    p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -40, 40)))
    # The bias is free: the residuals must sum to zero. Scale down the heavier side.
    off = p - y
    up, down = off[off > 0].sum(), -off[off < 0].sum()
    if up > 0 and down > 0:
        off = np.where(off > 0, off * min(1.0, down / up), off * min(1.0, up / down))
    change = 2 * fairness * moves.times(w)
    steep = np.abs(x.back(off) / n + moves.back(change) / k).max(initial=0.0)
    scale = 1.0 if steep <= l1 else l1 / steep
    q = np.clip(y + scale * off, 1e-300, 1 - 1e-16)
    entropy = q * np.log(q) + (1 - q) * np.log1p(-q)
    quadratic = float(np.sum((scale * change) ** 2)) / (4 * fairness * k) if fairness else 0.0
    return -float(entropy.mean()) - quadratic


def newton_step(h: np.ndarray, g: np.ndarray, now: np.ndarray, l1: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """The least of ``g d + d h d / 2 + l1 |now + d|``, by coordinates; the change ``d``."""
    d, hd = np.zeros(len(g)), np.zeros(len(g))
    diagonal = h.diagonal()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(g)):
            slope = g[j] + hd[j]
            to = now[j] + d[j] - slope / diagonal[j]
            to = np.sign(to) * max(abs(to) - l1[j] / diagonal[j], 0.0)
            move = to - now[j] - d[j]
            if move:
                d[j] += move
                hd += h[j] * move
                most = max(most, abs(move))
        if most < 1e-6:
            break
    return d


def fit_weights(
    x: Rows, y: np.ndarray, moves: Rows, l1: float, fairness: float, rounds: int = ROUNDS, tolerance: float = GAP
) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the duality gap that is left, as a share of the objective at zero.

    Newton steps on a working set of features, to which each round adds those that violate
    the optimality conditions most; the gap over all features ends the fit.
    """
    n, k = len(y), max(1, moves.n)
    rate = min(max(float(y.mean()), 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    w, b = np.zeros(x.width), float(np.log(rate / (1 - rate)))
    now = start = objective(x, y, moves, l1, fairness, w, b)
    left = np.inf
    for _ in range(rounds):
        left = (now - lower_bound(x, y, moves, l1, fairness, w, b)) / start
        if left <= tolerance:
            break
        slope = gradient(x, y, moves, fairness, w, b)[0]
        fresh = np.flatnonzero((w == 0) & (np.abs(slope) > l1))
        fresh = fresh[np.argsort(-np.abs(slope[fresh]), kind="stable")[:WORKING]]
        some = np.sort(np.concatenate([np.flatnonzero(w), fresh]))
        dense = np.column_stack([x.columns(some), np.ones(n)])
        turned = moves.columns(some)
        pull = np.zeros((len(some) + 1, len(some) + 1))
        pull[:-1, :-1] = 2 * fairness * turned.T @ turned / k
        penalty = np.append(np.full(len(some), l1), 0.0)
        for _ in range(20):
            own = np.append(w[some], b)
            p = 1 / (1 + np.exp(-np.clip(dense @ own, -40, 40)))
            h = (dense * (p * (1 - p) / n)[:, None]).T @ dense + pull + 1e-9 * np.eye(len(own))
            d = newton_step(h, dense.T @ (p - y) / n + pull @ own, own, penalty)
            before, size = now, 1.0
            while size > 1e-6:
                w[some], b = own[:-1] + size * d[:-1], float(own[-1] + size * d[-1])
                now = objective(x, y, moves, l1, fairness, w, b)
                if now <= before:
                    break
                size /= 2
            if before - now < 1e-9 * start:
                break
    return w, b, float(left)


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 where the id is null."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5, F.lit(0))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    groups: tuple[tuple[str, str], ...] = GROUPS,
    fairness: float = FAIRNESS,
    l1: float = L1,
    rounds: int = ROUNDS,
    tolerance: float = GAP,
) -> Model:
    """A model from about ``fit_rows`` labelled documents outside fold 0, or all if fewer.

    Null labels are skipped; a document labelled both ways counts as toxic. Without any
    labelled document every score is one half.
    """
    marked = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 0)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    n = marked.count()
    if n == 0:
        return Model({}, 0.0)
    part = int(min(1.0, fit_rows / n) * 1_000_000) + 1
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < part)
    # At most about fit_rows narrow rows: small enough for every task.
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not totals["n"]:
        return Model({}, 0.0)
    good, bad = totals["n"] - totals["bad"], totals["bad"]
    if not good or not bad:
        return Model({}, 20.0 if bad else -20.0)
    p = F.col("n") / totals["n"]
    gap = F.col("bad") / bad - (F.col("n") - F.col("bad")) / good
    screened = (
        sample.mapInArrow(lean(_statistics), "feature string, n long, bad long")
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .where(F.col("n") >= LEAST_DOCS)
        .orderBy(F.desc(gap * gap / F.greatest(p * (1 - p), F.lit(1e-9))), "feature")
        .limit(FEATURES).select("feature").collect()
    )
    pairs = swaps(groups)
    names = sorted({r["feature"] for r in screened} | {f"={name}" for name in pairs})
    known = {f: i for i, f in enumerate(names)}
    rows = sample.mapInArrow(lean(_examples(known, pairs)), "toxic int, has array<int>, moves array<int>").toArrow()
    has = [np.asarray(v, np.int64) for v in rows.column("has").to_pylist()]
    x = Rows(has, [np.ones(len(v)) for v in has], len(known))
    columns, signs = [], []
    for moves in rows.column("moves").to_pylist():
        one: list[int] = []
        for m in moves:
            if m:
                one.append(m)
            else:
                columns.append(np.abs(np.array(one)) - 1)
                signs.append(np.sign(np.array(one)).astype(np.float64))
                one = []
    y = rows.column("toxic").to_numpy().astype(np.float64)
    w, b, left = fit_weights(x, y, Rows(columns, signs, len(known)), l1, fairness, rounds, tolerance)
    return Model({f: float(w[i]) for f, i in known.items() if w[i]}, b, left)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of each text, between 0 and 1; no shuffle.

    A null text is empty: its score is that of the bias. Repeated rows score alike, null ids are
    kept; a column of that name is replaced; an empty table gives no rows.
    """
    names = list(model.weights)
    weights = np.array([model.weights[f] for f in names] or [0.0])
    known = {f: i for i, f in enumerate(names)}
    kept = docs.select(*[c for c in docs.columns if c != column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = FeatureSets(known)
        for batch in filter(len, batches):
            texts = as_strings(batch.column("text")).fill_null("")
            found = np.empty(len(texts))
            for a, b in text_slices(texts):
                text, feature = sets.pairs(texts.slice(a, b - a))
                found[a:b] = np.bincount(text, weights=weights[feature], minlength=b - a) + model.bias
            scores = 1 / (1 + np.exp(-np.clip(found, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])

    schema = StructType([*kept.schema, StructField(column, DoubleType())])
    return kept.mapInArrow(lean(run), schema)
