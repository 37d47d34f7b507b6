"""Importance resampling of documents toward a target distribution.

Features are hashed n-grams. A bucket's gain is the log of how much more often the target has
it than the documents do; the gains are one array of fixed size, and a document's weight is
the mean of the array over its features. A Gumbel term keyed by the document's id makes the
highest scores a weighted draw without replacement.

The draw's cutoff is not found by sorting all scores. A quantile sketch gives a bracket
around it; the exact numbers of scores outside say whether the cutoff is in the bracket (it
is widened until it is), and only the bracket is sorted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import as_strings, lean, stored, text_or_empty, text_slices

BUCKETS = 10_000
LONGEST = 1  # words of the longest feature
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
SKETCH = 10_000  # accuracy of the quantile sketch: errors of one part in so many
FEATURES = "doc_id long, n_features long, n_words long, buckets binary"
#: Bytes of words: digits, letters after lower-casing, and everything beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts in order, as bytes, and each text's number of them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[low:high]]
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = offsets.astype(np.int64) - low
    heads = rows[:-1][rows[:-1] < len(data)]
    begins[heads] |= inside[heads]
    kept = data[inside]
    bounds = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    starts = np.flatnonzero(begins)
    return found, np.diff(np.searchsorted(starts, rows, side="left"))


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to ``longest`` words; words per text."""
    found, n = words(texts)
    owner = np.repeat(np.arange(len(texts)), n)
    out, owners = [], []
    for k in range(1, longest + 1):
        size = len(found) - k + 1
        if size <= 0:
            break
        same = owner[:size] == owner[k - 1 :]
        runs = found if k == 1 else pc.binary_join_element_wise(*[found.slice(i, size) for i in range(k)], b" ")
        coded = runs.filter(pa.array(same)).dictionary_encode()
        hashed = np.fromiter((zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        out.append(hashed[coded.indices.to_numpy()])
        owners.append(owner[:size][same])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), n
    return np.concatenate(out), np.concatenate(owners), n


def _hashed(longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column("text"))
            for a, b in text_slices(texts):
                bucket, owner, n = features(texts.slice(a, b - a), longest, buckets)
                bucket = bucket[np.argsort(owner, kind="stable")].astype(kind)
                ends = np.cumsum(np.bincount(owner, minlength=b - a))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_features": pa.array(np.diff(np.append(0, ends)), pa.int64()),
                        "n_words": pa.array(n, pa.int64()),
                        "buckets": pa.array([p.tobytes() for p in np.split(bucket, ends[:-1])], pa.binary()),
                    }
                )

    return run


def hashed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, n_words and the buckets of all features, per row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(lean(_hashed(longest, buckets)), FEATURES)


def _counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)  # one array per task is all that is shuffled
        for batch in batches:
            for x in batch.column("buckets"):
                n += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(n[some])})

    return run


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows: ``buckets`` numbers, whatever the table's size."""
    rows = found.select("buckets").mapInArrow(lean(_counted(buckets)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of smoothed shares, floored, per bucket."""
    above = (target + 1).astype(np.float64) * float(int(raw.sum()) + len(raw))
    below = (raw + 1).astype(np.float64) * float(int(target.sum()) + len(raw))
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _scored(gain: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = np.min_scalar_type(len(gain) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            total = np.fromiter((gain[np.frombuffer(x.as_buffer(), kind)].sum() for x in batch.column("buckets")), np.int64, len(batch))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = batch.column("doc_id").to_pylist()
            keys = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8] for i in ids)
            u = (np.fromiter((int(k, 16) for k in keys), np.float64, len(batch)) + 0.5) / 4294967296
            score = weight + np.floor(-1000 * np.log(-np.log(u))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_features"), batch.column("n_words"), pa.array(weight), pa.array(score)],
                names=["doc_id", "n_features", "n_words", "weight", "score"],
            )

    return run


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` by falling score, then the smaller id (null last), then ``row``, which tells
    repeated rows apart, numbered from 1 in column ``rank``: a range shuffle, and the counts of
    the partitions before (one row per partition)."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    laid = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked"
    ).withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = laid.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return laid.join(bases, "part").withColumn("rank", F.col("base") + F.col("nth") + 1).drop("at", "part", "nth", "base")


def bracket(scores: DataFrame, take: int, n: int, accuracy: int = SKETCH) -> tuple[int, int, int]:
    """(low, high, above): the ``take``-th highest of ``n`` scores is in low .. high, and
    ``above`` scores are higher than high. Sketched first, then counted, widened if wrong."""
    slack = 2.0 / accuracy
    while True:
        at = [max(0.0, 1 - take / n - slack), min(1.0, 1 - take / n + slack)]
        sketch = scores.agg(F.percentile_approx("score", at, accuracy).alias("q"), F.min("score").alias("min"), F.max("score").alias("max")).first()
        low = sketch["min"] if at[0] == 0 else sketch["q"][0]
        high = sketch["max"] if at[1] == 1 else sketch["q"][1]
        outside = scores.agg(
            F.sum((F.col("score") > high).cast("long")).alias("above"), F.sum((F.col("score") >= low).cast("long")).alias("reach")
        ).first()
        if outside["above"] < take <= outside["reach"]:
            return low, high, outside["above"]
        slack *= 8


def _key(row: tuple[Column, Column, Column]) -> Column:
    score, doc_id, at = row
    return F.struct(-score, doc_id.isNull(), F.coalesce(doc_id, F.lit(0).cast("long")), at)


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    accuracy: int = SKETCH,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; undrawn rows have no rank.

    Of the N rows with ``least_words`` or more words, ``percent`` of a hundred are drawn. A null
    text is empty (no features, weight 0), a null id is hashed as empty text and comes last
    among ties, repeated rows score alike and are drawn one by one; other columns are not
    read; an empty table gives no rows, an empty target makes every gain that of an unseen
    feature.
    """
    found = stored(hashed(docs, longest, buckets), "features")
    goal = hashed(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(goal, buckets))
    scored = stored(
        found.mapInArrow(lean(_scored(gain, seed)), "doc_id long, n_features long, n_words long, weight long, score long").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "scores",
    )
    eligible = scored.where(F.col("n_words") >= least_words)
    n = eligible.count()
    take = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not take:
        return scored.select(*columns, none)
    low, high, above = bracket(eligible.select("score"), take, n, accuracy)
    inside = eligible.where(F.col("score").between(low, high)).select("score", "doc_id", "row")
    last = placed(inside).where(F.col("rank") == take - above).first()
    cut = _key(tuple(F.lit(last[c]).cast("long") for c in ("score", "doc_id", "row")))
    drawn = (F.col("n_words") >= least_words) & (_key((F.col("score"), F.col("doc_id"), F.col("row"))) <= cut)
    ranked = placed(scored.where(drawn).select(*columns, "row"))
    return ranked.select(*columns, "rank").unionByName(scored.where(~drawn).select(*columns, none))
