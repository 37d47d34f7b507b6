"""Mixing sources to target weights, with DataFrame functions only.

A source's target is its weighted share of all words, at most ``cap`` times what it has;
the excess goes to the others by weight. A target is met by complete epochs of the source,
then by a weighted sample without replacement for the rest: every document draws the key
``-ln(u) / quality`` (Efraimidis and Spirakis), and the documents of smallest keys are taken
up to the prefix whose words come nearest to what is left.

No source is sorted as a whole. Words are summed in slices of the key; only the slice that
holds the end of the prefix is sorted. The end is one row per source, and each document
then decides for itself, so wide rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import one_space, stored, text_or_empty

WEIGHTS = (5, 2, 1)
CAP = 3
SLICES = 4096
LEAST_QUALITY = 0.05


def word_count(text: Column | str = "text") -> Column:
    flat = _flat(text)
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - _visible(flat) + 1).cast("long")


def _flat(text: Column | str) -> Column:
    return F.trim(one_space(text_or_empty(text)))


def _visible(flat: Column) -> Column:
    return F.length(F.translate(flat, " ", ""))


def quality(text: Column | str = "text") -> Column:
    """Share of letters among visible characters, ``LEAST_QUALITY`` at least."""
    letters = F.length(F.regexp_replace(text_or_empty(text), r"\P{L}+", ""))
    visible = _visible(_flat(text))
    return F.when(visible == 0, F.lit(LEAST_QUALITY)).otherwise(
        F.greatest(letters / visible, F.lit(LEAST_QUALITY))
    )


def sampling_key(weight: Column, seed: int) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from the document's id, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Sources are few (one row each), so they are put in order in one task. With sources by
    cap per weight, those before the first that can take its share are at their cap.
    """
    rank = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = (
        sizes.withColumn("rank", F.row_number().over(rank) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("level", level)
    )
    ratio = F.col("most") / F.col("weight")
    first = F.min(F.when(ratio >= F.col("level"), F.struct(ratio.alias("ratio"), "rank", "level"))).over(everything)
    return ranked.withColumn("level", F.coalesce(first["level"], F.lit(0.0))).select(
        "source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")).alias("target")
    )


def _rows(docs: DataFrame, keep: tuple[str, ...], seed: int, weight: Column | None) -> DataFrame:
    key = sampling_key(quality() if weight is None else weight, seed)
    return docs.select("doc_id", "source", *keep, word_count().alias("size"), key.alias("_key"))


def _slice() -> Column:
    return F.least(F.floor((1 - F.exp(-F.col("_key"))) * SLICES), F.lit(SLICES - 1)).cast("int")


def _plan(narrow: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row per source: target, epochs, and the slice, key and id at the end of its prefix."""
    slices = stored(
        narrow.groupBy("source", _slice().alias("slice")).agg(F.sum("size").alias("held")), "mix-slices"
    )
    goals = targets(slices.groupBy("source").agg(F.sum("held").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    goals = stored(
        goals.withColumn("epochs", epochs.cast("long")).withColumn(
            "rest", F.col("target") - F.col("epochs") * F.col("source_size")
        ),
        "mix-goals",
    )
    up_to = Window.partitionBy("source").orderBy("slice")
    running = slices.withColumn("before", F.sum("held").over(up_to) - F.col("held"))
    same = F.col("source").eqNullSafe(F.col("s"))
    last = (
        running.join(goals.select(F.col("source").alias("s"), "rest"), same)
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("held") > F.col("rest")))
        .select(F.col("source").alias("s"), F.col("slice").alias("at"), "before", "rest")
    )
    # Peers (rows of one key and id) come in together: the frame is by range.
    prefix = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("_key", "doc_id"))
    inside = narrow.withColumn("slice", _slice()).join(last, same & (F.col("slice") == F.col("at"))).withColumn("prefix", prefix)
    # The prefix that ends nearest to the rest, the shorter one of two.
    miss = F.struct(F.abs(F.col("prefix") - F.col("rest")).alias("miss"), "prefix", (-F.col("_key")).alias("k"), "doc_id")
    ends = inside.groupBy(F.col("source").alias("s")).agg(
        F.min(miss).alias("end"), F.first("before").alias("before"), F.first("rest").alias("rest"), F.first("at").alias("at")
    )
    nearer = F.col("end.miss") < F.abs(F.col("before") - F.col("rest"))
    ends = ends.select(
        "s",
        "at",
        F.when(nearer, -F.col("end.k")).alias("end_key"),
        F.when(nearer, F.col("end.doc_id")).alias("end_id"),
    )
    return stored(
        goals.join(ends, same, "left").select(
            F.col("source").alias("_source"), "source_size", "target", "epochs", "at", "end_key", "end_id"
        ),
        "mix-plan",
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: int = 11,
    weight: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes) per row.

    ``taken`` is a whole number of copies of the document. A null text has no words; a null
    source is a source of its own; documents without words are never taken. Rows repeated
    under one doc_id share their key and are selected together. ``keep`` names columns of
    ``docs`` to return as well; without them the texts are read once. An empty table gives no
    rows.
    """
    narrow = stored(_rows(docs, (), seed, weight), "mix-rows")
    plan = _plan(narrow, weights, cap)
    rows = _rows(docs, keep, seed, weight) if keep else narrow
    key, end = F.col("_key"), F.col("end_key")
    in_prefix = (key < end) | ((key == end) & (F.col("doc_id") <= F.col("end_id")))
    # Before the slice all are in; in it, those up to the end.
    extra = F.when(F.col("at").isNull(), F.lit(False)).otherwise(
        (_slice() < F.col("at")) | ((_slice() == F.col("at")) & F.coalesce(in_prefix, F.lit(False)))
    )
    taken = F.col("size") * (F.col("epochs") + extra.cast("long"))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", *keep, "size", "source_size", "target", taken.alias("taken")
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as it is taken."""
    copies = F.when(F.col("taken") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    # Other columns go by a name of their own meanwhile: they may be called like the new ones.
    own = {c: f"_column{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}
    keep = ("text", *own.values())
    return (
        mix(docs.withColumnsRenamed(own), keep=keep, **options)
        .where("taken > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        .select("doc_id", "source", *keep)
        .withColumnsRenamed({v: k for k, v in own.items()})
        .select(*docs.columns)
    )
