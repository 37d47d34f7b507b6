"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records over buckets that fit in memory, by a seeded hash. Pass two
shuffles every bucket (Spark's ``shuffle`` is a Fisher-Yates shuffle) and writes it. The
buckets one after the other are the shuffled order of all records; the shards are equal
cuts of it, so their row counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.llm.common import fresh, stored, text_or_empty

BUCKET_BYTES = 32 << 20
SOME_BUCKETS = 64  # small tables also use so many, of 256 rows or more
OVERHEAD = 16
ADDED = ("size", "shard", "slot")


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 5, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with size, shard and slot (place in the shard, from 0).

    A null text has no bytes. Rows that are equal in doc_id and text go to one bucket, in
    any order. Columns named like the new ones are replaced; no rows, no result rows.
    """
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ADDED]
    bucket, hashed, at, base, deal, place, n = fresh(docs, "bucket", "hash", "at", "base", "deal", "place", "n")
    # ``docs`` may have columns called like the new ones; they are replaced.
    sized = docs.select(*kept, (F.octet_length(text_or_empty()) + OVERHEAD).cast("long").alias("size"))
    total = sized.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    rows = total["rows"]
    buckets = max(-(-(total["bytes"] or 0) // bucket_bytes), min(SOME_BUCKETS, -(-rows // 256)), 1)
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), text_or_empty())
    scattered = sized.withColumn(hashed, key).withColumn(bucket, F.pmod(hashed, F.lit(buckets)))
    counts = stored(scattered.groupBy(bucket).agg(F.count("*").alias(n)), "bucket-counts")
    # One row per bucket: what lies before it, and its permutation. Written once, so a task
    # that runs again reads the same one.
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    deals = stored(
        counts.repartition(bucket)
        .sortWithinPartitions(bucket)
        .select(bucket, F.shuffle(F.sequence(F.lit(0), F.col(n).cast("int") - 1), F.lit(seed)).alias(deal))
        .join(bases, bucket),
        "bucket-deals",
    )
    inside = Window.partitionBy(bucket).orderBy(hashed, "doc_id", "text")
    return (
        scattered.repartition(buckets, bucket)  # a task has about one bucket in memory
        .withColumn(at, F.row_number().over(inside))
        .join(deals, bucket)
        .withColumn(place, F.col(base) + F.element_at(deal, F.col(at)))
        .withColumn("shard", F.expr(f"`{place}` * {shards} div {max(rows, 1)}").cast("int"))
        .withColumn("slot", F.expr(f"`{place}` - (shard * {rows}L + {shards - 1}) div {shards}"))
        .select(*kept, *ADDED)
    )


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """Write :func:`shuffled` rows, all columns, to ``folder/shard=.../``, in slot order within
    a file; no rows, no folders of shards."""
    out = shuffled(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder, compression="zstd")


def read_shards(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)
