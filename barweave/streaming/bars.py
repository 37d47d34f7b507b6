"""Daily bars from a stream of ticks, with a watermark and restartable state.

The aggregate keeps one state row per (key, day) in the checkpoint. Every micro-batch writes
the bars that it changed under its own number, so a batch that is run again overwrites its
own rows and a restart adds nothing; a reader takes the latest batch of each bar. A tick
whose day ended before the watermark is late: its bar is final and no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAR = ["open", "high", "low", "close", "volume", "n_ticks"]


def read_ticks(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream of at most so many files a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def daily_bars(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """(key, date, open, high, low, close, volume, n_ticks) from (key, ts, seq, price, size).

    Ticks of one time follow each other by ``seq``. Ticks without time or price are left out.
    Map-side combining leaves one row per task, key and day, so a busy key is no hot spot.
    """
    order = F.struct("ts", "seq")
    return (
        ticks.where("ts IS NOT NULL AND price IS NOT NULL")
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("_day"), "key")
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .select("key", F.to_date("_day.start").alias("date"), *BAR)
    )


def write_bars(bars: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there now and stop; state and progress stay in ``checkpoint``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(
        availableNow=True
    ).start().awaitTermination()


def read_bars(spark: SparkSession, folder: str, key_type: str = "string") -> DataFrame:
    """Each bar as the last batch that changed it left it; no bars before the first batch."""
    schema = f"key {key_type}, date date, open double, high double, low double, close double, volume double, n_ticks long, batch long"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).drop("batch")
    every = spark.read.schema(schema).parquet(folder)
    last = every.groupBy("key", "date").agg(F.max_by(F.struct(*BAR), "batch").alias("_last"))
    return last.select("key", "date", *[F.col(f"_last.{c}").alias(c) for c in BAR])
