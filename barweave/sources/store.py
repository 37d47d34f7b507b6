"""Stored datasets, run artifacts and the research log."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.functions import stats as st
from barweave.session import shared_folder

LOG_SCHEMA = (
    "run_id string, config_name string, config_hash string, ts timestamp, n_bars long, final_equity double, sharpe double"
)


def stable_key(payload: Mapping[str, object]) -> str:
    """16 hex digits of the SHA-256 of the arguments as sorted compact JSON."""
    text = json.dumps(payload, sort_keys=True, default=str, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def stable_key_column(df: DataFrame) -> DataFrame:
    """Add ``config_hash`` over all columns, keys sorted by name, for tables of run settings."""
    packed = F.to_json(F.struct(*sorted(df.columns)))
    return df.withColumn("config_hash", F.substring(F.sha2(packed, 256), 1, 16))


class DatasetStore:
    """Datasets keyed by namespace and arguments, computed at most once.

    The store lives in the folder the session names for shared data. Each write goes to a
    folder of its own and is published, once whole, by an empty marker folder; only published
    data are read, the newest first. A write that the format refuses is tolerated: the
    computed frame is returned all the same.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/datasets"

    def path_for(self, namespace: str, payload: Mapping[str, object]) -> str:
        return f"{self.root}/{namespace}-{stable_key(payload)}"

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def published(self, path: str) -> str | None:
        """The newest whole dataset below ``path``."""
        target, fs = self._files(path)
        if not fs.exists(target):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(target)]
        done = sorted(n.removeprefix("published-") for n in names if n.startswith("published-"))
        return f"{path}/data-{done[-1]}" if done else None

    def get_or_compute(
        self,
        namespace: str,
        payload: Mapping[str, object],
        compute: Callable[[], DataFrame],
        force: bool = False,
    ) -> DataFrame:
        path = self.path_for(namespace, payload)
        if not force and (found := self.published(path)):
            return self.spark.read.parquet(found)
        df = compute()
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{path}/data-{version}")
        except AnalysisException:
            return df
        marker, fs = self._files(f"{path}/published-{version}")
        fs.mkdirs(marker)
        return self.spark.read.parquet(f"{path}/data-{version}")


def write_run(run_folder: str, **tables: DataFrame) -> None:
    """Write named result tables of a run, partitioned by run; empty ones included."""
    for name, df in tables.items():
        df.write.mode("append").partitionBy("run_id").parquet(f"{run_folder}/{name}")


def log_run(spark: SparkSession, log_path: str, run_id: str, name: str, config: Mapping[str, object], equity: DataFrame) -> None:
    """Append one record for a run. The bar count and last value are aggregated, not collected."""
    record = equity.agg(
        F.count(F.lit(1)).alias("n_bars"), F.max_by("equity", "date").alias("final_equity")
    ).select(
        F.lit(run_id).alias("run_id"),
        F.lit(name).alias("config_name"),
        F.lit(stable_key(config)).alias("config_hash"),
        F.lit(datetime.now(UTC)).cast("timestamp").alias("ts"),
        "n_bars",
        "final_equity",
    )
    record.write.mode("append").json(log_path)


def log_trials(log_path: str, name: str, config: Mapping[str, object], returns: DataFrame) -> None:
    """Append one record for every series of (series_id, date, r), with its annual Sharpe ratio."""
    records = returns.groupBy("series_id").agg(F.count("r").alias("n_bars"), st.sharpe(F.col("r")).alias("sharpe"))
    records.select(
        F.col("series_id").alias("run_id"),
        F.lit(name).alias("config_name"),
        F.lit(stable_key(config)).alias("config_hash"),
        F.lit(datetime.now(UTC)).cast("timestamp").alias("ts"),
        "n_bars",
        "sharpe",
    ).write.mode("append").json(log_path)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(log_path)


def trial_count(spark: SparkSession, log_path: str) -> int:
    """Recorded runs, at least 1; an absent log counts as one trial."""
    try:
        return max(1, read_log(spark, log_path).count())
    except AnalysisException:
        return 1
