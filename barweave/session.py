"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "barweave", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the settings the library relies on.

    ``shuffle_partitions`` is left to the cluster unless given: adaptive execution
    coalesces small partitions and splits skewed join partitions at run time.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context.

    Python workers import it by name. Where it is not installed on every machine, the
    driver's copy goes along, as ``spark-submit --py-files`` would send it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_barweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-barweave-")) / "barweave-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._barweave_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the session itself is local.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-barweave-")
    sc.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/barweave-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


BYTES_PER_TASK = 2 << 20  # of Parquet input behind a frame: some 100,000 to 250,000 bars


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as its input files hold ``BYTES_PER_TASK``.

    Adaptive execution merges shuffled partitions up to 64 MB of compressed rows, so that a task's
    sorts grow with the input until there. A number of tasks that follows the input keeps a task's
    rows the same; it is taken from the files' sizes, without a job. Frames that do not come from
    files are left as they are.
    """
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    size = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return df.repartition(-(-size // BYTES_PER_TASK), *keys) if size else df


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where one expensive frame feeds several branches of a plan, so that the branches
    neither recompute it nor depend on executors that may be lost, and read only the columns
    they use. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/barweave-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
