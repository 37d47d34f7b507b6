"""The long (date, ticker) price panel: scan, derive, normalise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions.columns import nan_to_null
from barweave.session import deal

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
PANEL_COLUMNS = tuple(PANEL_SCHEMA.fieldNames())

# Vendor field names and the panel columns they become.
VENDOR_FIELDS = {
    "Date": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
}


def scan_panel(
    spark: SparkSession,
    path: str,
    tickers: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read a stored panel; ticker and date predicates reach the file scan.

    ``end`` is exclusive, as it is for a vendor download. Duplicate (date, ticker)
    rows are removed because a ticker list may repeat the benchmark.
    """
    reader = spark.read.schema(PANEL_SCHEMA)
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    return nan_to_null(select_panel(df, tickers, start, end)).dropDuplicates(["date", "ticker"])


def select_panel(
    df: DataFrame,
    tickers: Sequence[str] | DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Restrict a panel to tickers and to ``start <= date < end``, without the excluded names.

    ``tickers`` may be a list, which reaches the file scan, or a frame with a ticker column,
    which becomes a semi join.
    """
    if isinstance(tickers, DataFrame):
        df = df.join(tickers.select("ticker"), "ticker", "left_semi")
    elif tickers is not None:
        df = df.where(F.col("ticker").isin(*tickers))
    if exclude:
        df = df.where(~F.col("ticker").isin(*exclude))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") < F.lit(end).cast("date"))
    return df


#: Folders of a laid-out panel: tickers dealt by hash, so that no folder follows one busy
#: name, and years.
LAYOUT = ("bucket", "year")


def write_panel(panel: DataFrame, path: str, buckets: int = 64) -> None:
    """Store a panel for reading by ticker and date.

    One file per bucket and year, sorted by ticker and date so that row groups have narrow
    ranges of both, with a Bloom filter on ticker for names between.
    """
    laid = panel.withColumns({"bucket": _bucket(F.col("ticker"), buckets), "year": F.year("date")})
    (
        laid.repartition(*LAYOUT)
        .sortWithinPartitions(*LAYOUT, "ticker", "date")
        .write.partitionBy(*LAYOUT)
        .option("parquet.bloom.filter.enabled#ticker", "true")
        .parquet(path)
    )


def _bucket(ticker: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(buckets)).cast("int")


def scan_laid_out(
    spark: SparkSession,
    path: str,
    tickers: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Read back what :func:`write_panel` stored: only the folders that can hold the tickers and
    ``start <= date < end`` are listed for reading. ``buckets`` is what the panel was written with."""
    folders = T.StructType([*PANEL_SCHEMA.fields, T.StructField("bucket", T.IntegerType()), T.StructField("year", T.IntegerType())])
    df = spark.read.schema(folders).parquet(path)
    if tickers is not None:
        # Constant folding turns the hashes of the names into literals.
        df = df.where(F.col("bucket").isin(*[_bucket(F.lit(t), buckets) for t in dict.fromkeys(tickers)]) if tickers else F.lit(False))
    if start is not None:
        df = df.where(F.col("year") >= F.year(F.lit(start).cast("date")))
    if end is not None:
        df = df.where(F.col("year") <= F.year(F.lit(end).cast("date")))
    return select_panel(df, tickers, start, end).select(*PANEL_COLUMNS)


def normalise_vendor(df: DataFrame, ticker: str | Column) -> DataFrame:
    """Rename a vendor frame's fields, drop unknown ones, add the ticker.

    A column as ``ticker`` takes a table of many names at once.
    """
    known = [(src, dst) for src, dst in VENDOR_FIELDS.items() if src in df.columns]
    cols = [
        F.to_date(F.col(f"`{src}`")).alias(dst) if dst == "date" else F.col(f"`{src}`").cast("double").alias(dst)
        for src, dst in known
    ]
    out = nan_to_null(df.select(*cols, (F.lit(ticker) if isinstance(ticker, str) else ticker).alias("ticker")))
    return out.select("date", "ticker", *[dst for _, dst in known if dst != "date"])


def bars_from_trades(trades: DataFrame, *keys: str) -> DataFrame:
    """Daily bars per key from trade rows ``(…keys, date, seq…, amount, quantity)``.

    Grouping by (key, date) combines on the map side, so a key holding a third of all
    trades reaches the shuffle as at most one row per map task and date. The adjusted
    close is the volume-weighted price taken from integer cents: the sum is exact in
    any order, so a recomputed partition gives the same bits.

    Trades of a day follow each other by (seq1, seq2). Where these identify a trade they are
    one long, as a fixed-width order keeps the aggregation by hash, without a sort; ``seq1`` from
    2**42 or ``seq2`` from 2**20 on is then an error. Where trades may share both, ``seq3``, amount
    and quantity decide after them, at the price of a sort for open and close.
    """
    p = F.col("amount") / F.col("quantity")
    if "seq3" in trades.columns:
        seq = F.struct("seq1", "seq2", "seq3", "amount", "quantity")
    else:
        fits = F.col("seq1").between(0, (1 << 42) - 1) & F.col("seq2").between(0, (1 << 20) - 1)
        order = F.shiftleft(F.col("seq1").cast("long"), 20).bitwiseOR(F.col("seq2").cast("long"))
        seq = F.when(fits, order).otherwise(F.raise_error(F.lit("trade numbers out of range")).cast("long"))
    cents = F.round(F.col("amount") * 100).cast("long")
    return trades.groupBy(*keys, "date").agg(
        F.min_by(p, seq).alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        F.max_by(p, seq).alias("close"),
        (F.sum(cents).cast("double") / F.lit(100.0) / F.sum("quantity")).alias("adj_close"),
        F.sum("quantity").alias("volume"),
    )


def _trades(lineitem: DataFrame, *extra: str) -> DataFrame:
    return lineitem.where(F.col("l_quantity") > 0).select(
        *extra,
        F.to_date("l_shipdate").alias("date"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_linenumber").alias("seq2"),
        F.col("l_partkey").alias("seq3"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
    )


def _supplier_ticker() -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One ticker per supplier; the number of names grows with the data."""
    trades = _trades(read_table(spark, folder, "lineitem"), "l_suppkey")
    bars = bars_from_trades(trades, "l_suppkey")
    return bars.select("date", _supplier_ticker().alias("ticker"), *PANEL_COLUMNS[2:])


def supplier_series(spark: SparkSession, folder: str) -> DataFrame:
    """The same bars dealt by ticker, for windows over each name's history."""
    return deal(supplier_panel(spark, folder), "ticker")


def supplier_sectors(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, sector) with the supplier's region as its sector."""
    s = read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")
    )
    n = read_table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    r = read_table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    return (
        s.join(n, "n_nationkey")
        .join(r, "r_regionkey")
        .select("l_suppkey", _supplier_ticker().alias("ticker"), "sector")
    )


def sleeve_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One ticker per (region, line status): few names, dense calendars, one sector each."""
    trades = _trades(read_table(spark, folder, "lineitem"), "l_suppkey", "l_linestatus")
    sectors = supplier_sectors(spark, folder).select("l_suppkey", "sector")
    bars = bars_from_trades(trades.join(sectors, "l_suppkey"), "sector", "l_linestatus")
    return bars.select(
        "date",
        F.concat_ws(":", "sector", "l_linestatus").alias("ticker"),
        *PANEL_COLUMNS[2:],
        "sector",
    )


def market_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The whole market as one ticker, used as benchmark."""
    trades = _trades(read_table(spark, folder, "lineitem"))
    bars = bars_from_trades(trades)
    return bars.select("date", F.lit("MKT").alias("ticker"), *PANEL_COLUMNS[2:])
