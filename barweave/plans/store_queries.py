"""Registered queries: stored datasets, run records and run hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators import audit_states
from barweave.operators import features as ft
from barweave.operators.audit import VALUE_COLUMNS
from barweave.plans.common import BARS, SECTORS, W, r, rounded
from barweave.plans.feature_queries import ASOF_DATES, REGIONS, membership
from barweave.plans.portfolio_queries import _EQUITY, _LEDGER, CAPITAL, MODEL, _fills, _tradable
from barweave.plans.research_queries import CAPS, CONSTRAINED
from barweave.operators import execution
from barweave.session import materialise, scratch_path, shared_folder
from barweave.sources import membership as members
from barweave.sources import reference_data, store
from barweave.sources.panel import VENDOR_FIELDS, normalise_vendor, supplier_panel, supplier_sectors, supplier_series


def stored_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel written to the dataset store, then asked for again and read from it."""
    datasets, payload = store.DatasetStore(spark), {"folder": d, "kind": "supplier"}
    datasets.get_or_compute("panel", payload, lambda: supplier_panel(spark, d), force=True)

    def missed() -> DataFrame:
        raise LookupError("the stored panel was not found")

    return datasets.get_or_compute("panel", payload, missed)


def run_record(spark: SparkSession, d: str) -> DataFrame:
    """One run's equity written as an artifact, logged, and the log read back."""
    home = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
    panel = _tradable(spark, d)
    equity = materialise(execution.mark_to_market(materialise(_fills(panel)), panel, CAPITAL, MODEL))
    store.write_run(home, equity=equity)
    config = {"name": "tsmom", "max_weight": CAPS.max_weight, "regions": list(REGIONS)}
    store.log_run(spark, f"{home}/log", "run-1", "tsmom", config, spark.read.parquet(f"{home}/equity"))
    log = store.read_log(spark, f"{home}/log").select("run_id", "config_name", "n_bars", "final_equity")
    return rounded(log, 1)


def run_hash(spark: SparkSession, d: str) -> DataFrame:
    """A settings row per name (its bars and first date) with the row's hash."""
    spans = supplier_panel(spark, d).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("date").cast("string").alias("start")
    )
    return store.stable_key_column(spans)


FIRST_YEARS = 1998  # the audit's first batches end before this year
# Spreads of region averages stand for the published factors; each is (long, short).
SPREADS = {
    "SMB": ("AMERICA", "ASIA"),
    "HML": ("EUROPE", "AFRICA"),
    "RMW": ("EUROPE", "ASIA"),
    "CMA": ("AFRICA", "AMERICA"),
}
MOMENTUM = "MIDDLE EAST"
PLAIN = {"Mkt-RF": "mkt", "RF": "rf"}


def _factor_files(spark: SparkSession, d: str) -> tuple[str, str]:
    """Percent factors and momentum as CSV files, laid out as they are published.

    Unit prices jump by orders of magnitude, so log returns are taken as the percent figures.
    """
    prices = supplier_series(spark, d).select("date", "ticker", "adj_close")
    returns = prices.withColumn("r", ft.log_ret()).where("r IS NOT NULL").join(supplier_sectors(spark, d), "ticker")
    mean = lambda region: F.avg(F.when(F.col("sector") == region, F.col("r")))
    table = materialise(
        returns.groupBy("date").agg(
            F.avg("r").alias("Mkt-RF"),
            *[(mean(a) - mean(b)).alias(name) for name, (a, b) in SPREADS.items()],
            F.lit(0.01).alias("RF"),
            mean(MOMENTUM).alias("MOM"),
        )
    )
    five, mom = scratch_path(spark, "factors"), scratch_path(spark, "momentum")
    table.select("date", *[f"`{c}`" for c in reference_data.MODELS["FF5"]]).write.csv(five, header=True)
    table.where("MOM IS NOT NULL").select("date", "MOM").write.csv(mom, header=True)
    return five, mom


def _plain(df: DataFrame) -> DataFrame:
    return rounded(df.withColumnsRenamed({c: PLAIN.get(c, c.lower()) for c in df.columns}))


def factors_ff5_mom(spark: SparkSession, d: str) -> DataFrame:
    """Five factors with momentum, read from percent files."""
    five, mom = _factor_files(spark, d)
    return _plain(reference_data.scan_factors(spark, five, "FF5+MOM", mom))


def factors_monthly(spark: SparkSession, d: str) -> DataFrame:
    """The same factors compounded by month, written as monthly percent files and read from them."""
    five, mom = _factor_files(spark, d)
    monthly = materialise(reference_data.compound_monthly(reference_data.scan_factors(spark, five, "FF5+MOM", mom)))
    percent = monthly.select(
        F.date_format("date", "yyyyMM").alias("date"), *[(F.col(f"`{c}`") * 100).alias(c) for c in monthly.columns if c != "date"]
    )
    home = scratch_path(spark, "monthly")
    percent.drop("MOM").write.csv(f"{home}/five", header=True)
    percent.select("date", "MOM").write.csv(f"{home}/mom", header=True)
    return _plain(reference_data.scan_factors(spark, f"{home}/five", "FF5+MOM", f"{home}/mom", "monthly"))


def vendor_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel out of CSV files with a vendor's headers and a field that the panel does not have."""
    path = scratch_path(spark, "vendor")
    fields = [F.col(ours).alias(theirs) for theirs, ours in VENDOR_FIELDS.items()]
    panel = supplier_panel(spark, d)
    panel.select(F.col("ticker").alias("Symbol"), *fields, F.lit(0.0).alias("Dividends")).write.csv(path, header=True)
    return normalise_vendor(spark.read.csv(path, header=True), F.col("Symbol")).select(*panel.columns)


def members_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """Members at each date, from a membership CSV in which a name still listed has no end."""
    path = scratch_path(spark, "membership")
    membership(spark, d).select("ticker", "start_date", "end_date").write.csv(path, header=True)
    return members.members_on(members.scan_membership(spark, path), ASOF_DATES)


def audit_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The panel's audit from stored yearly states, written in two runs."""
    path, panel = scratch_path(spark, "audit"), materialise(supplier_panel(spark, d))
    year = F.year("date")
    audit_states.write_states(panel.where(year < FIRST_YEARS), path, year)
    audit_states.write_states(panel.where(year >= FIRST_YEARS), path, year)
    return rounded(audit_states.read_audit(spark, path), 4)


QUERIES = {
    "stored_panel": stored_panel,
    "run_record": run_record,
    "run_hash": run_hash,
    "factors_ff5_mom": factors_ff5_mom,
    "factors_monthly": factors_monthly,
    "vendor_panel": vendor_panel,
    "members_from_csv": members_from_csv,
    "audit_incremental": audit_incremental,
}

_MEAN = "avg(r) FILTER (sector = '{}')"
_FACTOR_SQL = f"""{BARS}, {SECTORS}, fl AS (SELECT date, ticker, ln(adj_close / lag(adj_close) OVER ({W})) / 100 AS r FROM bars),
  fm AS (SELECT date, avg(r) AS mkt,
    {', '.join(f"{_MEAN.format(a)} - {_MEAN.format(b)} AS {name.lower()}" for name, (a, b) in SPREADS.items())},
    0.0001::DOUBLE AS rf, {_MEAN.format(MOMENTUM)} AS mom
    FROM fl JOIN sectors USING (ticker) WHERE r IS NOT NULL GROUP BY date HAVING mom IS NOT NULL)"""
_FACTOR_NAMES = ("mkt", "smb", "hml", "rmw", "cma", "rf", "mom")

ORACLES = {
    "stored_panel": f"WITH {BARS} SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars",
    "run_record": f"""WITH RECURSIVE {BARS}, {CONSTRAINED}, {_LEDGER}, {_EQUITY}
        SELECT 'run-1' AS run_id, 'tsmom' AS config_name, count(*) AS n_bars,
          {r('arg_max(cash + value, date)', 'final_equity', 1)} FROM eq""",
    "run_hash": f"""WITH {BARS}, s AS (SELECT ticker, count(*) AS n_bars, CAST(min(date) AS VARCHAR) AS start
          FROM bars GROUP BY ticker)
        SELECT *, substr(sha256('{{"n_bars":' || n_bars || ',"start":"' || start || '","ticker":"' || ticker || '"}}'), 1, 16)
          AS config_hash FROM s""",
    "factors_ff5_mom": f"WITH {_FACTOR_SQL} SELECT date, {', '.join(r(c, c) for c in _FACTOR_NAMES)} FROM fm",
    "factors_monthly": f"""WITH {_FACTOR_SQL} SELECT CAST(date_trunc('month', date) AS DATE) AS date,
        {', '.join(r(f'product(1 + {c}) - 1', c) for c in _FACTOR_NAMES)} FROM fm GROUP BY 1""",
    "vendor_panel": f"WITH {BARS} SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars",
    "members_from_csv": f"""WITH m AS (SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker,
          CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem WHERE l_quantity > 0 GROUP BY 1)
        SELECT CAST(d AS DATE) AS asof_date, ticker FROM m, (SELECT unnest([{', '.join(f"DATE '{x}'" for x in ASOF_DATES)}]) AS d)
        WHERE d >= a AND (b >= DATE '2001-10-25' OR d <= b)""",
    "audit_incremental": f"""WITH {BARS} SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS date_min, max(date) AS date_max,
        {r('avg(CAST(volume = 0 AS INTEGER))', 'zero_volume_fraction', 4)},
        {', '.join(r(f'1 - count({c}) / count(*)', f'missing_{c}', 4) for c in VALUE_COLUMNS)},
        {', '.join(r(f'avg({c})', f'avg_{c}', 4) for c in VALUE_COLUMNS)},
        {', '.join(r(f'stddev_samp({c})', f'sd_{c}', 4) for c in VALUE_COLUMNS)} FROM bars""",
}
