"""Validation splits and robustness tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.constants import TRADING_DAYS
from barweave.functions import stats as st
from barweave.operators.metrics import SERIES


def walk_forward(
    dates: DataFrame,
    train_years: int = 5,
    test_years: int = 1,
    mode: str = "rolling",
    step_years: int | None = None,
) -> DataFrame:
    """Fold table in bars of 252 per year, over one calendar (one row per date)."""
    if mode not in ("rolling", "expanding"):
        raise ValueError(f"unknown mode: {mode!r}")
    train, test = train_years * TRADING_DAYS, test_years * TRADING_DAYS
    step = (test_years if step_years is None else step_years) * TRADING_DAYS
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    pos = F.row_number().over(w) - 1
    start = F.lag("date", train).over(w) if mode == "rolling" else F.first("date").over(w)
    placed = dates.select(
        pos.alias("_pos"),
        start.alias("train_start"),
        F.lag("date", 1).over(w).alias("train_end"),
        F.col("date").alias("test_start"),
        F.lead("date", test - 1).over(w).alias("test_end"),
    )
    opens = (F.col("_pos") >= train) & ((F.col("_pos") - train) % step == 0) & F.col("test_end").isNotNull()
    return placed.where(opens).select(
        ((F.col("_pos") - train) / step).cast("int").alias("fold"),
        "train_start",
        "train_end",
        "test_start",
        "test_end",
    )


def _positions(obs: DataFrame, n_groups: int) -> DataFrame:
    """Add position, series length and the contiguous group; early groups take the remainder."""
    by = Window.partitionBy(SERIES)
    df = obs.withColumns(
        {
            "obs_id": F.row_number().over(by.orderBy("date")) - 1,
            "_n": F.count(F.lit(1)).over(by).cast("int"),
        }
    )
    size, extra = F.floor(F.col("_n") / n_groups).cast("int"), F.col("_n") % n_groups
    df = df.withColumns({"_size": size, "_extra": extra})
    in_long = F.col("obs_id") < F.col("_extra") * (F.col("_size") + 1)
    tail = F.col("obs_id") - F.col("_extra") * (F.col("_size") + 1)
    group = F.when(in_long, F.floor(F.col("obs_id") / (F.col("_size") + 1))).otherwise(
        F.col("_extra") + F.floor(F.try_divide(tail, F.col("_size")))
    )
    return df.withColumn("obs_group", group.cast("int"))


def _group_start(g: Column) -> Column:
    return g * F.col("_size") + F.least(g, F.col("_extra"))


def cpcv_splits(
    obs: DataFrame, n_groups: int = 10, n_test_groups: int = 2, embargo: int = 5, keep_purged: bool = False
) -> DataFrame:
    """Every choice of test groups, with each observation's role in it.

    ``obs`` is (series_id, date). A training row within ``embargo`` bars of a test row is
    purged. Group bounds are arithmetic, so roles need no join.
    """
    if n_test_groups >= n_groups:
        raise ValueError("n_test_groups must be < n_groups")
    choices = F.array(
        *[
            F.struct(F.lit(i).alias("split_id"), F.array(*[F.lit(g) for g in c]).alias("groups"))
            for i, c in enumerate(combinations(range(n_groups), n_test_groups))
        ]
    )
    df = _positions(obs, n_groups).withColumn("_c", F.explode(choices))
    x = F.col("obs_id")

    def close(g: Column) -> Column:
        lo, hi = _group_start(g), _group_start(g + 1) - 1
        return (lo <= hi) & (x >= lo - embargo) & (x <= hi + embargo)

    role = (
        F.when(F.array_contains("_c.groups", F.col("obs_group")), "test")
        .when(F.lit(embargo > 0) & F.exists("_c.groups", close), "purged")
        .otherwise("train")
    )
    out = df.select(*obs.columns, F.col("_c.split_id").alias("split_id"), "obs_id", role.alias("role"))
    return out if keep_purged else out.where("role <> 'purged'")


def n_paths(n_groups: int = 10, n_test_groups: int = 2) -> int:
    """How many out-of-sample paths the combinations form."""
    return int(comb(n_groups, n_test_groups) * n_test_groups / n_groups)


def cpcv_sharpes(
    returns: DataFrame, n_groups: int = 10, n_test_groups: int = 2, embargo: int = 5, min_obs: int = 30
) -> DataFrame:
    """Sharpe ratio of each split's test rows, for splits with enough of them."""
    splits = cpcv_splits(returns.where("r IS NOT NULL"), n_groups, n_test_groups, embargo)
    out = splits.where("role = 'test'").groupBy(SERIES, "split_id").agg(
        st.sharpe(F.col("r")).alias("sharpe"), F.count("r").alias("n_obs")
    )
    return out.where((F.col("n_obs") >= min_obs) & F.col("sharpe").isNotNull())


def purged_kfold(
    labels: DataFrame, n_folds: int = 5, embargo: int = 5, keep_purged: bool = False
) -> DataFrame:
    """Contiguous folds; training labels whose span meets the test span are purged.

    ``labels`` is (series_id, date, end_pos): the 0-based bar on which each label is known.
    The embargo follows the test span only. Roles need no join.
    """
    df = _positions(labels, n_folds).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    lo = _group_start(F.col("fold"))
    hi = _group_start(F.col("fold") + 1) - 1
    last_known = hi + F.greatest(F.lit(embargo), _span_after(hi))
    meets = (F.col("obs_id") <= last_known) & (F.col("end_pos") >= lo)
    role = F.when(F.col("obs_group") == F.col("fold"), "test").when(meets, "purged").otherwise("train")
    out = df.select(*labels.columns, "fold", "obs_id", role.alias("role"))
    return out if keep_purged else out.where("role <> 'purged'")


def _span_after(hi: Column) -> Column:
    """Bars past the test span during which its own labels are still open."""
    by = Window.partitionBy(SERIES, "fold")
    return F.coalesce(F.max(F.when(F.col("obs_group") == F.col("fold"), F.col("end_pos"))).over(by) - hi, F.lit(0))


def lookahead_check(
    signal: Callable[[DataFrame], DataFrame], panel: DataFrame, cutoff: str, factor: float = 3.0
) -> DataFrame:
    """Scores up to ``cutoff`` from the panel and from one whose later prices are disturbed.

    One row: how many scores were compared and how many changed (0 without look-ahead).
    """
    later = F.col("date") > F.lit(cutoff).cast("date")
    shaken = panel.withColumn(
        "adj_close", F.when(later, F.col("adj_close") * (factor + F.dayofmonth("date"))).otherwise(F.col("adj_close"))
    )
    before = F.col("date") <= F.lit(cutoff).cast("date")
    a, b = (signal(p).where(before).select("date", "ticker", "score") for p in (panel, shaken))
    sides = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    per_key = sides.groupBy("date", "ticker", "score").agg(F.sum("side").alias("net"), F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("net") == 0, F.col("n") / 2)), F.lit(0)).cast("long").alias("n_same"),
        F.count(F.when(F.col("net") != 0, 1)).alias("n_changed"),
    )


def cost_sensitivity(
    gross: DataFrame, costs: DataFrame, multipliers: Sequence[float] = (0.0, 1.0, 2.0, 5.0)
) -> DataFrame:
    """Sharpe and annual return per cost multiple.

    ``gross`` is (series_id, date, r) before trade costs and ``costs`` (series_id, date, cost)
    as a fraction of capital. Trade costs are linear in the multiple; borrow stays outside.
    """
    net = gross.join(costs, [SERIES, "date"], "left").withColumn(
        "multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))
    )
    r = F.col("r") - F.col("multiplier") * F.coalesce("cost", F.lit(0.0))
    return net.withColumn("r", r).groupBy(SERIES, "multiplier").agg(
        st.sharpe(F.col("r")).alias("sharpe"), st.annual_return(F.col("r")).alias("cagr")
    )


def regime_sharpe(returns: DataFrame, macro: DataFrame, value: str = "value", regimes: int = 3) -> DataFrame:
    """Sharpe per tercile of a macro series (date, value); one row per calendar date."""
    w = Window.partitionBy(F.lit(0)).orderBy(value, "date")
    bands = macro.where(F.col(value).isNotNull()).select("date", F.ntile(regimes).over(w).alias("regime"))
    return (
        returns.join(bands, "date")
        .groupBy(SERIES, "regime")
        .agg(st.sharpe(F.col("r")).alias("sharpe"), F.count("r").alias("n_obs"))
    )
