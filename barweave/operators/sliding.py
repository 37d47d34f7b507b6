"""Sliding moments and maxima whose cost does not grow with the window.

A series is cut into blocks as long as the window. Any window is the suffix of one block and
the prefix of the next, so a running summary from the left and one from the right of each
block, both plain running aggregates, give every window by one merge. Summaries are count,
mean, sum of squared deviations, co-moment and maximum; merging them (Chan's formulas)
subtracts no sums, so a constant stretch has a deviation of exactly zero.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.rolling import ordered


def _summaries(
    moments: Mapping[str, Column], pairs: Mapping[str, tuple[Column, Column]], maxima: Mapping[str, Column]
) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, x in moments.items():
        out |= {f"{name}_n": F.count(x), f"{name}_mean": F.avg(x), f"{name}_m2": F.var_pop(x)}
    for name, (x, y) in pairs.items():
        both = x.isNotNull() & y.isNotNull()
        u, v = F.when(both, x), F.when(both, y)
        out |= {f"{name}_n": F.count(u), f"{name}_x": F.avg(u), f"{name}_y": F.avg(v), f"{name}_co": F.covar_pop(u, v)}
    return out | {name: F.max(x) for name, x in maxima.items()}


def sliding(
    df: DataFrame,
    window: int,
    by: str = "ticker",
    order: str = "date",
    moments: Mapping[str, Column] | None = None,
    pairs: Mapping[str, tuple[Column, Column]] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``df`` with summaries of the last ``window`` rows of each series.

    A moment adds ``_n``, ``_mean`` and ``_m2`` (sum of squared deviations), a pair ``_n``, ``_x``,
    ``_y`` (means) and ``_co`` (sum of products of deviations) over rows where both are there, a
    maximum a column of its name. NULLs are left out; early rows summarise what there is.
    """
    if window <= 0:
        raise ValueError("window must be positive")
    moments, pairs, maxima = moments or {}, pairs or {}, maxima or {}
    found = _summaries(moments, pairs, maxima)
    at = F.row_number().over(ordered(by, order)) - 1
    block = Window.partitionBy(by, "_block")
    running = (Window.unboundedPreceding, Window.currentRow)
    prefix, suffix = block.orderBy(order).rowsBetween(*running), block.orderBy(F.desc(order)).rowsBetween(*running)
    blocks = df.withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / window))
    both = blocks.withColumns({f"_p_{c}": v.over(prefix) for c, v in found.items()}).withColumns(
        {f"_s_{c}": v.over(suffix) for c, v in found.items()}
    )
    # The window ends in this block; the rest of it is the suffix that begins window - 1 rows
    # earlier. At a block's last row the prefix is the whole window.
    other = F.col("_at") % window != window - 1
    laid = both.withColumns({f"_s_{c}": F.when(other, F.lag(f"_s_{c}", window - 1).over(ordered(by, order))) for c in found})

    out: dict[str, Column] = {}

    def merged(name: str, means: tuple[str, ...], second: str) -> None:
        na, nb = (F.coalesce(F.col(f"_{side}_{name}_n"), F.lit(0)) for side in "sp")
        n = na + nb
        apart = {}
        for m in means:
            a, b = F.col(f"_s_{name}_{m}"), F.col(f"_p_{name}_{m}")
            # Means that differ by rounding are one mean: what that drops is below the last bit.
            noise = F.abs(b - a) <= F.greatest(F.abs(a), F.abs(b)) * 1e-15
            apart[m] = F.when(noise, F.lit(0.0)).otherwise(F.coalesce(b - a, F.lit(0.0)))
            out[f"{name}_{m}"] = F.when(na == 0, b).when(nb == 0, a).otherwise(a + apart[m] * nb / n)
        spread = F.coalesce(F.col(f"_s_{name}_{second}") * na, F.lit(0.0)) + F.coalesce(F.col(f"_p_{name}_{second}") * nb, F.lit(0.0))
        product = apart[means[0]] * apart[means[-1]]
        out[f"{name}_{second}"] = F.when(n > 0, spread + F.when((na > 0) & (nb > 0), product * na * nb / n).otherwise(F.lit(0.0)))
        out[f"{name}_n"] = n

    for name in moments:
        merged(name, ("mean",), "m2")
    for name in pairs:
        merged(name, ("x", "y"), "co")
    for name in maxima:
        out[name] = F.greatest(f"_s_{name}", f"_p_{name}")
    return laid.select(*df.columns, *[v.alias(c) for c, v in out.items()])
