"""Pair screening on the cointegration residual."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions.normal import norm_cdf
from barweave.operators.calendar import dates_after, in_windows
from barweave.operators.covariance import block_count, into_block_pairs, wide_block
from barweave.operators.cross_section import to_gross
from barweave.session import materialise

# MacKinnon (1994) response surface for the constant-only unit-root test,
# one series. Each polynomial is in ascending powers of the statistic.
ADF_LOWEST, ADF_SWITCH, ADF_HIGHEST = -18.83, -1.61, 2.74
ADF_LOW_TAIL = (2.1659, 1.4412, 0.038269)
ADF_HIGH_TAIL = (1.7339, 0.93202, -0.12745, -0.010368)


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and (X'X)^-1."""
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ (x.T @ y)
    e = y - x @ beta
    return beta, float(e @ e), inv


def adf_pvalue(x: np.ndarray) -> float:
    """Augmented Dickey-Fuller p-value with a constant and the lag count of least AIC.

    All lag counts are compared on the same rows; the chosen one is refitted on every row
    it allows. Series under 30 points and degenerate fits give 1.
    """
    n = len(x)
    if n < 30:
        return 1.0
    dx = np.diff(x)
    top = min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)

    def design(lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(first, len(dx))
        cols = [x[rows]] + [dx[rows - k] for k in range(1, lags + 1)] + [np.ones(len(rows))]
        return dx[rows], np.column_stack(cols)

    try:
        best, best_aic = 0, math.inf
        for lags in range(top + 1):
            y, m = design(lags, top)
            _, ssr, _ = _ols(y, m)
            aic = len(y) * math.log(ssr / len(y)) + 2 * m.shape[1]
            if aic < best_aic:
                best, best_aic = lags, aic
        y, m = design(best, best)
        beta, ssr, inv = _ols(y, m)
        stat = beta[0] / math.sqrt(ssr / (len(y) - m.shape[1]) * inv[0, 0])
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
        return 1.0
    if not math.isfinite(stat) or stat > ADF_HIGHEST:
        return 1.0
    if stat < ADF_LOWEST:
        return 0.0
    poly = ADF_LOW_TAIL if stat <= ADF_SWITCH else ADF_HIGH_TAIL
    return norm_cdf(sum(c * stat**k for k, c in enumerate(poly)))


def half_life_of(resid: np.ndarray) -> float:
    """ln 2 over the speed at which the residual's change opposes its level."""
    x, y = resid[:-1], np.diff(resid)
    xc = x - x.mean()
    den = float(xc @ xc)
    slope = float(xc @ (y - y.mean())) / den if den > 0 else math.nan
    return -math.log(2.0) / slope if slope < 0 else math.inf


def _slow_gates(resid: np.ndarray, gates: dict) -> tuple[float, float] | None:
    """Half-life and unit-root p-value of a residual, or None when either gate fails."""
    hl = half_life_of(resid)
    if not math.isfinite(hl) or hl > gates["max_half_life"]:
        return None
    if gates["adf_threshold"] is None:
        return hl, math.nan
    p = adf_pvalue(resid)
    return (hl, p) if p <= gates["adf_threshold"] else None


def _screen_pair(y: np.ndarray, x: np.ndarray, gates: dict) -> tuple[float, float, float, float] | None:
    """Slope, z, half-life and p-value of one given pair, or None when a gate fails."""
    xc = x - x.mean()
    if float(xc @ xc) <= 0:
        return None
    slope = float(xc @ (y - y.mean())) / float(xc @ xc)
    resid = (y - y.mean()) - slope * xc
    sd = float(resid.std(ddof=1))
    z = (resid[-1] - resid.mean()) / sd if sd > 0 else 0.0
    if not gates["entry_z"] < abs(z) < gates["stop_z"]:
        return None
    passed = _slow_gates(resid, gates)
    return None if passed is None else (slope, float(z), *passed)


def _screen_block(
    left: pd.DataFrame, right: pd.DataFrame, same: bool, min_obs: int, gates: dict
) -> list[tuple[str, str, float, float, float, float, int]]:
    """Surviving pairs between two blocks; the cheap gates run on whole matrices first."""
    names_l, names_r = left.columns.to_numpy(), right.columns.to_numpy()
    shift_l, shift_r = np.nanmean(left.to_numpy(), axis=0), np.nanmean(right.to_numpy(), axis=0)
    a, b = left.to_numpy() - shift_l, right.to_numpy() - shift_r
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    az, bz, fa, fb = np.where(ma, a, 0.0), np.where(mb, b, 0.0), ma.astype(float), mb.astype(float)
    n = fa.T @ fb
    with np.errstate(all="ignore"):
        ya, xb = az.T @ fb / n, fa.T @ bz / n
        sxy = az.T @ bz - n * ya * xb
        sxx = fa.T @ bz**2 - n * xb**2
        syy = (az**2).T @ fb - n * ya**2
        swap = names_l[:, None] > names_r[None, :]
        # The name that sorts first is the dependent one.
        slope = np.where(swap, sxy / syy, sxy / sxx)
        ssr = np.where(swap, sxx - sxy**2 / syy, syy - sxy**2 / sxx)
        sd = np.sqrt(np.maximum(ssr, 0.0) / (n - 1))
        both = ma[:, :, None] & mb[:, None, :]
        last = len(a) - 1 - np.argmax(both[::-1], axis=0)
        rows_a = a[last, np.arange(a.shape[1])[:, None]]
        rows_b = b[last, np.arange(b.shape[1])[None, :]]
        gap = np.where(swap, (rows_b - xb) - slope * (rows_a - ya), (rows_a - ya) - slope * (rows_b - xb))
        z = gap / sd
        keep = (n >= min_obs) & (sd > 0) & (np.abs(z) > gates["entry_z"]) & (np.abs(z) < gates["stop_z"])
    if same:
        keep &= np.triu(np.ones_like(keep, dtype=bool), 1)
    out = []
    for i, j in zip(*np.nonzero(keep)):
        ok = ma[:, i] & mb[:, j]
        y, x = (b[ok, j], a[ok, i]) if swap[i, j] else (a[ok, i], b[ok, j])
        resid = (y - y.mean()) - slope[i, j] * (x - x.mean())
        passed = _slow_gates(resid, gates)
        if passed is None:
            continue
        first, second = sorted((names_l[i], names_r[j]))
        out.append((first, second, float(slope[i, j]), float(z[i, j]), *passed, int(n[i, j])))
    return out


PAIR_SCHEMA = "date date, a string, b string, slope double, z double, half_life double, adf_p double, n_obs long"


def screen_pairs(
    panel: DataFrame,
    dates: DataFrame,
    window: int = 126,
    entry_z: float = 2.0,
    stop_z: float = 4.0,
    max_half_life: float = 30.0,
    adf_threshold: float | None = 0.05,
    candidates: DataFrame | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Tradable pairs at each decision date, over all unordered pairs of names.

    Log prices of the last ``window`` calendar dates go to the block pairs; only pairs that
    pass every gate leave their task. An explicit ``candidates`` list (a, b) is joined to the
    log prices instead, and its first name is the dependent one.
    """
    gates = {
        "entry_z": entry_z,
        "stop_z": stop_z,
        "max_half_life": max_half_life,
        "adf_threshold": adf_threshold,
    }
    logs = panel.select("date", "ticker", F.ln("adj_close").alias("lp"))
    calendar = panel.select("date")
    in_play = in_windows(logs, dates_after(dates, calendar, window + 2), window, by=None, calendar=calendar)
    if candidates is not None:
        return _screen_listed(in_play, candidates, window // 2, gates)
    blocks = blocks or block_count(logs)

    def screen(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asof, bi, bj = key
        days = pd.Index(sorted(pdf["date"].unique()))
        left = wide_block(pdf, bi, "lp", days)
        right = left if bi == bj else wide_block(pdf, bj, "lp", days)
        rows = []
        if not left.empty and not right.empty:
            rows = _screen_block(left, right, bi == bj, window // 2, gates)
        out = pd.DataFrame(rows, columns=["a", "b", "slope", "z", "half_life", "adf_p", "n_obs"])
        out.insert(0, "date", asof)
        return out

    spread = into_block_pairs(in_play, blocks)
    return spread.groupBy("asof", "bi", "bj").applyInPandas(screen, PAIR_SCHEMA)


def common_windows(panel: DataFrame, dates: DataFrame, candidates: DataFrame, window: int = 126) -> DataFrame:
    """(date, a, b, n_obs) of listed pairs with at least half a window of common dates.

    No gate applies: a pair whose residual drifts or has no spread counts as well.
    """
    logs = panel.select("date", "ticker", F.ln("adj_close").alias("lp"))
    calendar = panel.select("date")
    in_play = in_windows(logs, dates_after(dates, calendar, window + 2), window, by=None, calendar=calendar)
    counted = _listed(in_play, candidates).groupBy("asof", "a", "b").agg(F.count("*").alias("n_obs"))
    return counted.where(F.col("n_obs") >= window // 2).select(F.col("asof").alias("date"), "a", "b", "n_obs")


def _listed(in_play: DataFrame, candidates: DataFrame) -> DataFrame:
    """The common log prices of listed pairs: two equi-joins."""
    first = in_play.select("asof", "date", F.col("ticker").alias("a"), F.col("lp").alias("y"))
    second = in_play.select("asof", "date", F.col("ticker").alias("b"), F.col("lp").alias("x"))
    return (
        candidates.select("a", "b")
        .distinct()
        .join(first, "a")
        .join(second, ["b", "asof", "date"])
        .where("y IS NOT NULL AND x IS NOT NULL")
    )


def _screen_listed(in_play: DataFrame, candidates: DataFrame, min_obs: int, gates: dict) -> DataFrame:
    """The same gates for listed pairs: one group of a window's rows per pair."""
    both = _listed(in_play, candidates)

    def screen(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        row = None
        if len(pdf) >= min_obs:
            row = _screen_pair(pdf["y"].to_numpy(), pdf["x"].to_numpy(), gates)
        rows = [] if row is None else [(*key, *row, len(pdf))]
        return pd.DataFrame(rows, columns=["date", "a", "b", "slope", "z", "half_life", "adf_p", "n_obs"])

    return both.groupBy("asof", "a", "b").applyInPandas(screen, PAIR_SCHEMA)


def pair_legs(pairs: DataFrame) -> DataFrame:
    """Scores from surviving pairs: half a unit on the first leg, hedged on the second.

    A name's legs add up, then each date is scaled to unit gross.
    """
    side = -F.signum("z")
    legs = F.array(
        F.struct(F.col("a").alias("ticker"), (0.5 * side).alias("score")),
        F.struct(F.col("b").alias("ticker"), (-0.5 * side * F.col("slope")).alias("score")),
    )
    summed = (
        pairs.select("date", F.explode(legs).alias("leg"))
        .groupBy("date", "leg.ticker")
        .agg(F.sum("leg.score").alias("score"))
    )
    return to_gross(materialise(summed))


def pairs_trade(panel: DataFrame, dates: DataFrame, **gates: object) -> DataFrame:
    """Pair-trading scores (date, ticker, score)."""
    return pair_legs(screen_pairs(panel, dates, **gates))
