"""Factor exposures with heteroskedasticity- and autocorrelation-robust t statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators.metrics import SERIES

FF_FACTORS = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "MOM")


def newey_west_lag(n: int) -> int:
    return max(1, math.floor(4.0 * (n / 100.0) ** (2.0 / 9.0)))


def hac_ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Coefficients, t statistics, R squared and lag for a design that includes a constant."""
    n = len(y)
    lag = newey_west_lag(n)
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ (x.T @ y)
    e = y - x @ beta
    scores = x * e[:, None]
    meat = scores.T @ scores
    for k in range(1, lag + 1):
        cross = scores[k:].T @ scores[:-k]
        meat += (1.0 - k / (lag + 1.0)) * (cross + cross.T)
    var = np.diag(bread @ meat @ bread)
    t = np.divide(beta, np.sqrt(var), out=np.full(len(beta), np.nan), where=var > 0)
    centred = float(((y - y.mean()) ** 2).sum())
    return beta, t, 1.0 - float(e @ e) / centred if centred > 0 else math.nan, lag


def factor_exposure(returns: DataFrame, factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Regression of each series on the named factor columns, long by coefficient.

    One row per (series_id, factor) with "alpha" for the constant. A series with fewer than
    ``max(20, k + 5)`` complete dates gets NULLs. A group is one series: at most one row per
    calendar date.
    """
    cols = [f"f{i}" for i in range(len(names))]
    picked = factors.select("date", *[F.col(f"`{n}`").cast("double").alias(c) for n, c in zip(names, cols)])
    joined = returns.select(SERIES, "date", "r").join(picked, "date").dropna("any", subset=["r", *cols])
    terms = ["alpha", *names]
    schema = f"{SERIES} string, factor string, beta double, t_stat double, r_squared double, n_obs long, lag int"

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        n = len(pdf)
        if n < max(20, len(cols) + 5):
            return pd.DataFrame(
                {SERIES: key[0], "factor": terms, "beta": None, "t_stat": None, "r_squared": None, "n_obs": n, "lag": 0}
            )
        x = np.column_stack([np.ones(n), pdf[cols].to_numpy()])
        beta, t, r2, lag = hac_ols(pdf["r"].to_numpy(), x)
        return pd.DataFrame(
            {SERIES: key[0], "factor": terms, "beta": beta, "t_stat": t, "r_squared": r2, "n_obs": n, "lag": lag}
        )

    return joined.groupBy(SERIES).applyInPandas(fit, schema)


def fama_french_betas(
    returns: DataFrame, factors: DataFrame, names: Sequence[str] = FF_FACTORS
) -> DataFrame:
    """Exposures of excess returns to those of the named factors that are present.

    A date without a risk-free rate counts as rate 0.
    """
    present = [n for n in names if n in factors.columns]
    if "RF" in factors.columns:
        rf = factors.select("date", F.col("RF").alias("_rf"))
        returns = returns.join(rf, "date", "left").withColumn(
            "r", F.col("r") - F.coalesce("_rf", F.lit(0.0))
        )
    return factor_exposure(returns, factors, present)
