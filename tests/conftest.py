"""Shared session and small frames."""

from __future__ import annotations

import sys
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def bdays(n: int, start: str = "2018-01-02") -> list[date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def days(n: int, start: date = date(2020, 1, 1)) -> list[date]:
    return [start + timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="session")
def make_prices(spark):
    """(date, ticker, adj_close, ...) from a dict of price lists on consecutive days."""

    def make(columns: dict[str, list], start: date = date(2020, 1, 1)):
        rows = []
        for ticker, prices in columns.items():
            for d, p in zip(days(len(prices), start), prices):
                if p is not None:
                    rows.append((d, ticker, float(p)))
        return spark.createDataFrame(rows, "date date, ticker string, adj_close double")

    return make


@pytest.fixture(scope="session")
def make_series(spark):
    def make(columns: dict[str, list], start: date = date(2020, 1, 1)):
        rows = [
            (k, d, None if r is None else float(r))
            for k, v in columns.items()
            for d, r in zip(days(len(v), start), v)
        ]
        return spark.createDataFrame(rows, "series_id string, date date, r double")

    return make


@pytest.fixture(scope="session")
def panel_pdf() -> pd.DataFrame:
    """5 tickers x 300 business days, one common factor."""
    rng = np.random.default_rng(7)
    n, k = 300, 5
    f = rng.normal(0.0003, 0.01, n)
    dates = bdays(n)
    frames = []
    for j in range(k):
        r = (0.7 + 0.15 * j) * f + rng.normal(0, 0.012, n)
        c = 100 * np.exp(np.cumsum(r))
        o = c * (1 + rng.normal(0, 0.006, n))
        h = np.maximum(np.maximum(o, c), c * (1 + np.abs(rng.normal(0, 0.01, n))))
        low = np.minimum(np.minimum(o, c), c * (1 - np.abs(rng.normal(0, 0.01, n))))
        v = rng.integers(500_000, 2_500_000, n).astype(float)
        frames.append(
            pd.DataFrame(
                {"date": dates, "ticker": f"T{j}", "open": o, "high": h, "low": low, "close": c, "adj_close": c, "volume": v}
            )
        )
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    from barweave.sources.panel import PANEL_SCHEMA

    return spark.createDataFrame(panel_pdf, PANEL_SCHEMA).cache()


@pytest.fixture(scope="session")
def wide(panel_pdf) -> pd.DataFrame:
    return panel_pdf.pivot(index="date", columns="ticker", values="adj_close")


def column(df, value: str, key: str = "date") -> list:
    return [row[value] for row in df.orderBy(key).collect()]
