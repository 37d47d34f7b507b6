"""Signals and allocators by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from barweave.operators import covariance, ml, pairs, signals, weights

SIGNALS: dict[str, Callable[..., DataFrame]] = {
    "tsmom": signals.tsmom,
    "xsmom": signals.xsmom,
    "carry": signals.carry,
    "quality": signals.quality,
    "ou": signals.ou_mean_reversion,
    "pairs": pairs.pairs_trade,
    "ml": ml.ml_signal,
}
ALLOCATORS: dict[str, Callable[..., DataFrame]] = {
    "equal_weight": weights.equal_weight,
    "inverse_variance": covariance.inverse_variance,
}


def signal(kind: str) -> Callable[..., DataFrame]:
    """A signal builder by name."""
    if kind not in SIGNALS:
        raise ValueError(f"unknown signal kind: {kind!r}")
    return SIGNALS[kind]


def allocator(kind: str) -> Callable[..., DataFrame]:
    """An allocator by name."""
    if kind not in ALLOCATORS:
        raise ValueError(f"unknown allocator kind: {kind!r}")
    return ALLOCATORS[kind]
