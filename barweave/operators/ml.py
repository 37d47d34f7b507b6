"""Gradient-boosted classifier on the feature frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.operators import boosting
from barweave.operators.calendar import asof_last
from barweave.operators.cross_section import to_gross, with_group
from barweave.operators.features import FEATURES, bar_number, feature_frame, first_complete, realized_vol
from barweave.operators.labels import Barriers, triple_barrier
from barweave.session import materialise


def training_frame(
    features: DataFrame, past: DataFrame, barriers: Barriers = Barriers(), thresh: float = 1e-4, min_bars: int = 260
) -> DataFrame:
    """Complete feature rows with target 1 when the upper barrier is touched first within ``past``.

    Features look back only, so those of all bars serve; a ticker needs ``min_bars`` bars in ``past``.
    Labels need a 21-bar volatility. The bars before it exists also lack the yearly
    features, so no look-ahead fill is required, and bars before the first that can have all
    features get no label.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    bars = past.select("date", "ticker", "adj_close").withColumn("_bars", size).where(F.col("_bars") >= min_bars)
    bars = realized_vol(bars, 21).withColumn("_event", bar_number() >= first_complete(thresh))
    labels = triple_barrier(bars, event="_event", barriers=barriers)
    labels = labels.select(F.col("t0").alias("date"), "ticker", (F.col("bin") > 0).cast("int").alias("target"))
    return features.join(labels, ["date", "ticker"]).dropna("any")


def fit(
    train: DataFrame,
    n_estimators: int = 200,
    max_depth: int = 3,
    learning_rate: float = 0.05,
    seed: int = 1729,
) -> boosting.Model | None:
    """The fitted model, or None when the targets are all alike.

    Nothing is drawn at random, so ``seed`` has no effect.
    """
    classes = train.agg(F.min("target").alias("lo"), F.max("target").alias("hi")).first()
    if classes is None or classes["lo"] is None or classes["lo"] == classes["hi"]:
        return None
    return boosting.fit(train, FEATURES, "target", ("date", "ticker"), n_estimators, max_depth, learning_rate)


def predict(model: boosting.Model | None, features: DataFrame, dates: DataFrame) -> DataFrame:
    """Scores at each decision date from every ticker's latest feature row.

    ``2 p - 1``, less its cross-sectional mean, scaled to unit gross. A ticker whose latest
    row is incomplete has no score; an unfitted model has none at all.
    """
    spark = features.sparkSession
    if model is None:
        return spark.createDataFrame([], "date date, ticker string, score double")
    bars = asof_last(features.select("date", "ticker"), dates)
    complete = features.dropna("any", subset=list(FEATURES)).withColumnRenamed("date", "bar_date")
    latest = complete.join(bars, ["ticker", "bar_date"])
    raw = materialise(latest.select("date", "ticker", (2 * model.p_up() - 1).alias("score")))
    centred = with_group(raw, ["date"], {"_m": F.avg("score")})
    centred = materialise(centred.select("date", "ticker", (F.col("score") - F.col("_m")).alias("score")))
    return to_gross(centred)


def ml_signal(
    panel: DataFrame,
    dates: DataFrame,
    train_end: str,
    barriers: Barriers = Barriers(),
    thresh: float = 1e-4,
    **params: object,
) -> DataFrame:
    """Fit on bars whose label is known by ``train_end`` and score the decision dates after it."""
    end = F.lit(train_end).cast("date")
    features = materialise(feature_frame(panel, thresh))
    known = features.where(F.col("date") <= end)
    train = materialise(training_frame(known, panel.where(F.col("date") <= end), barriers, thresh))
    return predict(fit(train, **params), features, dates.where(F.col("date") > end))
