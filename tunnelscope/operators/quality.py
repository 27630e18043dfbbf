"""Reports on the quality of a run's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT_WINDOWS = 3
SUSTAINED_WINDOWS = 5


def event_quality(events: DataFrame) -> DataFrame:
    """Number of events, and of those that break each rule."""
    rules = {
        "null_fields": F.greatest(*[F.col(c).isNull().cast("int") for c in events.columns]) == 1,
        "score_out_of_range": ~F.col("score").between(0, 1),
        "thr_out_of_range": ~F.col("thr").between(0, 1),
        "bad_pred": ~F.col("pred").isin(0, 1),
        "bad_debounced": ~F.col("debounced").isin(0, 1),
    }
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        *[F.count_if(rule).cast("bigint").alias(name) for name, rule in rules.items()],
    )


def score_separation(events: DataFrame) -> DataFrame:
    """Mean score of positive and of negative rows, and their distance."""
    means = events.agg(
        F.avg(F.when(F.col("pred") == 1, F.col("score"))).alias("mean_positive"),
        F.avg(F.when(F.col("pred") == 0, F.col("score"))).alias("mean_negative"),
    )
    return means.withColumn("separation", F.col("mean_positive") - F.col("mean_negative"))


def threshold_consistency(events: DataFrame) -> DataFrame:
    """Distinct thresholds per class (must be 1) and over all classes (must be 2 or more)."""
    rounded = F.floor(F.col("thr") * 1e6 + 0.5).cast("double") / 1e6
    per_class = events.groupBy("qfi").agg(F.count_distinct(rounded).alias("thresholds"))
    overall = events.select(F.count_distinct(rounded)).scalar()
    return per_class.withColumn("overall", overall)


def episode_mix(found: DataFrame) -> DataFrame:
    """Short, middle and sustained episodes, and the classes they hit."""
    kind = (
        F.when(F.col("duration") <= SHORT_WINDOWS, "short")
        .when(F.col("duration") >= SUSTAINED_WINDOWS, "sustained")
        .otherwise("middle")
    )
    return found.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_distinct("qfi").alias("classes"),
        F.max("peak_score").alias("peak_score"),
        F.max("duration").alias("longest"),
    )


def debounce_effect(events: DataFrame) -> DataFrame:
    """Positive rows before and after debouncing."""
    return events.agg(
        F.count_if(F.col("pred") == 1).cast("bigint").alias("positive"),
        F.count_if(F.col("debounced") == 1).cast("bigint").alias("debounced"),
    )
