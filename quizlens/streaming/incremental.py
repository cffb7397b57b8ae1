"""Measurements that can be kept up to date while items arrive.

Each function maps a streaming (or batch) DataFrame of items to one; sources, sinks and triggers
are the caller's. State is bounded by the watermark, or by the number of options.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.functions.text import item_digest, with_normal


def arriving_unique(items: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Items without those that repeat one (up to id, subject and white space) within the delay."""
    digested = with_normal(items).withColumn("digest", item_digest(F.col("nq"), F.col("nc"), F.col("answer_index"))).drop("nq", "nc")
    return digested.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])


def running_positions(items: DataFrame) -> DataFrame:
    """(k, position, n): answer positions so far by option count; update or complete mode."""
    return items.groupBy(F.size("choices").alias("k"), F.col("answer_index").alias("position")).agg(F.count(F.lit(1)).alias("n"))


def windowed_positions(items: DataFrame, event_time: str, window: str, delay: str) -> DataFrame:
    """(start, k, position, n): answer positions by window of delivery time; late items within the delay count."""
    timed = items.withWatermark(event_time, delay)
    counted = timed.groupBy(F.window(event_time, window), F.size("choices").alias("k"), F.col("answer_index").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "k", "position", "n")


def running_accuracy(outcomes: DataFrame) -> DataFrame:
    """(mask, hits, n): coalition accuracies so far, as counts."""
    return outcomes.groupBy("mask").agg(F.sum("correct").alias("hits"), F.count(F.lit(1)).alias("n"))
