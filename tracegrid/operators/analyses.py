"""Stored verdicts on sites: joined evidence of two kinds of detectors, agreement, counts and spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.stats import ratio

#: Weights of generated and built-in strategies, and the confidence from which a platform counts as detected.
GENERATED, BUILTIN, THRESHOLD = 1.2, 1.0, 0.4


def hybrid(rows: DataFrame, key: str) -> DataFrame:
    """key, platform, confidence, generated, builtin of (key, platform, source, confidence) rows.

    Per platform the mean of the confidences above zero, weighted by their source; the best platform, ties to the first name,
    counts from the threshold on. generated and builtin are the plain means of either source for that platform.
    """
    w = F.when(F.col("source") == "generated", GENERATED).otherwise(BUILTIN)
    live = rows.where("confidence > 0 and platform is not null")
    mean = lambda s: F.round(F.avg(F.when(F.col("source") == s, F.col("confidence"))), 6)
    per = live.groupBy(key, "platform").agg(F.least(F.lit(1.0), F.sum(F.col("confidence") * w) / F.sum(w)).alias("c"), mean("generated").alias("generated"), mean("builtin").alias("builtin"))
    best = per.groupBy(key).agg(F.min(F.struct((-F.round("c", 9)).alias("c"), "platform", "generated", "builtin")).alias("b"))
    c = -F.col("b.c")
    return best.select(key, F.when(c >= THRESHOLD, F.col("b.platform")).otherwise("Unknown").alias("platform"), F.round(c, 6).alias("confidence"), "b.generated", "b.builtin")


def best_per_address(rows: DataFrame, by: list[str], confidence: Column) -> DataFrame:
    """by, confidence, records: the largest confidence of a platform at an address."""
    return rows.groupBy(*by).agg(F.round(F.max(confidence), 6).alias("confidence"), F.count(F.lit(1)).alias("records"))


def accuracy(rows: DataFrame, by: str, predicted: Column, actual: Column) -> DataFrame:
    """by, records, right, accuracy: how often a verdict agrees with the final one; null verdicts are wrong."""
    per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce(predicted == actual, F.lit(False))).alias("right"))
    return per.withColumn("accuracy", F.round(ratio(F.col("right"), F.col("records")), 6))


def spread(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """by, n, lowest, highest, mean, median, p95 of a value; quantiles interpolate. Nulls are left out."""
    v = rows.select(by, value.alias("v")).where("v is not null")
    return v.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", 0.5), 6).alias("median"), F.round(F.percentile("v", 0.95), 6).alias("p95"))
