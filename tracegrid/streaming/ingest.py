"""Captures as a stream: late and repeated ones dropped by watermark, features counted per window and site.

The batch operators accept what these give; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.operators.corpus import normalized_url


def observations(spark: SparkSession, path: str, schema: str, watermark: str = "1 day", files_per_trigger: int = 16) -> DataFrame:
    """Header observations that arrive as Parquet or JSON files, each once per site, feature, value and watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    rows = rows.where("site_host is not null and header_name is not null").withColumns({"feature": F.lower("header_name"), "captured_at": F.col("captured_at").cast("timestamp")})
    return rows.withWatermark("captured_at", watermark).dropDuplicatesWithinWatermark(["site_host", "feature", "header_value", "page_kind"])


def window_counts(obs: DataFrame, width: str = "7 days") -> DataFrame:
    """window_start, feature, sites, rows per tumbling window; sites by a sketch, since streams hold no exact distinct."""
    w = F.window("captured_at", width)
    per = obs.groupBy(w, "feature").agg(F.approx_count_distinct("site_host", 0.01).alias("sites"), F.count(F.lit(1)).alias("rows"))
    return per.select(F.col("window.start").alias("window_start"), "feature", "sites", "rows")


def latest_captures(captures: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A stream of captures with one per normalised address within the watermark."""
    keyed = captures.withColumn("normalized_url", normalized_url(F.col("url"))).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return keyed.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["normalized_url"])


def run_available(stream: DataFrame, checkpoint: str, table: str) -> None:
    """Run what is available into an in-memory table and stop: for tests and catch-up runs."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("append").format("memory").queryName(table).start().awaitTermination()
