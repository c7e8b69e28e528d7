"""Per-key results over skewed keys: partial states merged in rounds of bounded fan-in.

Level 0 combines the rows of an input chunk where they are read: Spark's partial aggregation leaves one state per key and
chunk. Each round then merges the states of ``fan_in`` neighbouring chunks, so a task receives at most ``fan_in`` states
of a key, however many rows the key owns; the number of rounds is the logarithm of the number of chunks, so the last round
receives no more and leaves one state per key.

States are sums, counts, minima and maxima, so merging is the same expression at every level and no float average is
averaged again.

Defined cases: null, blank and padded keys are the caller's to normalise (``platform_key`` does for platform names); null
measures are skipped and a key whose measures are all null has a null sum; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 64


def rounds_for(chunks: int, fan_in: int) -> int:
    """Rounds of merging after which one state is left of so many; one at least."""
    n = 1
    while fan_in**n < chunks:
        n += 1
    return n


def platform_key(name: Column) -> Column:
    """A platform name without outer white space and in lower case; null and blank as 'unknown'."""
    bare = F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare.isNull() | (bare == ""), "unknown").otherwise(bare)


def _merge(kind: str, name: str) -> Column:
    return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[kind](name).alias(name)


def _state(kind: str, value: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value)


def tree_aggregate(df: DataFrame, keys: dict[str, Column], measures: dict[str, tuple[str, Column]], fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """One row per key with its measures, name -> ('sum' | 'count' | 'min' | 'max', column).

    chunks: the partitions of df. By default they are asked for, which plans a scan and runs nothing; a frame with shuffles
    of its own would run them, so name an upper bound for one.
    """
    rounds = rounds_for(chunks or df.rdd.getNumPartitions(), fan_in)
    by = [c.alias(k) for k, c in keys.items()]
    values = [c.alias(f"_v_{k}") for k, (_, c) in measures.items()]
    rows = df.select(*by, *values, F.expr(f"spark_partition_id() div {fan_in}").alias("_node"))
    level = rows.groupBy(*keys, "_node").agg(*[_state(kind, F.col(f"_v_{k}")).alias(k) for k, (kind, _) in measures.items()])
    for _ in range(rounds - 1):
        level = level.withColumn("_node", F.expr(f"_node div {fan_in}")).groupBy(*keys, "_node").agg(*[_merge(kind, k) for k, (kind, _) in measures.items()])
    return level.groupBy(*keys).agg(*[_merge(kind, k) for k, (kind, _) in measures.items()])


def shares(df: DataFrame, group: str, load: str) -> DataFrame:
    """df with the column total: the load of all keys of its group. ``group`` has a constant number of values."""
    totals = df.groupBy(group).agg(F.sum(load).alias("total"))
    return df.join(totals, group)
