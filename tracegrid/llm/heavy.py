"""Most frequent values in bounded memory: Misra-Gries summaries per partition, merged in rounds.

A summary holds at most ``k`` counters per field. It is reduced by subtracting the next-largest counter, the (k+1)-th,
from all and dropping those that reach zero; two summaries merge by adding their counters and reducing again. Whatever
occurs in more than n / (k + 1) of n rows keeps a counter, and a counter lies below the true count by at most ``error``.

Values enter as 64-bit hashes, computed in the JVM, so memory does not depend on the length of values and only 12 bytes a
row reach Python. A hash collision can only raise a counter, so the guarantee holds; a second pass counts the values
behind the surviving hashes exactly. What is broadcast for it is at most k hashes per field.

Defined cases: null and empty values are not counted (blank ones are); null arrays and members are skipped; repeated rows
count as they stand; ties at the threshold are kept (the test is >=); an empty field gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.tree_aggregate import rounds_for

SCHEMA = "field int, node long, totals boolean, item long, count long, error long, n long"
FAN_IN = 128


def reduce_counters(items: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counters of one item added up; then at most k of them, less the (k+1)-th largest, which is returned as the loss."""
    uniq, where = np.unique(items, return_inverse=True)
    total = np.zeros(len(uniq), np.int64)
    np.add.at(total, where, counts)
    if len(uniq) <= k:
        return uniq, total, 0
    cut = int(np.partition(total, len(total) - k - 1)[len(total) - k - 1])
    keep = total > cut
    return uniq[keep], total[keep] - cut, cut


class Summary:
    """Misra-Gries counters of one field."""

    def __init__(self, k: int) -> None:
        self.k, self.n, self.error = k, 0, 0
        self.items, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, items: np.ndarray, counts: np.ndarray, n: int, error: int = 0) -> None:
        self.n += n
        self.items, self.counts, cut = reduce_counters(np.concatenate([self.items, items]), np.concatenate([self.counts, counts]), self.k)
        self.error += error + cut

    def rows(self, field: int, node: int) -> dict[str, list]:
        """A row with the totals and one per counter. No column is ever null: a null would turn hashes into floats."""
        m = len(self.items) + 1
        return {
            "field": [field] * m,
            "node": [node] * m,
            "totals": [True] + [False] * (m - 1),
            "item": [0, *self.items.tolist()],
            "count": [0, *self.counts.tolist()],
            "error": [self.error] + [0] * (m - 1),
            "n": [self.n] + [0] * (m - 1),
        }


_ARROW = pa.schema([("field", pa.int32()), ("node", pa.int64()), ("totals", pa.bool_()), *[(c, pa.int64()) for c in ("item", "count", "error", "n")]])


def _local(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Summary] = {}
        for b in batches:
            field, item = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for f in np.unique(field):
                vals, counts = np.unique(item[field == f], return_counts=True)
                own.setdefault(int(f), Summary(k)).add(vals, counts, int(counts.sum()))
        ctx = TaskContext.get()
        for f, s in own.items():
            yield pa.RecordBatch.from_pydict(s.rows(f, ctx.partitionId() if ctx else 0), schema=_ARROW)

    return run


def _merge(k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = Summary(k)
        at = ~rows["totals"]
        s.add(rows.loc[at, "item"].to_numpy(np.int64), rows.loc[at, "count"].to_numpy(np.int64), int(rows["n"].sum()), int(rows["error"].sum()))
        return pd.DataFrame(s.rows(int(key[0]), int(key[1])))

    return run


def summaries(values: DataFrame, k: int, chunks: int | None = None) -> DataFrame:
    """One merged summary per field of a frame (field int, item long).

    Each round merges the summaries of FAN_IN neighbours, so no task ever holds more than FAN_IN * (k + 1) rows of a field.
    There are as many rounds as leave one summary of the partitions of the frame, whatever their number. chunks: that number,
    or a bound; by default it is asked for, which plans a scan and runs nothing.
    """
    rows = values.select("field", "item")
    s = rows.mapInArrow(_local(k), SCHEMA)
    for _ in range(rounds_for(chunks or rows.rdd.getNumPartitions(), FAN_IN)):
        s = s.withColumn("node", F.expr(f"node div {FAN_IN}")).groupBy("field", "node").applyInPandas(_merge(k), SCHEMA)
    return s


def most_frequent(values: DataFrame, share: float = 0.005, k: int = 1000) -> DataFrame:
    """field, value, approx_count, error, exact_count, n: the values that make up at least ``share`` of their field.

    values: (field int, value string). ``k`` must exceed 1 / share.
    """
    if k <= 1 / share:
        raise ValueError("k must exceed 1 / share")
    clean = values.select("field", "value").where("value is not null and value <> ''")
    s = summaries(clean.select("field", F.xxhash64("value").alias("item")), k)
    # The totals ride on every counter, so that the summary is read once; at most k rows per field are broadcast.
    packed = s.groupBy("field").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), F.collect_list(F.when(~F.col("totals"), F.struct("item", "count"))).alias("c"))
    kept = packed.select("field", "n", "error", F.explode("c").alias("c"))
    kept = kept.select("field", F.col("c.item").alias("item"), F.col("c.count").alias("approx_count"), "error", "n")
    kept = kept.where(F.col("approx_count") + F.col("error") + 1e-6 >= F.col("n") * F.lit(share))
    counted = (
        clean.withColumn("item", F.xxhash64("value"))
        .join(F.broadcast(kept), ["field", "item"])
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("exact_count"), F.first("approx_count").alias("approx_count"), F.first("error").alias("error"), F.first("n").alias("n"))
    )
    return counted.where(F.col("exact_count") + 1e-6 >= F.col("n") * F.lit(share))
