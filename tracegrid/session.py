"""Session building and the two places where the engine touches session state."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Largest number of rows that an operator may ever mark for broadcast. Every broadcast in the library is bounded by a
#: constant of its own (counters of a summary, entries of a catalogue) that lies below this.
BROADCAST_ROWS = 10_000


def build(app: str = "tracegrid", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings that the operators assume: UTC, adaptive execution with skew joins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings: dict[str, object] = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints go with the frames that were cut there.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors that ``spark.checkpoint.dir`` names; one of our own only where that is unset.

    A cluster must name a shared folder: without one a folder of the driver's machine would be taken for it, so that is an
    error. A session on one machine may name none and gets a temporary one, which goes when Python ends.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("name a folder shared by all executors in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="tracegrid-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a frame into the shared checkpoint folder and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Functions that SQL can call once ``register`` has run: name, parameters, result, expression. All of them run in the JVM.
FUNCTIONS = [
    ("tg_host", "url STRING", "STRING", r"lower(regexp_extract(url, r'^[^\p{L}\p{N}]*(?:[A-Za-z]+\s*:\s*/\s*/)?[^\p{L}\p{N}]*(?:[wW][wW][wW]\.)?([\p{L}\p{N}.-]+)', 1))"),
    ("tg_platform", "name STRING", "STRING", r"coalesce(nullif(lower(regexp_replace(name, r'^[\s\p{Z}]+|[\s\p{Z}]+$', '')), ''), 'unknown')"),
    ("tg_share", "part DOUBLE, whole DOUBLE", "DOUBLE", "coalesce(try_divide(part, whole), 0D)"),
    ("tg_wilson_lower", "k DOUBLE, n DOUBLE", "DOUBLE", "CASE WHEN n <= 0 OR k <= 0 THEN 0D ELSE (k / n + 1.9208D / n - 1.96D * sqrt(k / n * (1 - k / n) / n + 0.9604D / (n * n))) / (1 + 3.8416D / n) END"),
]


def register(spark: SparkSession, extra: list[tuple[str, str, str, str]] | None = None) -> list[str]:
    """Make the library's functions, and any of the caller's, known to SQL in this session; the names. Existing ones are replaced."""
    for name, params, result, body in (*FUNCTIONS, *(extra or [])):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return [n for n, *_ in (*FUNCTIONS, *(extra or []))]
