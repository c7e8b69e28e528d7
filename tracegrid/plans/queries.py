"""Every query of the core with its SQL twin, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracegrid.plans import captures, features, names, pairs, records, stored, telling, validation

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (features, pairs, names, validation, captures, records, telling, stored)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
