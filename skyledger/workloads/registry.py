"""Where registered queries and their SQL twins live."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Workload:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


WORKLOADS: dict[str, Workload] = {}


def workload(name: str, covers: str, sql: str | None = None):
    """Register run(tables) under a name, with the survey ids it covers and its SQL twin."""

    def register(fn):
        if name in WORKLOADS:
            raise ValueError(f"duplicate workload {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from skyledger.workloads.bindings import Tables

            return fn(Tables(spark, sf_dir))

        WORKLOADS[name] = Workload(name, covers, run, sql.strip() if sql else None)
        return fn

    return register
