"""Session settings used by the tests, the bench and ad-hoc runs.

Operators never depend on these: they take whatever session they are given.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "assayloom", cpus: int | None = None) -> SparkSession:
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
