"""Sessions with the settings the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "longview", cores: int | None = None) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow; local where no master is configured."""
    n = cores or os.cpu_count() or 8
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{n}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(n))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
