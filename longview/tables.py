"""Tables by name, and the canonical views that operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event timeline: (entity, seq, kind, ts, d, code, value)."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "ts",
        F.to_date("ts").alias("d"), F.get_json_object("props", "$.k").alias("code"), "value",
    )
