"""The longitudinal operators over a stream of events: windowed counts, sessions and each entity's last state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per entity, day and type. Rows later than delay behind the newest are left out; a day is final, and
    is given out in append mode, when the watermark passes its end."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "user_id", "event_type", "n", "total")


def sliding_counts(events: DataFrame, size: str, step: str, delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str, delay: str = "1 day") -> DataFrame:
    """Runs of an entity's events with no pause of gap or more."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _moves(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    for t, kind in zip(rows["ts"], rows["event_type"], strict=True):
        if kind != last:
            out.append((key[0], t, last, kind))
        last = kind
    state.update((last,))
    yield pd.DataFrame(out, columns=["user_id", "ts", "previous", "current"])


def moves(events: DataFrame) -> DataFrame:
    """A row whenever an entity's event type differs from its one before, over batches too; the state is one
    value per entity."""
    return events.groupBy("user_id").applyInPandasWithState(_moves, "user_id long, ts timestamp, previous string, current string", "last string", "append", GroupStateTimeout.NoTimeout)


def run_available(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that is there, written by batches under path and read back: in complete mode the last batch, else all."""
    upsert(rows, f"{path}/out", f"{path}/checkpoint", mode)
    out = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/out/*")
    if mode == "complete":
        number = F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long")
        last = out.select(F.max(number).alias("last"))  # one row
        out = out.withColumn("number", number).crossJoin(F.broadcast(last)).filter("number = last").drop("number", "last")
    return out


def upsert(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Batches to Parquet folders by their number: a batch that is run again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
