"""Streaming queries run over all there is, and equal to the same aggregation in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..streaming import windows as W


def _folder(spark) -> str:
    return storage.folder(spark, "stream")


def _events(spark, sf):
    return spark.readStream.schema(W.EVENTS).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf)


def h5_daily(spark, sf):
    return W.run_available(W.daily_counts(_events(spark, sf)), _folder(spark), "complete").select(F.col("start"), "user_id", "event_type", "n")


def h5_sliding(spark, sf):
    return W.run_available(W.sliding_counts(_events(spark, sf), "2 days", "1 day"), _folder(spark), "complete").select("start", "event_type", "n")


def h5_moves(spark, sf):
    return W.run_available(W.moves(_events(spark, sf)), _folder(spark)).select("user_id", "ts", "previous", "current")


SQL = {
    "h5_daily": "select date_trunc('day', ts)::timestamp as start, user_id, event_type, count(*) as n from events group by all",
    "h5_sliding": "select start, event_type, count(*) as n from (select event_type, unnest([date_trunc('day', ts)::timestamp - case when epoch(date_trunc('day', ts)) is not null then interval 1 day end, date_trunc('day', ts)::timestamp]) as start from events) group by all",
    "h5_moves": "select user_id, ts, previous, current from (select user_id, ts, event_type as current, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) where previous is distinct from current",
}
QUERIES = {name: globals()[name] for name in SQL}
