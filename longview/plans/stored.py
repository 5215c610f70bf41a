"""Stored vectors and windows as tables, and the same windows from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators.vectors import VectorStore
from ..sources.keyed import KeyedTable
from ..tables import load


def a13_vectors(spark, sf):
    """The vector store written, opened, extended by a batch and reread: shape and norms by class."""
    v = load(spark, sf, "embeddings")
    path = storage.folder(spark, "vectors")
    VectorStore.create(v.filter("vec_id % 2 = 0").select("vec_id", "embedding"), path)
    store = VectorStore.open(spark, path)
    store.extend(v.filter("vec_id % 2 <> 0").select("vec_id", "embedding"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    rows = store.read().select("id", F.size("v").alias("size"), norm.alias("norm")).join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.min("size").cast("long").alias("dim"), F.count_if(F.abs(F.col("norm") - 1) > 1e-4).alias("off_norm"))


def h1_grains(spark, sf):
    """Counts in tumbling windows of a day and an hour."""
    e = load(spark, sf, "events")
    by = lambda unit: e.groupBy(F.lit(unit).alias("grain"), F.date_trunc(unit, "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    return by("day").unionByName(by("hour"))


def a12_crud(spark, sf):
    """Customers kept by key: created, every tenth renamed and a new one added, every seventh deleted; read with their nation and region."""
    rows = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    table = KeyedTable(spark, storage.folder(spark, "customers"), rows.schema, ["c_custkey"])
    table.upsert(rows)
    table.upsert(rows.filter("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit(" (renamed)"))).unionByName(rows.agg((F.max("c_custkey") + 1).alias("c_custkey"), F.lit("new").alias("c_name"), F.min("c_nationkey").alias("c_nationkey"))))
    table.delete(rows.filter("c_custkey % 7 = 0"))
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table.read().join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


SQL = {
    "a13_vectors": "select label, count(*) as n, min(len(embedding)) as dim, count(*) filter (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) > 1e-4) as off_norm from embeddings where embedding is not null group by 1",
    "h1_grains": "select 'day' as grain, date_trunc('day', ts)::timestamp as start, event_type, count(*) as n from events group by all union all select 'hour', date_trunc('hour', ts)::timestamp, event_type, count(*) from events group by all",
    "a12_crud": "with c as (select c_custkey, case when c_custkey % 10 = 0 then c_name || ' (renamed)' else c_name end as c_name, c_nationkey from customer where c_custkey % 7 <> 0 union all select max(c_custkey) + 1, 'new', min(c_nationkey) from customer) select c_custkey, c_name, n_name, r_name from c join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
}
QUERIES = {name: globals()[name] for name in SQL}
