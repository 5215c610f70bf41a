"""Records that are one by any of several identifiers: components of the graph of records and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage

#: Parts into which the records of one identifier are dealt when they meet its first record.
SALT = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node it is joined with.

    Rounds of large stars and small stars: every node's larger neighbours, then its smaller ones, are tied to its smallest neighbour. Each
    is an aggregate and a join on edges, no node's neighbours meet in one place, and the rounds grow as the logarithm of the
    nodes. They end when a round changes nothing."""
    edges, before = storage.written(edges.filter("a <> b").select("a", "b").distinct(), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = storage.written(large.join(least, "a").select(F.explode(tied).alias("e")).select("e.*").filter("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def same_records(records: DataFrame, keys: dict[str, Column], order: list[Column]) -> DataFrame:
    """records (id, ...) with `duplicate_group`, the id of the record that is kept of all that are joined by equal keys of one kind, directly or over
    others; `kept`; and `size`, how many they are. The kept one is the first by order, then id.

    A null key joins nothing. An identifier that only one record has is left out before anything is joined, and the records of a
    frequent one are dealt to SALT parts, each of which meets its first record."""
    own = records.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in keys.items()))).alias("k"))
    own = storage.written(own.filter("id is not null and k.value is not null").select("id", "k.kind", "k.value"), "identifiers")
    first = own.groupBy("kind", "value").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("kind", "value", "first")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    edges = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(first, ["kind", "value", "salt"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    joined = storage.written(components(edges), "components").withColumnRenamed("node", "id")
    ranked = storage.written(records.select("id", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("id").alias("at")).alias("o")).join(joined, "id"), "ranked")
    groups = storage.written(ranked.groupBy("component").agg(F.min("o")["at"].alias("group"), F.count("*").alias("n")), "groups")
    named = ranked.join(groups, "component").select("id", "group", "n")
    rows = records.join(named, "id", "left")
    return rows.select(*records.columns, F.coalesce("group", "id").alias("duplicate_group"), (F.coalesce("group", "id") == F.col("id")).alias("kept"), F.coalesce("n", F.lit(1)).alias("size"))
