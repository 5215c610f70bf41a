"""Differences of two tables by trees of digests: only buckets whose digests differ are read.

A table's rows are dealt to 2^BITS buckets by a hash of their key, in partitions of their own. A bucket's digest doesn't depend on the order of
its rows: their number, and the exclusive or and the sum of their hashes over all columns. Sums of two buckets' digests are the digest of
the node above, up to the root, so two tables are compared from the root down, and rows are read where leaves differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 6


def write(table: DataFrame, keys: list[str], path: str, bits: int = BITS) -> None:
    """table under path/rows by bucket, and its tree (level, node, n, x, s) under path/tree; keys name each row once."""
    rows = table.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(1 << bits)).cast("int"))
    rows.repartition("_bucket", F.pmod(F.hash(*keys), F.lit(8))).write.partitionBy("_bucket").parquet(f"{path}/rows")
    kept = table.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    names = sorted(table.columns)
    # a null and the text that stands for it mustn't be alike, so each value comes with whether it is there
    h = F.xxhash64(*(x for c in names for x in (F.col(c).isNull(), F.col(c))))
    leaf = kept.select("_bucket", h.alias("h")).groupBy("_bucket").agg(F.count("*").alias("n"), F.expr("bit_xor(h)").alias("x"), F.expr("sum(cast(h as decimal(20,0)))").cast("decimal(38,0)").alias("s"))
    leaf = leaf.withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda i: F.struct((F.lit(bits) - i).alias("level"), F.call_function("shiftright", F.col("_bucket"), i).alias("node")))))
    tree = leaf.groupBy("path.level", "path.node").agg(F.sum("n").alias("n"), F.expr("bit_xor(x)").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s"))
    tree.coalesce(1).write.parquet(f"{path}/tree")


def differing_buckets(spark: SparkSession, left: str, right: str) -> list[int]:
    """The buckets whose digests differ, found from the root down: a level's nodes are read where their parent differs."""
    trees = [spark.read.parquet(f"{p}/tree") for p in (left, right)]
    bits = max(t.agg(F.max("level")).first()[0] or 0 for t in trees)
    nodes = [0]
    for level in range(bits + 1):
        a, b = (t.filter((F.col("level") == level) & F.col("node").isin(nodes)).select("node", F.struct("n", "x", "s").alias(name)) for t, name in zip(trees, "ab", strict=True))
        unlike = sorted(r["node"] for r in a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).collect())  # 2^bits at most
        if level == bits or not unlike:
            return unlike
        nodes = [x for n in unlike for x in (2 * n, 2 * n + 1)]
    return []


def differences(spark: SparkSession, left: str, right: str, keys: list[str]) -> DataFrame:
    """(keys, column, left, right) of each cell that differs, values as text; a row that one side lacks has one line, of column `-`, with
    `present` on the other. Only differing buckets are read."""
    buckets = differing_buckets(spark, left, right)
    a, b = (spark.read.parquet(f"{p}/rows").filter(F.col("_bucket").isin(buckets) if buckets else F.lit(False)).drop("_bucket") for p in (left, right))
    columns = [c for c in a.columns if c not in keys]
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("tables have the same columns")
    side = lambda df, name: df.select(*keys, F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias(name))
    met = side(a, "a").join(side(b, "b"), keys, "full_outer")
    lone = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.struct(F.lit("-").alias("column"), F.when(F.col("a").isNotNull(), "present").alias("left"), F.when(F.col("b").isNotNull(), "present").alias("right"))))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("left"), F.col(f"b.{c}").alias("right")) for c in columns))
    unlike = F.filter(cells, lambda x: ~x["left"].eqNullSafe(x["right"]))
    return met.select(*keys, F.explode(F.coalesce(lone, unlike)).alias("d")).select(*keys, "d.*")


def frozen(spark: SparkSession, table: DataFrame, path: str, keys: list[str], folder: str) -> None:
    """Raises where table is no longer what was written under path; its own tree goes to folder."""
    write(table, keys, folder)
    buckets = differing_buckets(spark, path, folder)
    if buckets:
        found = differences(spark, path, folder, keys).limit(5).collect()
        raise ValueError(f"{len(buckets)} buckets differ, such as " + "; ".join(str(tuple(r)) for r in found))
