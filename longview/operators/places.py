"""Places and running sums in a total order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, order: list[str], name: str = "place", weight: str | None = None, parts: int = 64, sample: int = 8192) -> DataFrame:
    """rows with the running sum of weight (without one: the place from 1) in ascending order, nulls first.

    The order must be total. Rows are dealt to parts bands at cuts of a sample that is bounded by its parameter; sums of
    the bands before are added to those within one. The cuts decide how even the bands are, never a result. rows is
    read three times, so it should be a table or written.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    some = [tuple(r) for r in rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(sample).collect()]
    some.sort(key=lambda r: [(x is not None, x) for x in r])
    cuts = list(dict.fromkeys(some[i * len(some) // parts] for i in range(1, parts))) if some else []
    kinds = [rows.schema[c].dataType for c in order]
    cut = lambda r: F.struct(*(F.lit(x).cast(k).alias(c) for x, k, c in zip(r, kinds, order, strict=True)))
    key = F.struct(*(F.col(c) for c in order))
    band = F.size(F.filter(F.array(*map(cut, cuts)), lambda c: key >= c)) if cuts else F.lit(0)
    banded = rows.withColumn("_band", band)
    earlier = Window.partitionBy(F.lit(1)).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # parts rows at most
    before = banded.groupBy("_band").agg(F.sum(w).alias("_n")).select("_band", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_band").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return banded.join(F.broadcast(before), "_band").withColumn(name, F.sum(w).over(inside) + F.col("_before")).drop("_band", "_before")


def exclusive_quantiles(rows: DataFrame, group: str, value: str, key: str, n: int) -> DataFrame:
    """(group, i, q): the n - 1 cut points of each group by the exclusive method, at i * (size + 1) / n; a single
    value is every point. Null values are left out; rows is a table or written, key makes the order total."""
    rows = rows.filter(F.col(value).isNotNull()).select(group, value, key)
    earlier = Window.partitionBy(F.lit(1)).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    sizes = rows.groupBy(group).agg(F.count("*").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    at = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n - 1)))).withColumn("pos", F.col("i") * (F.col("size") + 1))
    at = at.withColumn("j", F.greatest(F.lit(1), F.least(F.floor(F.col("pos") / n), F.col("size") - 1)))
    more = F.when(F.col("size") == 1, F.lit(0)).otherwise(F.col("pos") - n * F.col("j"))
    wanted = at.select(F.col(group).alias("_group"), "i", F.explode(F.array(
        F.struct((F.col("start") + F.col("j")).alias("place"), (n - more).alias("part")), F.struct((F.col("start") + F.col("j") + 1).alias("place"), more.alias("part")),
    )).alias("w")).select("_group", "i", "w.place", "w.part")
    placed = running(rows, [group, value, key])
    met = placed.join(wanted, (placed["place"] == wanted["place"]) & placed[group].eqNullSafe(wanted["_group"]))
    return met.groupBy(group, "i").agg(F.round(F.sum(F.col(value) * F.col("part")) / n, 6).alias("q"))
