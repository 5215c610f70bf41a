"""Greedy acceptance against everything accepted before, in rounds that decide as the row-by-row loop would."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage


def accept(rows: DataFrame, similar: DataFrame, caps: dict[str, int]) -> tuple[DataFrame, int]:
    """(rows (id, place, and a column for each cap) with `accepted`, the number of rounds).

    The loop goes through rows by (place, id) and accepts a row that is like none accepted before, by similar (a, b) of ids, and whose value in
    each capped column has fewer than cap accepted rows; a null value has no cap. Rounds decide the same: a row goes once a better
    row that it is like is accepted or a value of it is full; it is accepted once no better undecided row is like it and in each capped
    column it is among the first cap of the accepted and undecided rows, as none of those can push it out. The best
    undecided row is always one or the other. Counts per value are limits per task before anything is shuffled.
    """
    order = F.struct("place", "id")
    state = storage.written(rows.select("id", "place", *caps).withColumn("state", F.lit(0)), "undecided")
    better = similar.filter("a <> b").select("a", "b").unionByName(similar.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    at = state.select(F.col("id").alias("n"), order.alias("o"))
    better = better.join(at.withColumnRenamed("n", "a").withColumnRenamed("o", "oa"), "a").join(at.withColumnRenamed("n", "b").withColumnRenamed("o", "ob"), "b")
    better = storage.written(better.filter("ob < oa").select(F.col("a").alias("id"), F.col("b").alias("other")), "better")
    rounds = 0
    while not state.filter("state = 0").isEmpty():
        rounds += 1
        open_ = state.filter("state = 0")
        near = better.join(open_.select("id"), "id", "left_semi").join(state.select(F.col("id").alias("other"), F.col("state").alias("s")), "other")
        near = near.groupBy("id").agg(F.max((F.col("s") == 1).cast("int")).alias("beaten"), F.max((F.col("s") == 0).cast("int")).alias("waits"))
        out = open_.join(near, "id", "left").withColumns({"beaten": F.coalesce("beaten", F.lit(0)), "waits": F.coalesce("waits", F.lit(0))})
        for column, cap in caps.items():
            left = state.filter(F.col(column).isNotNull() & (F.col("state") >= 0))
            taken = left.filter("state = 1").groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= cap).select(column, F.lit(1).alias("full"))
            first = left.withColumn("r", F.row_number().over(Window.partitionBy(column).orderBy("place", "id"))).filter(F.col("r") <= cap).select("id", F.lit(1).alias("early"))
            out = out.join(taken, column, "left").join(first, "id", "left")
            out = out.withColumns({"beaten": F.greatest("beaten", F.coalesce("full", F.lit(0))), "waits": F.greatest("waits", (F.col("early").isNull() & F.col(column).isNotNull()).cast("int"))}).drop("full", "early")
        decided = F.when(F.col("beaten") == 1, -1).when(F.col("waits") == 0, 1).otherwise(0).cast("int")
        out = out.select("id", "place", *caps, decided.alias("state"))
        state = storage.written(reduce(DataFrame.unionByName, [state.filter("state <> 0"), out]), "undecided")
    return rows.join(state.select("id", (F.col("state") == 1).alias("accepted")), "id"), rounds
