"""Deterministic samples by a seeded hash of the id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"))


def stratified(rows: DataFrame, stratum: str, id_column: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """The given number of rows of each stratum."""
    quota = F.lit(0)
    for name, n in sizes.items():
        quota = F.when(F.col(stratum) == name, n).otherwise(quota)
    w = Window.partitionBy(stratum).orderBy(order_key(id_column, seed), id_column)
    ranked = rows.filter(F.col(stratum).isin(list(sizes))).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max(sizes.values(), default=0))
    return ranked.filter(F.col("_k") <= quota).drop("_k")


def floor_and_fill(rows: DataFrame, group: str, id_column: str, floor: int, total: int, seed: int) -> DataFrame:
    """At least floor rows of each group first, then others in hash order up to total, with their place."""
    h = order_key(id_column, seed)
    w = Window.partitionBy(group).orderBy(h, id_column)
    ranked = rows.withColumn("_h", h).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max(floor, total))
    head = ranked.orderBy(F.col("_k") > floor, "_h", id_column).limit(total)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("_k") > floor, "_h", id_column))
    return head.withColumn("place", place).drop("_h", "_k")


def first_per_group(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def allocate(available: dict[str, int], total: int, floor: int = 0, cap: int | None = None, power: float = 1.0) -> dict[str, int]:
    """Shares of total in proportion to available ** power, within floor and cap, leftovers by largest remainder."""
    top = {k: min(n, cap if cap is not None else n) for k, n in available.items()}
    weight = sum(n**power for n in available.values() if n) or 1.0
    exact = {k: total * n**power / weight if n else 0.0 for k, n in available.items()}
    out = {k: min(top[k], max(min(floor, top[k]), math.floor(exact[k]))) for k in available}
    while sum(out.values()) < total:
        open_ = [k for k in out if out[k] < top[k]]
        if not open_:
            break
        out[max(open_, key=lambda k: (exact[k] - out[k], k))] += 1
    return out
