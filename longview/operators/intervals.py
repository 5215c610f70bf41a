"""The interval that holds a point, with what stands in where none does.

Days are numbered, and each interval is cut into the dyadic blocks that cover it exactly: at most two of each size, however long it
is. Of the intervals that cover a block only the first in order is kept, so a point lies in at most one
for each size of block. Blocks of TIER sizes lie together, and a point meets one row for each tier by an equi-join on (entity, tier, region): neither long intervals, many overlapping
ones nor an entity with a third of all rows makes pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

#: Sizes of blocks: 2^0 to 2^(LEVELS - 1) days, which is more than a calendar's range.
LEVELS = 23
#: Sizes of blocks that are looked up together.
TIER = 8
#: Days of a band in which windows are carried on.
BAND = 256


def blocks(first: Column, last: Column) -> Column:
    """The dyadic blocks, as (level, block), that cover the whole numbers from first to last exactly."""
    def of(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        a, b = F.ceil(first / size).cast("long"), (F.floor((last + 1) / size) - 1).cast("long")
        block = lambda x: F.struct(level.cast("int").alias("level"), x.alias("block"))
        left = F.when((a <= b) & (F.pmod(a, F.lit(2)) == 1), block(a))
        right = F.when((a <= b) & (F.pmod(b, F.lit(2)) == 0), block(b))
        return F.array(left, right)

    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of))))


def containing(points: DataFrame, windows: DataFrame, carried: bool = False) -> DataFrame:
    """points (entity, at, ...) with `window` and `how`: CONTAINS, the first of windows (entity, first, last, window, gap) by (first, window) that
    holds the day, ends included; else LAST_KNOWN, the entity's latest one that is no gap; else LAST, its latest; else null.

    With carried the last two look no further than the point: the latest that begins on or before it. An end that is null is
    open; a window that ends before it begins holds nothing; a point without entity or day, and an entity without windows,
    get null.
    """
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    span = points.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    rows = windows.filter("entity is not null").select("entity", "first", "last", "window", "gap")
    # an open end lies at the first or last day that is asked for
    lo, hi = F.coalesce(days(F.col("first")), days(F.lit(span["lo"]).cast("date"))), F.coalesce(days(F.col("last")), days(F.lit(span["hi"]).cast("date")))
    order = F.struct(F.coalesce(days(F.col("first")), F.lit(-(1 << 40))).alias("f"), "window")
    # blocks of TIER sizes lie together by the region, of the next tier's size, that holds them: some 2^(TIER + 1) at most
    size = lambda n: F.pow(F.lit(2.0), n)
    tier = F.floor(F.col("level") / TIER).cast("int")
    cut = rows.select("entity", order.alias("o"), F.explode(blocks(lo, hi)).alias("b")).select("entity", "o", "b.level", "b.block")
    cut = cut.select("*", tier.alias("tier"), F.floor(F.col("block") / size((tier + 1) * TIER - F.col("level"))).cast("long").alias("region"))
    keys = ["entity", "tier", "region"]
    held = cut.repartition(*keys).groupBy(*keys, "level", "block").agg(F.min("o").alias("o"))  # dealt once for both aggregations
    held = storage.written(held.groupBy(*keys).agg(F.collect_list(F.struct("level", "block", "o")).alias("blocks")), "regions")
    tiers = sorted(r[0] for r in held.select("tier").distinct().collect())  # LEVELS at most
    keyed = storage.written(points.select(F.struct(*points.columns).alias("point"), "entity", "at", F.monotonically_increasing_id().alias("id")), "points")
    regions = F.transform(F.array(*map(F.lit, tiers)) if tiers else F.array().cast("array<int>"), lambda n: F.struct(n.alias("tier"), F.floor(F.col("day") / size((n + 1) * TIER)).cast("long").alias("region")))
    met = keyed.filter("entity is not null and at is not null").select("id", "entity", days(F.col("at")).alias("day")).select("id", "entity", "day", F.explode(regions).alias("r"))
    met = met.select("id", "entity", "day", "r.tier", "r.region").join(held, ["entity", "tier", "region"])
    of = F.filter("blocks", lambda b: b["block"] == F.floor(F.col("day") / size(b["level"])).cast("long"))
    found = met.select("id", F.array_min(F.transform(of, lambda b: b["o"])).alias("o")).filter("o is not null")
    found = found.groupBy("id").agg(F.min("o").alias("o")).select("id", F.col("o.window").alias("held"))
    out = keyed.join(found, "id", "left")
    if carried:
        other = _carried(keyed, rows, days)
        out = out.join(other, "id", "left")
    else:
        place = F.struct(F.coalesce(days(F.col("first")), F.lit(-(1 << 40))).alias("f"), "window")
        latest = rows.groupBy("entity").agg(F.max(F.when(~F.col("gap"), place))["window"].alias("known"), F.max(place)["window"].alias("latest"))
        out = out.join(latest, "entity", "left").withColumns({c: F.when(F.col("at").isNotNull(), F.col(c)) for c in ("known", "latest")})
    how = F.when(F.col("held").isNotNull(), "CONTAINS").when(F.col("known").isNotNull(), "LAST_KNOWN").when(F.col("latest").isNotNull(), "LAST")
    return out.select("point.*", F.coalesce("held", "known", "latest").alias("window"), how.alias("how"))


def _carried(keyed: DataFrame, rows: DataFrame, days) -> DataFrame:
    """(id, known, latest): the latest non-gap window, and the latest, that begin on or before each point. Bands of BAND days are
    gone through each on its own, and what a band ends with is carried to the next ones."""
    begin = F.coalesce(days(F.col("first")), F.lit(-(1 << 40)))
    place = F.struct(begin.alias("f"), "window")
    starts = rows.select("entity", begin.alias("day"), F.lit(None).cast("long").alias("id"), place.alias("any"), F.when(~F.col("gap"), place).alias("good"))
    asked = keyed.filter("entity is not null and at is not null").select("entity", days(F.col("at")).alias("day"), "id", F.lit(None).cast(starts.schema["any"].dataType).alias("any"), F.lit(None).cast(starts.schema["good"].dataType).alias("good"))
    both = starts.unionByName(asked).withColumn("band", F.floor(F.col("day") / BAND))
    ends = storage.written(both.groupBy("entity", "band").agg(F.max("any").alias("any"), F.max("good").alias("good")), "bands")
    before = Window.partitionBy("entity").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("entity", "band", F.max("any").over(before).alias("any0"), F.max("good").over(before).alias("good0"))
    within = Window.partitionBy("entity", "band").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    inner = both.withColumns({"any": F.max("any").over(within), "good": F.max("good").over(within)}).filter("id is not null")
    met = inner.join(ends, ["entity", "band"], "left")
    return met.select("id", F.coalesce(F.col("good.window"), F.col("good0.window")).alias("known"), F.coalesce(F.col("any.window"), F.col("any0.window")).alias("latest"))
