"""Joins, profiles, set operations, samples and rule tables over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import care_state as cs
from ..operators import profiles as P
from ..operators.places import exclusive_quantiles
from ..operators.sampling import first_per_group, floor_and_fill, stratified
from ..tables import load, timeline

AS_OF, HORIZON = "1998-01-01", 30


def b12_age(spark, sf):
    """Days, whole years and rate per year between a customer's first and last order."""
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"), F.count("*").alias("n"))
    days = V.days_between(F.col("lo"), F.col("hi"))
    return o.select("o_custkey", V.age(F.col("lo"), F.lit("2010-01-01").cast("date")).cast("long").alias("age"), days.cast("long").alias("days"), V.per_year(F.col("n"), days).alias("per_year"))


def b7_casts(spark, sf):
    """Lenient readings of a text column: of a number, of an integer, of a date."""
    rows = timeline(spark, sf).select("seq", F.when(F.col("seq") % 7 == 0, "n/a").when(F.col("seq") % 7 == 1, " ").otherwise(F.concat(F.lit(" "), F.col("code"), F.lit(".0"))).alias("raw"), F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T23:00:00-05:00")).alias("stamp"))
    return rows.select("seq", V.safe_float(F.col("raw")).alias("as_float"), V.safe_int(F.col("raw"), -1).alias("as_int"), V.clean_string(F.col("raw")).alias("as_text"), V.local_date(F.col("stamp")).alias("as_date"))


def b4_coalesce(spark, sf):
    """The first given date of several with its source, as counts."""
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ship = F.when(F.col("l_linenumber") % 3 == 0, None).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    picked = V.first_given(shipped=ship, ordered=F.when(F.col("l_linenumber") % 2 == 0, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), fallback=F.lit("1990-01-01"))
    return rows.select(picked.alias("p")).groupBy(F.col("p.source").alias("source")).agg(F.count("*").alias("n"), F.min("p.value").alias("first"), F.max("p.value").alias("last"))


def b8_reference(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Medication/"), F.col("p_partkey").cast("string"))).otherwise(F.lit("urn:uuid:0a1b2c3d-0000-4000-8000-000000000001")).alias("ref"))
    return rows.select("p_partkey", V.reference_id(F.col("ref")).alias("id"), V.is_uuid(F.col("ref")).alias("is_uuid"))


def b35_signature(spark, sf):
    """One digest for each customer's orders, whatever their order in the table."""
    rows = load(spark, sf, "orders").select("o_custkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("h"))
    return rows.groupBy("o_custkey").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("signature"))


def c1_lookup(spark, sf):
    """Items with their part's name where the key resolves, else the key."""
    items = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    parts = load(spark, sf, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return items.join(parts, "l_partkey", "left").select("l_partkey", F.coalesce("p_name", F.col("l_partkey").cast("string")).alias("name"), "qty", "n")


def c3_asof(spark, sf):
    """Each order's last shipping date placed in a yearly window of its customer: the one that holds it, else the last with orders.

    The year is the equi-key that a range comparison would lack.
    """
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    active = orders.groupBy("o_custkey", "y").agg(F.count("*").alias("n"))
    last = active.groupBy("o_custkey").agg(F.max("y").alias("last_y"))
    ships = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship")).select(F.col("l_orderkey").alias("o_orderkey"), F.year("ship").alias("ship_y"))
    points = orders.drop("y").join(ships, "o_orderkey")
    hit = points.join(active.select("o_custkey", F.col("y").alias("ship_y"), F.col("y").alias("hit_y")), ["o_custkey", "ship_y"], "left").join(last, "o_custkey")
    return hit.select("o_orderkey", "o_custkey", "ship_y", F.coalesce("hit_y", "last_y").alias("window_y"), F.when(F.col("hit_y").isNull(), "LAST").otherwise("CONTAINS").alias("how"))


def c10_anti(spark, sf):
    missing = load(spark, sf, "customer").join(load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return missing.groupBy("c_nationkey").agg(F.count("*").alias("without_orders"))


def c13_mapping(spark, sf):
    items = load(spark, sf, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 12, "0").alias("external"), "l_quantity")
    sums = items.groupBy("external").agg(F.sum("l_quantity").alias("qty"))
    known = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name")
    return sums.join(known, V.without_zeros(F.col("external")) == F.col("id"), "left").select("external", "s_name", "qty")


def c14_crosscheck(spark, sf):
    """Nullable equality of a stored size with the text's own, by language."""
    docs = load(spark, sf, "documents")
    same = F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.col("n_chars") == F.length("text"))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(same).alias("equal"), F.count_if(~same).alias("unequal"), F.count_if(same.isNull()).alias("unknown"))


def c15_fk(spark, sf):
    orders, items = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    known = orders.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    orphans = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return known.agg(F.count("*").alias("n")).select(F.lit("orders_with_customer").alias("check"), "n").union(orphans.agg(F.count("*")).select(F.lit("items_without_order"), "*"))


def d3_distinct_list(spark, sf):
    return P.distinct_list(timeline(spark, sf))


def d4_latest(spark, sf):
    return P.code_summary(timeline(spark, sf))


def d6_profile(spark, sf):
    return P.profile(timeline(spark, sf)).select("entity", "first_date", "last_date", "events", "dated", "codes", "purchases", "kinds", F.col("span_days").cast("long"), "per_year")


def d7_stats(spark, sf):
    return P.numeric_stats(timeline(spark, sf), "kind")


def d8_status(spark, sf):
    rows = load(spark, sf, "orders").withColumn("s", F.lower("o_orderstatus"))
    return rows.groupBy("o_custkey").agg(F.count_if(F.col("s") == "o").alias("active"), F.count_if(F.col("s") == "f").alias("completed"), F.countDistinct("o_orderpriority").alias("names"), F.min(F.to_date("o_orderdate")).alias("first_date"), F.max(F.to_date("o_orderdate")).alias("last_date"))


def d9_trailing(spark, sf):
    return P.trailing(timeline(spark, sf), 7)


def d11_explode(spark, sf):
    """Counts of each label of a comma-separated list."""
    rows = load(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def d12_quantile_excl(spark, sf):
    """Quartiles by the exclusive method: position p * (n + 1)."""
    rows = exclusive_quantiles(load(spark, sf, "events"), "event_type", "value", "event_id", 4)
    return rows.groupBy("event_type").agg(*(F.max(F.when(F.col("i") == q, F.col("q"))).alias(f"q{q}") for q in (1, 2, 3)))


def d12_deciles(spark, sf):
    """The cut points of ten and of twenty parts by the same method."""
    e = load(spark, sf, "events")
    cut = lambda n: exclusive_quantiles(e, "event_type", "value", "event_id", n).select(F.lit(n).alias("parts"), "event_type", "i", "q")
    return cut(10).unionByName(cut(20))


def d18_distinct(spark, sf):
    return timeline(spark, sf).groupBy("kind").agg(F.countDistinct("entity").alias("entities"), F.countDistinct("code").alias("codes"), F.countDistinct("d").alias("days"))


def d22_reconcile(spark, sf):
    """Totals of per-entity counts against the source's own; a difference is a violation."""
    counts = cs.window_counts(timeline(spark, sf)).agg(F.sum("total").alias("total"), *(F.sum(k).alias(k) for k in cs.KINDS))
    source = timeline(spark, sf).agg(F.count("*").alias("s_total"), *(F.count_if(F.col("kind") == v).alias(f"s_{k}") for k, v in cs.KINDS.items()))
    names = ["total", *cs.KINDS]
    pairs = ", ".join(f"'{n}', {n}, s_{n}, {n} - s_{n}" for n in names)
    return counts.crossJoin(source).selectExpr(f"stack({len(names)}, {pairs}) as (name, counted, in_source, difference)")  # one row each


def d24_inventory(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("ts").alias("dated"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def e11_keep_first(spark, sf):
    """One part for each name: the smallest size, then key. Both come from one aggregate, so no name's parts meet in one task."""
    first = F.min(F.struct(F.col("p_size").isNull(), "p_size", "p_partkey"))["p_partkey"]
    return load(spark, sf, "part").groupBy("p_name").agg(first.alias("p_partkey"), F.count("*").alias("duplicates"))


def e13_order(spark, sf):
    """Where an entity's times fall back in the order of its events."""
    w = Window.partitionBy("entity").orderBy("seq")
    rows = timeline(spark, sf).select("entity", "ts", F.lag("ts").over(w).alias("before"))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("before")).alias("falls"))


def f1_sort(spark, sf):
    rows = load(spark, sf, "orders").orderBy(F.col("o_custkey"), F.col("o_orderdate").desc_nulls_last(), "o_orderpriority", "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderpriority")


def f2_top(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)
    return rows


def f3_stratified(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    return stratified(docs, "lang", "doc_id", {"en": 11, "de": 4, "fr": 5}, 42)


def f4_floor_fill(spark, sf):
    return floor_and_fill(load(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 2, 20, 42)


def f5_first_n(spark, sf):
    return first_per_group(load(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 2)


def f7_reserve(spark, sf):
    """The 50 dearest orders are primary, all others are the reserve. Places are counted within bands of prices, after
    the orders of dearer bands, so no partition sorts all orders."""
    band = F.coalesce(F.floor(F.col("o_totalprice").cast("double") / 256), F.lit(-(1 << 62)))  # orders without a price come last
    rows = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", band.alias("band"))
    before = Window.partitionBy(F.lit(1)).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("band").agg(F.count("*").alias("n")).select("band", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("dearer"))
    within = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = rows.withColumn("k", within).join(bands, "band").select("o_orderkey", "o_totalprice", (F.col("dearer") + F.col("k")).alias("place"))
    return rows.withColumn("part", F.when(F.col("place") <= 50, "PRIMARY").otherwise("RESERVE"))


def g1_union_latest(spark, sf):
    """Prior and new records with the newest of each key."""
    e = load(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    both = e.filter("event_id % 2 = 0").withColumn("origin", F.lit("prior")).unionByName(e.filter("event_id % 2 = 1").withColumn("origin", F.lit("new")))
    return both.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value", "origin"), "event_id").alias("x")).select("user_id", "event_type", "x.*")


def g2_union_distinct(spark, sf):
    c, s = load(spark, sf, "customer"), load(spark, sf, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).union(s.select("s_nationkey")).distinct()


def g3_intersect(spark, sf):
    o = load(spark, sf, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey").intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


def g4_except(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_custkey", "o_orderpriority").filter("o_orderstatus = 'O'").exceptAll(o.select("o_custkey", "o_orderpriority").filter("o_orderstatus = 'F'"))


def g5_dupes(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).filter("n > 1")


def h3_horizon(spark, sf):
    """Orders from a day on, for 30 days."""
    day = F.to_date("o_orderdate")
    rows = load(spark, sf, "orders").filter(day.between(F.lit(AS_OF).cast("date"), F.date_add(F.lit(AS_OF).cast("date"), HORIZON)))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("upcoming"))


# fixed values: weights of an entity's percentile features in each dimension, and of dimensions in the overall score, in hundredths
ENTITY = {
    "medication": {"purchase_codes": 45, "recent_purchase": 40, "purchases": 15},
    "clinical": {"dated": 25, "rate": 30, "clicks": 30, "procedures": 15},
    "observation": {"views": 35, "view_codes": 25, "recent_view": 40},
    "encounter": {"clicks": 45, "recent_click": 55},
    "condition": {"error_codes": 35, "errors": 25, "error_days": 25, "recent_error": 15},
    "recent": {"recent": 25, "recent_purchase": 15, "recent_view": 25, "recent_error": 15, "recent_click": 20},
    "complexity": {"error_codes": 25, "purchase_codes": 20, "clicks": 20, "view_codes": 15, "procedures": 10, "reports": 10},
    "preventive": {"signups": 60, "care_plans": 40},
}
ENTITY_OVERALL = {"medication": 10, "clinical": 15, "observation": 10, "encounter": 15, "condition": 15, "recent": 20, "complexity": 10, "preventive": 5}
#: No event kind stands for these; each counts 0 for everyone.
_ABSENT = ["procedures", "reports", "care_plans"]
_FEATURES = [f for f in dict.fromkeys(f for parts in ENTITY.values() for f in parts) if f not in _ABSENT]
_KIND = {"purchase": "purchases", "click": "clicks", "view": "views", "error": "errors", "signup": "signups"}


def k2_entity_state(spark, sf):
    """An entity's eight dimensions from percentile features, and its state as a whole. Ranks, dimensions and score are
    whole ten-thousandths, rounded half up, so that no sum of doubles decides a digit."""
    t = timeline(spark, sf)
    w = Window.partitionBy("entity")
    is_ = {k: F.col("kind") == k for k in _KIND}
    late = F.col("d") >= F.date_sub(F.col("last"), 7)
    span = F.datediff(F.max("d"), F.min("d")).cast("long")
    rows = t.withColumn("last", F.max("d").over(w)).groupBy("entity").agg(
        F.count("d").alias("dated"), F.when(span > 0, F.floor((F.count("*") * 73050 + span) / (2 * span))).otherwise(0).cast("long").alias("rate"), F.count_if(late).alias("recent"),
        *(F.count_if(is_[k]).alias(n) for k, n in _KIND.items()), *(F.count_if(is_[k] & late).alias(f"recent_{k}") for k in ("purchase", "view", "error", "click")),
        *(F.countDistinct(F.when(is_[k], F.col("code"))).alias(f"{k}_codes") for k in ("purchase", "view", "error")), F.countDistinct(F.when(is_["error"], F.col("d"))).alias("error_days"),
    )
    ranks = cs.percentile_points(rows, ["entity"], _FEATURES, _ABSENT)
    whole = lambda parts: F.floor((sum((F.col(n) * w for n, w in parts.items()), F.lit(0)) + 50) / 100).cast("long")
    dims = ranks.select("entity", *(whole({f"p_{f}": w for f, w in parts.items()}).alias(n) for n, parts in ENTITY.items())).withColumn("overall", whole(ENTITY_OVERALL))
    dims = dims.select("entity", *((F.col(n) / F.lit(10000.0)).alias(n) for n in (*ENTITY, "overall")))
    return dims.withColumn("state", cs.entity_state(F.col("overall"), F.col("recent"), F.col("complexity")))


def _steps(x, cuts, low):
    out = F.lit(low)
    for at, score in reversed(cuts):
        out = F.when(x >= at, score).otherwise(out)
    return out


def _realtime(spark, sf, o, coming):
    facts = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("meds"), F.countDistinct("o_orderpriority").alias("conds"))
    talk = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("o_custkey")).agg(F.count("*").alias("messages"))
    rows = facts.join(coming, "o_custkey", "left").join(talk, "o_custkey", "left").fillna(0, ["upcoming", "messages"])
    rows = rows.withColumn("years", F.col("o_custkey") % 60 + 40)
    burden = [(5, 0.85), (3, 0.55), (1, 0.30)]
    boost = _steps(F.col("years"), [(85, 0.25), (75, 0.15), (65, 0.05)], 0.0)
    rows = rows.withColumns({
        "medication": _steps(F.col("meds"), burden, 0.10), "condition": _steps(F.col("conds"), burden, 0.10),
        "encounter": _steps(F.col("upcoming"), [(2, 0.80), (1, 0.50)], 0.10),
        "complexity": F.least(F.lit(1.0), (F.col("conds") + F.col("meds")) / F.lit(8.0) + boost),
        "interaction": _steps(F.col("messages"), [(6, 0.75), (2, 0.50), (1, 0.25)], 0.15),
    })
    score = F.round(F.col("medication") * 0.25 + F.col("condition") * 0.25 + F.col("encounter") * 0.20 + F.col("complexity") * 0.20 + F.col("interaction") * 0.10, 4)
    low = F.greatest("medication", "condition", "encounter", "complexity", "interaction") < 0.4
    rows = rows.withColumn("score", score)
    state = F.when((F.col("score") < 0.35) & low, "STABLE").when(F.col("score") < 0.40, "LOW_ACTIVITY").when(F.col("score") < 0.60, "MODERATE_ACTIVITY").otherwise("HIGH_ACTIVITY")
    return rows.select("o_custkey", "medication", "condition", "encounter", "complexity", "interaction", "score", state.alias("state"))


def k7_realtime(spark, sf):
    """A customer's state from counts of medications, conditions, coming appointments and messages."""
    return _realtime(spark, sf, load(spark, sf, "orders"), h3_horizon(spark, sf))


def k7_moves(spark, sf):
    """Each customer's state now beside the one from orders before the day, without coming ones: type, direction and size of the move."""
    o = load(spark, sf, "orders")
    past = o.filter(F.to_date("o_orderdate") < F.lit(AS_OF).cast("date"))
    none = h3_horizon(spark, sf).filter(F.lit(False))
    before = _realtime(spark, sf, past, none).select("o_custkey", F.col("state").alias("previous"), F.col("score").alias("previous_score"))
    both = k7_realtime(spark, sf).select("o_custkey", "state", "score").join(before, "o_custkey", "left")
    move = cs.realtime_move(F.col("previous"), F.col("state"), F.col("previous_score"), F.col("score"))
    return both.select("o_custkey", "previous", "state", *(c.alias(n) for n, c in move.items()))


def k9_reminders(spark, sf):
    """Reminders of two kinds in one list."""
    o = load(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'O'").select(F.lit("medication").alias("kind"), "o_custkey", F.col("o_orderkey").alias("id"), "o_orderpriority")
    b = o.filter(F.to_date("o_orderdate") >= F.lit("2000-01-01").cast("date")).select(F.lit("appointment").alias("kind"), "o_custkey", F.col("o_orderkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


def m1_quality(spark, sf):
    """Checks of the timeline: nulls, order, repeats, coverage."""
    t = timeline(spark, sf)
    one = t.agg(F.count("*").alias("rows"), F.count_if(F.col("entity").isNull()).alias("null_entity"), F.count_if(F.col("d").isNull()).alias("null_date"), F.count_if(F.col("code").isNull()).alias("null_code"), F.countDistinct("entity").alias("entities"))
    again = t.groupBy("seq").count().filter("count > 1").agg(F.count("*").alias("repeated_ids"))
    names = ["rows", "null_entity", "null_date", "null_code", "entities", "repeated_ids"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return one.crossJoin(again).selectExpr(f"stack({len(names)}, {pairs}) as (name, n)")  # one row each


_T = "with t as (select user_id as entity, event_id as seq, event_type as kind, ts, cast(ts as date) as d, json_extract_string(props, '$.k') as code, value from events)"
_RECENT = ", ".join(f"count(*) filter (kind = '{k}') as recent_{k}" for k in ("view", "click", "error", "purchase", "signup"))
_LAST = "l as (select *, max(d) over (partition by entity) as last from t)"


def _rank_sql(f: str) -> str:
    return f"round(case when count(*) over () > 1 then (count(*) over (order by {f}::double range between unbounded preceding and current row) - 1)::double / (count(*) over () - 1) else 0.0 end, 4) as p_{f}"


def _points_sql(f: str) -> str:
    return f"case when count(*) over () > 1 then ((count(*) over (order by {f} range between unbounded preceding and current row) - 1) * 20000 + count(*) over () - 1) // (2 * (count(*) over () - 1)) else 0 end as p_{f}"


def _cuts(n: int) -> str:
    """The cut points of n parts of each kind's values k = 1 to n of table r."""
    j = f"greatest(1, least((i * (n + 1)) // {n}, n - 1))"
    more = f"case when n = 1 then 0 else i * (n + 1) - {n} * {j} end"
    return f"select {n} as parts, event_type, i, round(sum(case when k = {j} then value * ({n} - {more}) when k = {j} + 1 then value * {more} end) / {n}, 6) as q from r, (select unnest(range(1, {n})) as i) group by event_type, i"


_R = "with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as k, count(*) over (partition by event_type) as n from events where value is not null)"


def _steps_sql(x: str, cuts, low) -> str:
    return "case " + " ".join(f"when {x} >= {a} then {s}::double" for a, s in cuts) + f" else {low}::double end"


_BURDEN = [(5, 0.85), (3, 0.55), (1, 0.30)]
_LEVELS = str(cs.REALTIME)


def _realtime_sql(which: str) -> str:
    return f"""with f as (select o_custkey, count(*) filter (o_orderstatus = 'O') as meds, count(distinct o_orderpriority) as conds, count(*) filter (o_orderdate::date between date '{AS_OF}' and date '{AS_OF}' + {HORIZON}) as upcoming from orders where {which} group by 1),
      g as (select f.*, coalesce(messages, 0) as messages, o_custkey % 60 + 40 as years from f left join (select conv_id, count(*) as messages from conversations group by 1) on conv_id = o_custkey),
      d as (select o_custkey, {_steps_sql('meds', _BURDEN, 0.1)} as medication, {_steps_sql('conds', _BURDEN, 0.1)} as condition, {_steps_sql('upcoming', [(2, 0.8), (1, 0.5)], 0.1)} as encounter,
        least(1.0::double, (conds + meds) / 8.0::double + {_steps_sql('years', [(85, 0.25), (75, 0.15), (65, 0.05)], 0.0)}) as complexity, {_steps_sql('messages', [(6, 0.75), (2, 0.5), (1, 0.25)], 0.15)} as interaction from g),
      s as (select *, round(medication * 0.25::double + condition * 0.25::double + encounter * 0.2::double + complexity * 0.2::double + interaction * 0.1::double, 4) as score from d)
      select *, case when score < 0.35 and greatest(medication, condition, encounter, complexity, interaction) < 0.4 then 'STABLE' when score < 0.4 then 'LOW_ACTIVITY' when score < 0.6 then 'MODERATE_ACTIVITY' else 'HIGH_ACTIVITY' end as state from s"""


SQL = {
    "b12_age": "select o_custkey, cast(2010 - year(lo) - case when month(lo) > 1 or day(lo) > 1 then 1 else 0 end as bigint) as age, greatest(0, hi - lo)::bigint as days, case when hi > lo then round(n / ((hi - lo) / 365.25::double), 2) else 0.0 end as per_year from (select o_custkey, min(o_orderdate::date) as lo, max(o_orderdate::date) as hi, count(*) as n from orders group by 1)",
    "b7_casts": _T + ", r as (select seq, case when seq % 7 = 0 then 'n/a' when seq % 7 = 1 then ' ' else ' ' || code || '.0' end as raw, d from t) select seq, coalesce(try_cast(trim(raw) as double), 0.0) as as_float, coalesce(try_cast(try_cast(trim(raw) as double) as bigint), -1) as as_int, nullif(trim(raw), '') as as_text, d as as_date from r",
    "b4_coalesce": "with p as (select case when l_linenumber % 3 <> 0 then struct_pack(s := 'shipped', v := strftime(l_shipdate, '%Y-%m-%d')) when l_linenumber % 2 <> 0 then struct_pack(s := 'ordered', v := strftime(o_orderdate, '%Y-%m-%d')) else struct_pack(s := 'fallback', v := '1990-01-01') end as p from lineitem join orders on l_orderkey = o_orderkey) select p.s as source, count(*) as n, min(p.v) as first, max(p.v) as last from p group by 1",
    "b8_reference": "select p_partkey, case when p_partkey % 2 = 0 then cast(p_partkey as varchar) else '0a1b2c3d-0000-4000-8000-000000000001' end as id, p_partkey % 2 <> 0 as is_uuid from part",
    "b35_signature": "select o_custkey, sha256(string_agg(h, ',' order by h)) as signature from (select o_custkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) as h from orders) group by 1",
    "c1_lookup": "select l_partkey, coalesce(p_name, cast(l_partkey as varchar)) as name, sum(l_quantity) as qty, count(*) as n from lineitem left join (select * from part where p_partkey % 5 <> 0) on l_partkey = p_partkey group by l_partkey, p_name",
    "c3_asof": "with a as (select distinct o_custkey, year(o_orderdate) as y from orders), s as (select l_orderkey, year(max(l_shipdate)) as ship_y from lineitem group by 1) select o_orderkey, o_custkey, cast(ship_y as integer) as ship_y, cast(coalesce((select y from a where a.o_custkey = o.o_custkey and y = ship_y), (select max(y) from a where a.o_custkey = o.o_custkey)) as integer) as window_y, case when exists (select 1 from a where a.o_custkey = o.o_custkey and y = ship_y) then 'CONTAINS' else 'LAST' end as how from orders o join s on l_orderkey = o_orderkey",
    "c10_anti": "select c_nationkey, count(*) as without_orders from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null) group by 1",
    "c13_mapping": "select lpad(cast(l_suppkey as varchar), 12, '0') as external, s_name, sum(l_quantity) as qty from lineitem left join supplier on l_suppkey = s_suppkey group by 1, 2",
    "c14_crosscheck": "select lang, count(*) as n, count(*) filter (n_chars = length(text)) as equal, count(*) filter (n_chars <> length(text)) as unequal, count(*) filter (n_chars is null or text is null) as unknown from documents group by 1",
    "c15_fk": "select 'orders_with_customer' as check, count(*) as n from orders where o_custkey in (select c_custkey from customer) union all select 'items_without_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)",
    "d3_distinct_list": _T + " select entity, string_agg(kind, '|' order by s) as kinds from (select entity, kind, min(seq) as s from t group by all) group by 1",
    "d4_latest": _T + " select entity, code, count(*) as n, count(distinct kind) as kinds, max_by(d, struct_pack(a := d is null, b := d, c := seq)) as last_date, max_by(value, struct_pack(a := d is null, b := d, c := seq)) as last_value from t group by 1, 2",
    "d6_profile": _T + " select entity, min(d) as first_date, max(d) as last_date, count(*) as events, count(d) as dated, count(distinct code) as codes, count(*) filter (kind = 'purchase') as purchases, count(distinct kind) as kinds, (max(d) - min(d))::bigint as span_days, case when max(d) > min(d) then round(count(*) / ((max(d) - min(d)) / 365.25::double), 2) else 0.0 end as per_year from t group by 1",
    "d7_stats": _T + " select kind, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_samp(value), 6) as sd, min(value) as low, max(value) as high from t group by 1",
    "d8_status": "select o_custkey, count(*) filter (lower(o_orderstatus) = 'o') as active, count(*) filter (lower(o_orderstatus) = 'f') as completed, count(distinct o_orderpriority) as names, min(o_orderdate::date) as first_date, max(o_orderdate::date) as last_date from orders group by 1",
    "d9_trailing": _T + f", {_LAST} select entity, count(*) as recent, {_RECENT} from l where d >= last - 7 group by 1",
    "d11_explode": "select unnest(string_split(p_type, ' ')) as label, count(*) as n from part group by 1",
    "d12_quantile_excl": f"{_R} select event_type, max(q) filter (i = 1) as q1, max(q) filter (i = 2) as q2, max(q) filter (i = 3) as q3 from ({_cuts(4)}) group by 1",
    "d12_deciles": f"{_R} {_cuts(10)} union all {_cuts(20)}",
    "d18_distinct": _T + " select kind, count(distinct entity) as entities, count(distinct code) as codes, count(distinct d) as days from t group by 1",
    "d22_reconcile": "with c as (select 'total' as name, count(*) as n from events union all " + " union all ".join(f"select '{k}', count(*) filter (event_type = '{v}') from events" for k, v in cs.KINDS.items()) + ") select name, n as counted, n as in_source, 0::bigint as difference from c",
    "d24_inventory": "select event_type, count(*) as n, count(ts) as dated, min(ts) as first, max(ts) as last from events group by 1",
    "e11_keep_first": "select p_name, p_partkey, duplicates from (select *, row_number() over (partition by p_name order by p_size nulls last, p_partkey) as k, count(*) over (partition by p_name) as duplicates from part) where k = 1",
    "e13_order": _T + " select entity, count(*) as n, count(*) filter (ts < b) as falls from (select entity, ts, lag(ts) over (partition by entity order by seq) as b from t) group by 1",
    "f1_sort": "select o_orderkey, o_custkey, o_orderpriority from orders order by o_custkey, o_orderdate desc nulls last, o_orderpriority, o_orderkey",
    "f2_top": "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 20",
    "f3_stratified": "select doc_id, lang from (select *, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as k from documents) where k <= case lang when 'en' then 11 when 'de' then 4 when 'fr' then 5 else 0 end",
    "f4_floor_fill": "with r as (select doc_id, lang, md5('42:' || doc_id) as h, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as k from documents) select doc_id, lang, cast(place as integer) as place from (select *, row_number() over (order by k > 2, h, doc_id) as place from r) where place <= 20",
    "f5_first_n": "select o_custkey, o_orderkey, cast(k as integer) as place from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) where k <= 2",
    "f7_reserve": "select o_orderkey, o_totalprice, cast(k as integer) as place, case when k <= 50 then 'PRIMARY' else 'RESERVE' end as part from (select *, row_number() over (order by o_totalprice desc nulls last, o_orderkey) as k from orders)",
    "g1_union_latest": "select user_id, event_type, max(event_id) as event_id, max_by(value, event_id) as value, case when max(event_id) % 2 = 0 then 'prior' else 'new' end as origin from events group by 1, 2",
    "g2_union_distinct": "select c_nationkey as nation from customer union select s_nationkey from supplier",
    "g3_intersect": "select o_custkey from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderstatus = 'F'",
    "g4_except": "select o_custkey, o_orderpriority from orders where o_orderstatus = 'O' except all select o_custkey, o_orderpriority from orders where o_orderstatus = 'F'",
    "g5_dupes": "select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "h3_horizon": f"select o_custkey, count(*) as upcoming from orders where o_orderdate::date between date '{AS_OF}' and date '{AS_OF}' + {HORIZON} group by 1",
    "k2_entity_state": _T + f""", {_LAST}, f as (select entity, count(d) as dated, case when max(d) > min(d) then (count(*) * 73050 + (max(d) - min(d))) // (2 * (max(d) - min(d))) else 0 end as rate, count(*) filter (d >= last - 7) as recent,
        {", ".join(f"count(*) filter (kind = '{k}') as {n}" for k, n in _KIND.items())}, {", ".join(f"count(*) filter (kind = '{k}' and d >= last - 7) as recent_{k}" for k in ("purchase", "view", "error", "click"))},
        {", ".join(f"count(distinct case when kind = '{k}' then code end) as {k}_codes" for k in ("purchase", "view", "error"))}, count(distinct case when kind = 'error' then d end) as error_days, {", ".join(f"0 as {x}" for x in _ABSENT)} from l group by 1),
      p as (select entity, {", ".join(_points_sql(f) for f in [*_FEATURES, *_ABSENT])} from f),
      m as (select entity, {", ".join("(" + " + ".join(f"p_{f} * {w}" for f, w in parts.items()) + f" + 50) // 100 as {n}" for n, parts in ENTITY.items())} from p),
      o as (select entity, {", ".join(f"{n} / 10000.0::double as {n}" for n in ENTITY)}, (({" + ".join(f"{n} * {w}" for n, w in ENTITY_OVERALL.items())} + 50) // 100) / 10000.0::double as overall from m)
      select *, case when recent >= 0.67 or overall >= 0.67 then 'HIGH_ACTIVITY' when recent >= 0.34 or overall >= 0.34 then 'MODERATE_ACTIVITY' when complexity < 0.34 then 'STABLE' else 'LOW_ACTIVITY' end as state from o""",
    "k7_realtime": _realtime_sql("true"),
    "k7_moves": f"""with a as ({_realtime_sql("true")}), b as ({_realtime_sql(f"o_orderdate::date < date '{AS_OF}'")}),
      l as (select a.o_custkey, b.state as previous, a.state, a.score - coalesce(b.score, 0) as delta, list_position({_LEVELS}, a.state) - list_position({_LEVELS}, b.state) as up from a left join b using (o_custkey))
      select o_custkey, previous, state, case when up is null then 'INITIAL' when up = 0 then 'CONTINUATION' when up > 0 then 'ESCALATION' else 'DE_ESCALATION' end as type,
        case when up is null then 'NONE' when up = 0 then 'STABLE' when up > 0 then 'UP' else 'DOWN' end as direction, case when up <> 0 then round(abs(delta) * 10, 4) else 0.0::double end as magnitude, round(delta, 4) as score_delta from l""",
    "k9_reminders": "select 'medication' as kind, o_custkey, o_orderkey as id, o_orderpriority from orders where o_orderstatus = 'O' union all select 'appointment', o_custkey, o_orderkey, null from orders where o_orderdate::date >= date '2000-01-01'",
    "m1_quality": _T + " select unnest(['rows', 'null_entity', 'null_date', 'null_code', 'entities', 'repeated_ids']) as name, unnest([count(*), count(*) filter (entity is null), count(*) filter (d is null), count(*) filter (code is null), count(distinct entity), count(*) - count(distinct seq)]) as n from t",
}
QUERIES = {name: globals()[name] for name in SQL}
