"""Intervals that hold a date, records that are one by several identifiers, greedy acceptance over all groups, and differences of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import text as X
from ..operators import acceptance, difference, identity, intervals, similarity
from ..tables import load

#: Accepted documents of one source and of one language at most, and the overlap of terms from which two are alike.
PER_SOURCE, PER_LANG, ALIKE = 12, 150, 0.6
#: Characters from which a document's first or last line identifies it.
LINE = 20


def c3_interval(spark, sf):
    """Each line item's later date in its customer's orders, from ordering to the last shipping (every 16th without an end); orders of the
    lowest priority are gaps."""
    orders, items = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    ship = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("ship"))
    last = F.when(F.col("o_orderkey") % 16 != 0, F.col("ship"))
    windows = orders.join(ship, "o_orderkey", "left").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("first"), last.alias("last"), F.col("o_orderkey").alias("window"), F.col("o_orderpriority").startswith("5").alias("gap"))
    later = F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_linenumber") * 60).cast("int"))
    points = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("entity"), later.alias("at"), "l_orderkey", "l_linenumber")
    rows = intervals.containing(points, windows)
    return rows.groupBy("l_orderkey", F.col("window").alias("holder"), "how").agg(F.count("*").alias("items"))


def e11_identities(spark, sf):
    """Documents that are one by their text, or by a long first or last line."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "text")
    lines = F.split(F.btrim("text"), "\n")
    long = lambda c: F.when(F.length(c) >= LINE, c)
    keys = {"text": F.md5(F.btrim(F.lower("text")).cast("binary")), "first": long(F.element_at(lines, 1)), "last": long(F.element_at(lines, -1))}
    rows = identity.same_records(docs, keys, [F.col("n_chars").isNull(), F.col("n_chars")])
    return rows.select(F.col("id").alias("doc_id"), "duplicate_group", "kept", F.col("size").alias("records"))


def e10_rounds(spark, sf):
    """Documents accepted from the longest on, none like one accepted before, up to PER_SOURCE of a source and PER_LANG of a language."""
    docs = load(spark, sf, "documents").filter("text is not null")
    rows = docs.select(F.col("doc_id").alias("id"), (-F.length("text")).alias("place"), "source", "lang")
    alike = similarity.jaccard_pairs(docs.select(F.col("doc_id").alias("id"), X.terms(F.col("text")).alias("tokens")), ALIKE).select("a", "b")
    out, _ = acceptance.accept(rows, alike, {"source": PER_SOURCE, "lang": PER_LANG})
    return out.select(F.col("id").alias("doc_id"), "source", "lang", "accepted")


def l10_difference(spark, sf):
    """Cells in which two runs over the orders differ: the second rounds every 500th price, loses every 700th row and has a priority for every 900th."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"), "o_orderpriority")
    k = F.col("o_orderkey")
    second = orders.filter(k % 700 != 0).select(
        "o_orderkey", "o_custkey", F.when(k % 500 == 0, F.round("o_totalprice", 0).cast("decimal(15,2)")).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(k % 900 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    left, right = storage.folder(spark, "run-1"), storage.folder(spark, "run-2")
    difference.write(orders, ["o_orderkey"], left)
    difference.write(second, ["o_orderkey"], right)
    return difference.differences(spark, left, right, ["o_orderkey"])


_LINE = f"case when length({{0}}) >= {LINE} then {{0}} end"
#: Acceptance depends on all rows before, one by one: it is tested against that loop.
SQL = {
    "c3_interval": """with ship as (select l_orderkey as o_orderkey, max(l_shipdate)::date as ship from lineitem group by 1),
      w as (select o_custkey as entity, o_orderdate::date as f, case when o_orderkey % 16 <> 0 then ship end as l, o_orderkey as win, starts_with(o_orderpriority, '5') as gap from orders left join ship using (o_orderkey)),
      p as (select o_custkey as entity, (l_shipdate::date + cast(l_linenumber * 60 as integer))::date as d, l_orderkey, row_number() over () as k from lineitem join orders on l_orderkey = o_orderkey),
      m as (select p.k, min(struct_pack(f := f, win := win)) as o from p join w on p.entity = w.entity and f <= d and (l is null or d <= l) group by 1),
      e as (select entity, max(struct_pack(f := f, win := win)) filter (not gap) as known, max(struct_pack(f := f, win := win)) as latest from w group by 1),
      r as (select p.l_orderkey, coalesce(o.win, known.win, latest.win) as holder, case when o is not null then 'CONTAINS' when known is not null then 'LAST_KNOWN' when latest is not null then 'LAST' end as how
        from p left join m using (k) left join e using (entity))
      select l_orderkey, holder, how, count(*) as items from r group by all""",
    "e11_identities": f"""with recursive t as (select doc_id, n_chars, text, string_split(trim(text, ' '), chr(10)) as ls from documents),
      k as (select doc_id, 'text' as kind, md5(trim(lower(text), ' ')) as v from t union all select doc_id, 'first', {_LINE.format('ls[1]')} from t union all select doc_id, 'last', {_LINE.format('ls[-1]')} from t),
      e as (select distinct a.doc_id as a, m as b from k a join (select kind, v, min(doc_id) as m from k where v is not null group by all) using (kind, v)),
      g as (select a, b from e union select b, a from e),
      r(id, other) as (select doc_id, doc_id from documents union select r.id, g.b from r join g on r.other = g.a),
      c as (select id, min(other) as component from r group by 1),
      d as (select id, component, first_value(id) over (partition by component order by n_chars is null, n_chars, id) as grp, count(*) over (partition by component) as n from c join documents on doc_id = id)
      select id as doc_id, grp as duplicate_group, grp = id as kept, n as records from d""",
}
SQL["l10_difference"] = """with o as (select o_orderkey as k, o_totalprice::decimal(15,2) as p, o_orderpriority as r from orders)
  select k as o_orderkey, '-' as column, 'present' as left, null as right from o where k % 700 = 0
  union all select k, 'o_totalprice', p::varchar, round(p, 0)::decimal(15,2)::varchar from o where k % 700 <> 0 and k % 500 = 0 and p <> round(p, 0)
  union all select k, 'o_orderpriority', r, null from o where k % 700 <> 0 and k % 900 = 0 and r is not null"""
QUERIES = {f.__name__: f for f in (c3_interval, e11_identities, e10_rounds, l10_difference)}
