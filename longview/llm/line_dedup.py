"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines of a document are hashed. Of the windows with one hash, the first by (doc_id, text's hash, line)
stays; each later one covers its three lines, the covered positions of a document are merged to intervals, and
the lines outside them are kept. Every removed line has an equal line at an earlier place, so the first copy
of each line's text always stays.

Counting is combined before the shuffle, so a window that a third of all documents hold is one row per task by
then; the join that finds later occurrences can be split by the engine at a frequent hash. Position lists are
one document's own.

Defined results: a null text stays null, and texts of fewer than three lines stay as they are; lines are
compared exactly, blank ones too; a text of which every line is covered becomes empty; a row with a null id is
left as it is and takes no part; rows repeated under one id and text are one document and are cut alike, rows of one id with different texts are documents
of their own, in the order of their texts' hashes; other columns
are kept, whatever their names, but for n_lines and n_removed, which the result's take the place of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read

SPAN = 3


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.split(F.col("text").cast("string"), "\n", -1).alias("_lines"))


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, h): a 128-bit hash of each three consecutive lines; t is the text's hash."""
    rows = _lines(docs.filter("doc_id is not null and text is not null")).filter(F.size("_lines") >= SPAN)
    at = F.sequence(F.lit(1), F.size("_lines") - (SPAN - 1))
    joined = F.transform(at, lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice("_lines", i, F.lit(SPAN))).cast("binary"))))
    return rows.select("doc_id", "t", F.posexplode(joined).alias("pos", "h"))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, t, intervals): the merged covered line positions [lo, hi) of each document that has any, in order."""
    seen = windows(docs)
    first = seen.groupBy("h").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    later = seen.join(first, "h").filter(F.struct("doc_id", "t", "pos") != F.col("first")).select("doc_id", "t", "pos")
    by_doc = Window.partitionBy("doc_id", "t").orderBy("pos")
    new = F.coalesce((F.col("pos") > F.lag("pos").over(by_doc) + SPAN).cast("int"), F.lit(1))
    islands = later.withColumn("new", new).withColumn("island", F.sum("new").over(by_doc))
    merged = islands.groupBy("doc_id", "t", "island").agg(F.min("pos").alias("lo"), (F.max("pos") + SPAN).alias("hi"))
    return merged.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_cut"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the covered lines taken out of text, and n_lines and n_removed."""
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    cut = covered(docs).select(F.col("doc_id").alias("at"), "t", F.col("_cut").alias("cut"))
    rows = whole.join(cut, (F.col("id") == F.col("at")) & (F.col("hash") == F.col("t")), "left").select("row", "cut", F.split(F.col("row.text").cast("string"), "\n", -1).alias("lines"))
    kept = F.expr("""
        flatten(transform(sequence(0, size(cut)), j -> slice(lines,
            if(j = 0, 0, cut[greatest(j - 1, 0)].hi) + 1,
            if(j = size(cut), size(lines), cut[least(j, size(cut) - 1)].lo) - if(j = 0, 0, cut[greatest(j - 1, 0)].hi))))
    """)
    rows = rows.withColumn("kept", F.when(F.col("cut").isNotNull(), kept))
    text, given = F.col("row.text"), F.col("cut").isNotNull()
    out = {"text": F.when(given, F.array_join("kept", "\n")).otherwise(text)}
    out["n_lines"] = F.when(text.isNotNull(), F.size("lines")).cast("long")
    out["n_removed"] = F.when(given, F.size("lines") - F.size("kept")).otherwise(F.when(text.isNotNull(), 0)).cast("long")
    return rows.select(*(out.get(c, F.col(f"row.`{c}`")).alias(c) for c in names), *(out[c].alias(c) for c in out if c not in names))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = """
with l as (
  select doc_id, unnest(s) as line, unnest(range(len(s))) as pos, len(s) as n
  from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)
), w as (
  select doc_id, pos, n, line || chr(10) || lead(line, 1) over d || chr(10) || lead(line, 2) over d as w
  from l window d as (partition by doc_id order by pos)
), later as (
  select doc_id, pos from (
    select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as k from w where pos + 2 < n
  ) where k > 1
), gone as (
  select distinct doc_id, pos + k as pos from later, (select unnest([0, 1, 2]) as k)
), kept as (
  select l.doc_id, count(*) as n, string_agg(l.line, chr(10) order by l.pos) as text
  from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos where g.pos is null group by l.doc_id
)
select d.doc_id, case when d.text is not null then coalesce(k.text, '') end as text,
  cast(len(string_split(d.text, chr(10))) as bigint) as n_lines,
  cast(len(string_split(d.text, chr(10))) - coalesce(k.n, 0) as bigint) as n_removed
from documents d left join kept k on d.doc_id = k.doc_id
"""
