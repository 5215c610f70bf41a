"""Pages as trees: section inventory, rendered lists, references, structured chunks and their coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structured, trees
from ..tables import load

#: What counts as a section of a web page, and its regions.
PARTS, REGIONS = ("nav", "article", "footer", "div", "section"), {"nav": "NAV", "article": "BODY", "footer": "BACK"}


def _tree(spark, sf):
    pages = load(spark, sf, "pages")
    return trees.nodes(pages.select("page_id", "html"))


def j11_sections(spark, sf):
    """Each page's parts in order with depth, title, path, and how many words, links and paragraphs they hold."""
    tree = _tree(spark, sf)
    parts = trees.text_of(tree, trees.sections(tree, PARTS, REGIONS))
    held = lambda tag, name: trees.inside(trees.tagged(tree, tag).select("page", "start", "end"), parts, "of").groupBy("page", "of").agg(F.count("*").alias(name)).withColumnRenamed("of", "start")
    rows = parts.join(held("a", "links"), ["page", "start"], "left").join(held("p", "paragraphs"), ["page", "start"], "left")
    words = F.when(F.col("said") == "", 0).otherwise(F.size(F.split("said", " "))).cast("long")
    return rows.select(
        F.col("page").alias("page_id"), "order", "depth", "region", "title", "path", words.alias("words"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"),
    )


def b38_lists(spark, sf):
    """Each page's lists, their items' texts joined in order."""
    rows = trees.lists(_tree(spark, sf), ("ul", "ol"), ("li",))
    return rows.select(F.col("page").alias("page_id"), F.row_number().over(trees.Window.partitionBy("page").orderBy("start")).cast("long").alias("list"), "rendered")


def c10_links(spark, sf):
    """Links of each page, and those whose path no page has."""
    pages = load(spark, sf, "pages")
    links = trees.tagged(_tree(spark, sf), "a").filter(F.col("attrs")["href"].isNotNull()).select(F.col("page").alias("page_id"), F.col("attrs")["href"].alias("path"))
    paths = pages.select(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1).alias("path")).distinct().withColumn("known", F.lit(True))
    return links.join(paths, "path", "left").groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("known").isNull()).alias("dangling"))


def j9_chunks(spark, sf):
    """Chunks that keep to regions, sections and lists, with ids and flags."""
    made = structured.chunks(structured.elements(_tree(spark, sf), structured.WEB))
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    return made.select(F.col("page").alias("page_id"), "chunk", "chunk_id", "kind", "region", "words", "first", "last", "paragraphs", "paragraph_split", "unsplit_long_sentence", "too_short", "too_long", "special", digest)


def d25_chunks(spark, sf):
    """How each page's elements lie in its chunks: dropped, repeated, falling."""
    found = structured.elements(_tree(spark, sf), structured.WEB)
    return structured.coverage(found, structured.chunks(found)).withColumnRenamed("page", "page_id")


#: Trees come from a fold over markup, which SQL can't express; links by their markup alone can be counted.
SQL = {
    "c10_links": """with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as path from pages)
      select page_id, count(*) as links, count(*) filter (path not in (select regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) from pages)) as dangling from l group by 1""",
}
QUERIES = {f.__name__: f for f in (j11_sections, b38_lists, c10_links, j9_chunks, d25_chunks)}
