"""Documents as trees with interval labels: sections, tables, lists, authors and references by joins within a page.

One fold over a page's markup numbers its tags and texts; an element has the number of its opening tag and the
number where it ends, and lies in another exactly if its interval does. Everything else is joins on (page, start, end).

Defined results for what is not well formed: an element that isn't closed ends where the element around it does, at the latest
at the page's end; a closing tag ends all that was opened within its element; one without an open element is ignored; an element
named in IMPLIED ends where a sibling named there begins, and void elements have no content. Comments, processing instructions,
document types and the contents of scripts and styles are left out. Tags and attributes' names count without prefix and in lower case;
of an attribute given twice the first stays; entities are decoded.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .. import storage

# fixed values: elements without content, elements that end where a like one begins, and the elements that hold these
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table div section article body nav footer header sec list def-list table-wrap aside blockquote tbody thead select".split())
RAW = ("script", "style")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<\?.*?(?:>|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<![^>]*>?|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NODES = pa.schema([("page", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("parent", pa.int64()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1].lower()


def label_page(markup: str) -> list[tuple]:
    """(start, end, depth, parent, tag, attributes, text) of a page's elements and texts (tag #text), by start; parent is -1 at the top."""
    out: list[list] = []
    stack: list[int] = []
    at, n = 0, 0

    def end_from(level: int) -> None:
        nonlocal n
        for i in stack[level:]:
            out[i][1] = n
        if level < len(stack):
            n += 1
        del stack[level:]

    def add(tag: str, attrs: list, text: str | None) -> None:
        nonlocal n
        out.append([n, n, len(stack), out[stack[-1]][0] if stack else -1, tag, attrs, text])
        n += 1

    while m := _TOKEN.match(markup, at):
        at = m.end()
        text = m["cdata"] if m["cdata"] is not None else m["text"]
        if text is not None:
            if text.strip():
                add("#text", [], text if m["text"] is None else html.unescape(text))
            continue
        if m["tag"] is None:
            continue
        tag = _local(m["tag"])
        if m["close"]:
            level = next((k for k in range(len(stack) - 1, -1, -1) if out[stack[k]][4] == tag), None)
            if level is not None:
                end_from(level)
            continue
        ends = IMPLIED.get(tag)
        if ends:
            inner = max((k for k, i in enumerate(stack) if out[i][4] in HOLDS), default=-1)
            level = next((k for k in range(inner + 1, len(stack)) if out[stack[k]][4] in ends), None)
            if level is not None:
                end_from(level)
        attrs: dict[str, str] = {}
        for name, *values in _ATTR.findall(m["attrs"]):
            attrs.setdefault(_local(name), html.unescape(next((v for v in values if v), "")))
        add(tag, list(attrs.items()), None)
        if not (m["attrs"].endswith("/") or tag in VOID):
            stack.append(len(out) - 1)
            if tag in RAW:
                close = re.compile(f"</{tag}", re.I).search(markup, at)
                at = close.start() if close else len(markup)
    end_from(0)
    return [tuple(x) for x in out]


def nodes(pages: DataFrame) -> DataFrame:
    """(page, start, end, depth, parent, tag, attrs, text) of pages (page_id, html); null markup has no nodes, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = label_page(markup or "")
                if rows:
                    columns = [[page] * len(rows), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES)

    rows = storage.spread(pages.filter("page_id is not null").select(F.col("page_id").cast("long"), F.col("html").cast("string")))
    return storage.written(rows.mapInArrow(run, from_arrow_schema(_NODES)), "nodes")


def tagged(tree: DataFrame, *tags: str) -> DataFrame:
    return tree.filter(F.col("tag").isin(*tags))


def inside(inner: DataFrame, outer: DataFrame, name: str) -> DataFrame:
    """inner's columns with `name`, the start of each element of outer that it lies in; one row a pair."""
    o = outer.select(F.col("page").alias("_page"), F.col("start").alias(name), F.col("end").alias("_end"))
    return inner.join(o, (F.col("page") == F.col("_page")) & (F.col("start") > F.col(name)) & (F.col("end") <= F.col("_end"))).drop("_page", "_end")


def clean(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_of(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (page, start, end, ...) with `said`: all texts within, in order, joined by blanks."""
    said = inside(tagged(tree, "#text").select("page", "start", "end", "text"), rows.select("page", "start", "end").distinct(), "of")
    said = said.groupBy("page", "of").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("t"))
    said = said.select(F.col("page").alias("_page"), F.col("of").alias("_of"), clean(F.array_join("t.text", " ")).alias("said"))
    return rows.join(said, (F.col("page") == F.col("_page")) & (F.col("start") == F.col("_of")), "left").drop("_page", "_of").fillna("", ["said"])


def _first_child(tree: DataFrame, rows: DataFrame, name: str, tags: tuple) -> DataFrame:
    """rows with `name`, the text of the first child with one of tags."""
    child = tagged(tree, *tags).groupBy("page", "parent").agg(F.min(F.struct("start", "end")).alias("c")).select("page", F.col("parent").alias("of"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))
    child = text_of(tree, child).select(F.col("page").alias("_page"), "of", F.col("said").alias(name))
    return rows.join(child, (F.col("page") == F.col("_page")) & (F.col("start") == F.col("of")), "left").drop("_page", "of").fillna("", [name])


SECTIONS, TITLES, REGIONS = ("sec", "section"), ("title", "h1", "h2", "h3", "h4", "h5", "h6"), {"abstract": "ABSTRACT", "body": "BODY", "back": "BACK"}


def region_of(tree: DataFrame, rows: DataFrame, regions: dict[str, str]) -> DataFrame:
    """rows with `region`, by the outermost region element that they lie in (or are), null outside of all."""
    held = tagged(tree, *regions).select(F.col("page").alias("_page"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("tag").alias("_tag"))
    met = rows.join(held, (F.col("page") == F.col("_page")) & (F.col("start") >= F.col("_start")) & (F.col("end") <= F.col("_end")))
    first = met.groupBy("page", "start").agg(F.min(F.struct("_start", "_tag")).alias("r"))
    name = F.create_map(*(F.lit(x) for pair in regions.items() for x in pair))[F.col("r._tag")]
    return rows.join(first.select("page", "start", name.alias("region")), ["page", "start"], "left")


def sections(tree: DataFrame, tags: tuple = SECTIONS, regions: dict[str, str] = REGIONS) -> DataFrame:
    """(page, start, end, order, depth, parent_order, section_id, label, title, path, region): each page's sections in order. path
    holds the titles of the sections around, outermost first, and the own one."""
    secs = tagged(tree, *tags).select("page", "start", "end", F.col("attrs")["id"].alias("section_id"))
    secs = secs.withColumn("order", F.row_number().over(Window.partitionBy("page").orderBy("start")).cast("long"))
    secs = _first_child(tree, _first_child(tree, secs, "title", TITLES), "label", ("label",))
    secs = storage.written(region_of(tree, secs, regions), "sections")
    around = inside(secs.select("page", "start", "end"), secs, "outer").join(secs.select("page", F.col("start").alias("outer"), F.col("order").alias("o"), F.col("title").alias("t")), ["page", "outer"])
    chain = around.groupBy("page", "start").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("chain"))
    rows = secs.join(chain, ["page", "start"], "left")
    above = F.coalesce(F.size("chain"), F.lit(0))
    path = F.concat(F.coalesce(F.transform("chain", lambda x: x["t"]), F.array().cast("array<string>")), F.array("title"))
    return rows.select(
        "page", "start", "end", "order", (F.when(above > 0, above).otherwise(0) + 1).cast("long").alias("depth"), F.element_at("chain.o", -1).alias("parent_order"),
        "section_id", "label", "title", F.array_join(path, " > ").alias("path"), "region",
    )


def tables(tree: DataFrame, tags: tuple = ("table-wrap",)) -> DataFrame:
    """(page, start, rendered): each table as `Caption: ... Rows: a | b / ...`; empty cells are left out, and rows without cells."""
    held = tagged(tree, *tags).select("page", "start", "end")
    caption = tagged(tree, "caption").select("page", "start", "end")
    said = text_of(tree, inside(tagged(tree, "title", "p").select("page", "start", "end"), caption, "of")).filter("said <> ''")
    captions = said.groupBy("page", "of").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "said")))["said"], " ").alias("caption")).withColumnRenamed("of", "start")
    first = inside(caption, held, "table").groupBy("page", "table").agg(F.min("start").alias("start")).join(captions, ["page", "start"]).select("page", F.col("table").alias("start"), "caption")
    cells = text_of(tree, tagged(tree, "th", "td").select("page", "start", "end", F.col("parent").alias("tr")))
    lines = cells.groupBy("page", "tr").agg(F.array_join(F.filter(F.array_sort(F.collect_list(F.struct("start", "said")))["said"], lambda x: x != ""), " | ").alias("line"))
    rows = inside(tagged(tree, "tr").select("page", "start", "end"), held, "table").select("page", "table", F.col("start").alias("tr")).join(lines, ["page", "tr"])
    rows = rows.groupBy("page", "table").agg(F.array_join(F.array_sort(F.collect_list(F.struct("tr", "line")))["line"], " / ").alias("rows")).withColumnRenamed("table", "start")
    out = held.join(first, ["page", "start"], "left").join(rows, ["page", "start"], "left")
    shown = F.concat_ws(" ", F.when(F.col("caption") != "", F.concat(F.lit("Caption: "), "caption")), F.when(F.col("rows").isNotNull(), F.concat(F.lit("Rows: "), "rows")))
    return out.select("page", "start", "end", clean(shown).alias("rendered"))


def lists(tree: DataFrame, tags: tuple = ("list",), items: tuple = ("list-item",)) -> DataFrame:
    """(page, start, rendered): the texts of each list's items in order, an inner list's too; a definition as `term: text`."""
    held = tagged(tree, *tags, "def-list").select("page", "start", "end")
    said = text_of(tree, tagged(tree, *items, "def").select("page", "start", "end", "parent", "tag"))
    term = text_of(tree, tagged(tree, "term").select("page", "start", "end", "parent")).groupBy("page", "parent").agg(F.min(F.struct("start", "said"))["said"].alias("term"))
    said = said.join(term, ["page", "parent"], "left").withColumn("said", F.when((F.col("tag") == "def") & (F.col("term") != ""), F.concat("term", F.lit(": "), "said")).otherwise(F.col("said")))
    met = inside(said.filter("said <> ''").select("page", "start", "end", "said"), held, "of")
    out = met.groupBy("page", "of").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "said")))["said"], " ").alias("rendered"))
    return held.join(out.withColumnRenamed("of", "start"), ["page", "start"], "left").select("page", "start", "end", clean(F.coalesce("rendered", F.lit(""))).alias("rendered"))


def figures(tree: DataFrame, tags: tuple = ("fig",)) -> DataFrame:
    """(page, start, rendered): captions, led by `Fig. label:` where the caption doesn't hold the label."""
    held = tagged(tree, *tags).select("page", "start", "end")
    said = text_of(tree, inside(tagged(tree, "caption").select("page", "start", "end"), held, "of")).groupBy("page", "of").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "said")))["said"], " ").alias("caption"))
    rows = _first_child(tree, held, "label", ("label",)).join(said.withColumnRenamed("of", "start"), ["page", "start"], "left").fillna("", ["caption"])
    led = F.when((F.col("label") != "") & ~F.contains("caption", "label"), F.concat(F.lit("Fig. "), "label", F.lit(": "), "caption")).otherwise(F.col("caption"))
    return rows.select("page", "start", "end", clean(led).alias("rendered"))


def authors(tree: DataFrame) -> DataFrame:
    """(page, position, surname, given, affiliation, resolved): each author with each affiliation it refers to (or null), and whether that exists."""
    who = tagged(tree, "contrib").select("page", "start", "end").withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy("start")))
    for name, tag in (("surname", "surname"), ("given", "given-names")):
        part = text_of(tree, inside(tagged(tree, tag).select("page", "start", "end"), who, "of")).groupBy("page", "of").agg(F.min(F.struct("start", "said"))["said"].alias(name))
        who = who.join(part.withColumnRenamed("of", "start"), ["page", "start"], "left")
    refs = inside(tagged(tree, "xref").filter(F.col("attrs")["ref-type"] == "aff").select("page", "start", "end", F.col("attrs")["rid"].alias("rid")), who, "of")
    refs = refs.select("page", F.col("of").alias("start"), F.explode(F.split("rid", " ")).alias("affiliation")).distinct()
    known = tagged(tree, "aff").select("page", F.col("attrs")["id"].alias("affiliation")).filter("affiliation is not null").distinct().withColumn("resolved", F.lit(True))
    rows = who.join(refs, ["page", "start"], "left").join(known, ["page", "affiliation"], "left")
    return rows.select("page", F.col("position").cast("long"), "surname", "given", "affiliation", F.when(F.col("affiliation").isNotNull(), F.coalesce("resolved", F.lit(False))).alias("resolved"))


def dangling(tree: DataFrame) -> DataFrame:
    """(page, target, n): references within the page (rid, or href after #) that name no element's id."""
    rid = F.when(F.col("attrs")["rid"].isNotNull(), F.split(F.col("attrs")["rid"], " ")).when(F.col("attrs")["href"].startswith("#"), F.array(F.substring(F.col("attrs")["href"], 2, 1 << 20)))
    refs = tree.filter(F.col("tag") != "#text").select("page", F.explode(rid).alias("target")).filter("target <> ''")
    ids = tree.filter(F.col("attrs")["id"].isNotNull()).select("page", F.col("attrs")["id"].alias("target")).distinct()
    return refs.join(ids, ["page", "target"], "left_anti").groupBy("page", "target").agg(F.count("*").alias("n"))
