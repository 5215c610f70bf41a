"""Chunks that keep to a document's structure, from its tree, with the map from elements to chunks and its audit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from . import trees

# fixed values: sizes in words, and words of titles whose sections are left out, or alone are taken from the back
TARGET, LONGEST, SHORT = 220, 300, 50
LEFT_OUT = r"(?i)(acknowledg|funding|financial support|sources of support|grant support|conflict of interest|competing interest|author contribution|correspondence|publisher|references\b|abbreviations\b|vocabulary)"
TAKEN = r"(?i)(data availability|ethic|declaration|limitation|methods|appendix|supplement|consent|data sharing|statements|study protocol|instrument|questionnaire|coding|definitions)"
_SENTENCE = re.compile(r"(?<=[.!?])(?=\s+[\"'(\[]*[A-Z])")


@dataclass
class Layout:
    """Which elements are sections, regions, paragraphs, and specials by kind."""

    sections: tuple = trees.SECTIONS
    regions: dict = field(default_factory=lambda: dict(trees.REGIONS))
    tables: tuple = ("table-wrap",)
    figures: tuple = ("fig",)
    lists: tuple = ("list",)
    items: tuple = ("list-item",)
    texts: dict = field(default_factory=lambda: {"boxed-text": "BOXED_TEXT", "disp-quote": "DISP_QUOTE", "disp-formula": "FORMULA"})


#: Web pages: the article is the body, the footer the back.
WEB = Layout(("section",), {"article": "BODY", "footer": "BACK"}, ("table",), ("figure",), ("ul", "ol"), ("li",), {"aside": "BOXED_TEXT", "blockquote": "DISP_QUOTE", "pre": "FORMULA"})


def elements(tree: DataFrame, layout: Layout) -> DataFrame:
    """(page, element, region, section, type, text): paragraphs and specials that stand directly in a region or in sections within it, none of
    which is left out by its title, in order and numbered from 0. section is the order number of the section, null in the region itself."""
    secs = trees.sections(tree, layout.sections, layout.regions).filter("region is not null")
    gone = F.col("title").rlike(LEFT_OUT) | ((F.col("region") == "BACK") & ~F.col("title").rlike(TAKEN) & (F.col("title") != ""))
    secs = storage.written(secs.withColumn("gone", gone), "sections")
    places = secs.select("page", F.col("start").alias("place"), F.col("order").alias("section"), "region")
    tops = trees.region_of(tree, trees.tagged(tree, *layout.regions).select("page", "start", "end"), layout.regions)
    places = places.unionByName(tops.select("page", F.col("start").alias("place"), F.lit(None).cast("long").alias("section"), "region"))
    plain = {"p": "P"} | layout.texts
    kind = F.create_map(*(F.lit(x) for pair in plain.items() for x in pair))[F.col("tag")]
    found = trees.text_of(tree, trees.tagged(tree, *plain).select("page", "start", "end", kind.alias("type"))).select("page", "start", "end", "type", F.col("said").alias("text"))
    for rows, name in ((trees.tables(tree, layout.tables), "TABLE"), (trees.figures(tree, layout.figures), "FIGURE_CAPTION"), (trees.lists(tree, layout.lists, layout.items), "LIST")):
        found = found.unionByName(rows.select("page", "start", "end", F.lit(name).alias("type"), F.col("rendered").alias("text")))
    parents = tree.filter(F.col("tag") != "#text").select("page", "start", F.col("parent").alias("place"))
    found = found.filter("text <> ''").join(parents, ["page", "start"]).join(places, ["page", "place"])
    found = trees.inside(found, secs.filter("gone"), "in_gone").select("page", "start").distinct().withColumn("gone", F.lit(True)).join(found, ["page", "start"], "right").filter("gone is null")
    number = F.row_number().over(Window.partitionBy("page").orderBy("start")) - 1
    return storage.written(found.select("page", number.cast("long").alias("element"), "region", "section", "type", "text"), "elements")


def fold(rows: list[tuple]) -> list[tuple]:
    """(kind, region, section, text, first element, last element, paragraphs, split, unsplit) of a page's elements in order.

    Paragraphs of one region and section are gathered while they fit in TARGET words; specials stand alone; a paragraph of
    more than LONGEST words is cut at sentences into groups of up to LONGEST, each beginning with the last
    sentence of the one before, or stays whole where it has no second sentence."""
    out: list[tuple] = []
    held: list[tuple] = []

    def close() -> None:
        if held:
            out.append(("PROSE", held[0][1], held[0][2], " ".join(e[4] for e in held), held[0][0], held[-1][0], len(held), False, False))
            held.clear()

    for e in rows:
        number, region, section, kind, text = e
        size = len(text.split())
        if kind != "P":
            close()
            out.append((kind, region, section, text, number, number, 1, False, False))
        elif size > LONGEST:
            close()
            sentences = [" ".join(s.split()) for s in _SENTENCE.split(text) if s.strip()]
            if len(sentences) < 2:
                out.append(("PROSE", region, section, text, number, number, 1, False, True))
                continue
            group: list[str] = []
            for s in sentences:
                if group and len(" ".join([*group, s]).split()) > LONGEST:
                    out.append(("PROSE", region, section, " ".join(group), number, number, 1, True, False))
                    group = [group[-1]]
                group.append(s)
            out.append(("PROSE", region, section, " ".join(group), number, number, 1, True, False))
        else:
            if held and ((held[0][1], held[0][2]) != (region, section) or sum(len(h[4].split()) for h in held) + size > TARGET):
                close()
            held.append(e)
    close()
    return out


_CHUNK = "page long, chunk long, chunk_id string, kind string, region string, section long, words long, text string, first long, last long, paragraphs long, paragraph_split boolean, unsplit_long_sentence boolean, too_short boolean, too_long boolean, special boolean"


def chunks(found: DataFrame) -> DataFrame:
    """Chunks of elements (page, element, region, section, type, text), numbered from 0 in each page, with ids and flags. A page's elements
    meet in one row, since each chunk depends on the one before."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for page, rows in zip(pdf["page"], pdf["rows"], strict=True):
                # numbers beside nulls come as floats
                own = [(int(r["element"]), r["region"], None if pd.isna(r["section"]) else int(r["section"]), r["type"], r["text"]) for r in rows]
                for i, (kind, region, section, text, first, last, n, split, unsplit) in enumerate(fold(own)):
                    words = len(text.split())
                    name = f"{page}__{region}__{section or 0:03d}__{kind}__{i:05d}"
                    out.append((page, i, name, kind, region, section, words, text, first, last, n, split, unsplit, kind == "PROSE" and words < SHORT, words > LONGEST, kind != "PROSE"))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _CHUNK.split(", ")])
            frame["section"] = frame["section"].astype("Int64")
            yield frame

    rows = found.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("element", "region", "section", "type", "text"))).alias("rows"))
    return rows.mapInPandas(run, _CHUNK)


def coverage(found: DataFrame, made: DataFrame) -> DataFrame:
    """(page, elements, chunks, covered, dropped, repeated, falls): how a page's elements lie in its chunks, from the map alone. repeated are
    elements in more than one chunk, falls chunks whose first element lies before that of the chunk before."""
    placed = made.select("page", "chunk", F.explode(F.sequence("first", "last")).alias("element"))
    times = placed.groupBy("page", "element").agg(F.count("*").alias("n"))
    per = found.select("page", "element").join(times, ["page", "element"], "left").groupBy("page").agg(F.count("*").alias("elements"), F.count("n").alias("covered"), F.count_if(F.col("n").isNull()).alias("dropped"), F.count_if(F.col("n") > 1).alias("repeated"))
    fall = F.col("first") < F.lag("first").over(Window.partitionBy("page").orderBy("chunk"))
    falls = made.select("page", "chunk", F.coalesce(fall, F.lit(False)).alias("fall")).groupBy("page").agg(F.count("*").alias("chunks"), F.count_if("fall").alias("falls"))
    return per.join(falls, "page", "left").select("page", "elements", F.coalesce("chunks", F.lit(0)).alias("chunks"), "covered", "dropped", "repeated", F.coalesce("falls", F.lit(0)).alias("falls"))
