"""Chunks of texts: fixed windows of words, and paragraphs gathered up to a size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Characters of chunks that are held before they are handed on, about.
HELD = 1 << 20


def word_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """docs (doc_id, text) as (doc_id, chunk_id, start, words, chunk): size words each, overlap in common with the
    one before. A tail that lies wholly in the overlap is kept."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be above 0 and overlap from 0 to below size")
    step = size - overlap
    words = F.filter(F.split("text", r"[ \n\t\r\f\x0B]+"), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("start"))
    chunk = F.slice("w", F.col("start") + 1, F.lit(size))
    return rows.select("doc_id", (F.floor(F.col("start") / step) + 1).alias("chunk_id"), F.col("start").cast("long"), F.size(chunk).cast("long").alias("words"), F.array_join(chunk, " ").alias("chunk"))


def sweep(docs: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """How many chunks each setting makes, and how long they are."""
    out = None
    for size, overlap in settings:
        c = word_windows(docs, size, overlap).agg(F.count("*").alias("chunks"), F.round(F.avg("words"), 4).alias("mean_words"), F.max("words").alias("most_words"))
        c = c.select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "*")
        out = c if out is None else out.union(c)
    return out


_END = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])")


def fold_paragraphs(text: str, target: int, longest: int) -> list[str]:
    """Paragraphs (lines) gathered while they fit in target words; one longer than longest is cut at sentences into
    groups of up to longest words, each beginning with the last sentence of the one before."""
    out: list[str] = []
    held: list[str] = []
    n = 0

    def close() -> None:
        nonlocal held, n
        if held:
            out.append("\n".join(held))
        held, n = [], 0

    for line in text.split("\n"):
        words = len(line.split())
        if not words:
            continue
        if words > longest:
            close()
            group: list[str] = []
            size = 0
            for s in _END.split(line):
                k = len(s.split())
                if group and size + k > longest:
                    out.append(" ".join(group))
                    group, size = [group[-1]], len(group[-1].split())
                group.append(s)
                size += k
            out.append(" ".join(group))
            continue
        if n + words > target:
            close()
        held.append(line)
        n += words
    close()
    return out


_CHUNKS = pa.schema([("doc_id", pa.int64()), ("chunk_id", pa.int64()), ("words", pa.int64()), ("chunk", pa.string())])


def _folded(batches: Iterator[pa.RecordBatch], target: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Chunks in batches of about HELD characters, so that no more than that and one text are held besides the batch that came."""
    out: list[list] = [[], [], [], []]
    held = 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CHUNKS, strict=True)], schema=_CHUNKS)
    for came in batches:
        for i in range(came.num_rows):
            doc, text = came.column(0)[i].as_py(), came.column(1)[i].as_py()
            for k, c in enumerate(fold_paragraphs(text or "", target, longest)):
                for column, x in zip(out, (doc, k + 1, len(c.split()), c), strict=True):
                    column.append(x)
                held += len(c)
                if held >= HELD:
                    yield batch()
                    out, held = [[], [], [], []], 0
    yield batch()


def paragraph_chunks(docs: DataFrame, target: int, longest: int) -> DataFrame:
    """docs (doc_id, text) as (doc_id, chunk_id, words, chunk); the fold over a text's lines depends on their order, so
    it runs in Python, row by row, without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _folded(batches, target, longest), from_arrow_schema(_CHUNKS))
