"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and packing, each on what the one before kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever their names.

Defined results: a null or empty text is scored as an empty one, has no line to lose and no near-duplicate, and has no token
for the mix, which leaves it out; a row with a null id takes no part in line dedup and near-dedup and stays in both,
and the mix leaves it out; rows repeated under one id and text are treated alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm import mixing, toxicity
from longview.llm._common import materialize, read
from longview.llm.line_dedup import line_dedup
from longview.llm.near_dedup import near_duplicates
from longview.llm.packing import pack

#: The mix keeps this share of the tokens that reach it, each document at most once.
MIX_FRACTION = 0.8


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _whole(docs: DataFrame):
    """All of a row in one column, which no operator's own names can clash with."""
    return F.struct(*_own(docs)).alias("_whole")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks as toxic go."""
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go, and with them documents of which nothing is left."""
    rows = line_dedup(docs.select("doc_id", "text", _whole(docs))).filter("n_removed is null or n_removed = 0 or n_removed < n_lines")
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_whole.n_chars")) if "n_chars" in docs.columns else None
    changed = {"text": F.col("text")} | ({"n_chars": size.cast(docs.schema["n_chars"].dataType)} if size is not None else {})
    return rows.select(*(changed.get(c, F.col(f"_whole.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words, the one with the smallest id stays."""
    kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select(_own(docs)).union(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the weights of domains, languages and sources."""
    domain = mixing.domain_of(F.col("source"), mixing.DOMAINS, mixing.OTHER_DOMAIN)
    return mixing.mix(docs.select("doc_id", "text", "lang", "source", _whole(docs)), domain, mixing.WEIGHTS, mixing.SEED, MIX_FRACTION, 1).select("_whole.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows."""
    return pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
