"""Exact dedup against a history of digests held in a minimal perfect hash.

The history's distinct SHA-256 digests are dealt to buckets of about BUCKET digests. Each bucket holds a
minimal perfect hash (levels of bit arrays; a digest's slot is the rank of its bit), and its slots hold the full
digests, the winner's locator (its id) and the number of copies. A batch is first aggregated to its distinct
digests, so a text that a third of all rows share is one row by then. A lookup computes the slot and compares
all 32 bytes: equal is a repeat; anything else is a nonmember, and nonmembers are grouped by digest on their
own. Digests are distinct and spread evenly, so no bucket grows with a popular text.

Defined results: a null text counts as an empty one; the largest id of equal texts stays; of rows repeated
under one id and text, each is counted and each stays; a null id counts as the smallest and is kept only
where no other id holds the text; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, read
from ._shingles import mix

BUCKET = 512
_GAMMA = 2.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64(level * int(_STEP) % (1 << 64))
    return (mix(words[:, 0] + step) ^ words[:, 1]) % np.uint64(size)


def build_mph(words: np.ndarray) -> list[np.ndarray]:
    """The levels' bit arrays for distinct digests; they hold exactly one set bit per digest."""
    levels, left = [], words
    while len(left):
        size = max(8, int(_GAMMA * len(left)))
        at = _position(left, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of each digest, or -1 where no level has its bit."""
    out = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = _position(words[left], k, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        out[left[hit]] = base + rank[at[hit]]
        left, base = left[~hit], base + int(bits.sum())
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    levels = build_mph(words)
    order = np.argsort(slots(levels, words))
    return pd.DataFrame({
        "bucket": [pdf["bucket"].iloc[0]],
        "sizes": [[len(x) for x in levels]],
        "bits": [b"".join(np.packbits(x).tobytes() for x in levels)],
        "digests": [b"".join(pdf["digest"].iloc[order])],
        "winners": [pdf["winner"].to_numpy(dtype=object)[order].tolist()],
        "copies": [pdf["copies"].to_numpy()[order].tolist()],
    })


def _levels(sizes, bits: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        m = -(-int(n) // 8)
        out.append(np.unpackbits(np.frombuffer(bits, np.uint8, m, at), count=int(n)).astype(bool))
        at += m
    return out


def _best(a: str | None, b: str | None) -> str | None:
    """The larger of two ids, which are carried as text: a column of numbers with a null among them would come as
    doubles, which don't hold every id."""
    return b if a is None else a if b is None else max(a, b, key=int)


def _lookup(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    digests, keep, size = [], [], []
    member = np.zeros(len(batch), bool)
    if len(index):
        row = index.iloc[0]
        held = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]
        winners, copies = list(row["winners"]), list(row["copies"])
        if len(batch):
            at = slots(_levels(row["sizes"], row["bits"]), _words(batch["digest"]))
            for k, (slot, digest, winner, n) in enumerate(zip(at, batch["digest"], batch["winner"], batch["copies"], strict=True)):
                if slot >= 0 and held[slot] == digest:
                    member[k] = True
                    winners[slot], copies[slot] = _best(winners[slot], winner), copies[slot] + n
        digests, keep, size = list(held), list(winners), list(copies)
    rest = batch[~member]
    out = pd.DataFrame({"digest": digests + rest["digest"].tolist(), "keep_id": keep + rest["winner"].tolist(), "group_size": size + rest["copies"].tolist()})
    return out.astype({"keep_id": object, "group_size": "int64"})


_INDEX = "bucket long, sizes array<int>, bits binary, digests binary, winners array<string>, copies array<long>"


def distinct_digests(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest) as (digest, winner, copies), combined before the shuffle; the winner's id as text."""
    return rows.groupBy("digest").agg(F.max("doc_id").cast("string").alias("winner"), F.count("*").alias("copies"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the minimal perfect hash and its slots."""
    keyed = distinct_digests(history).withColumn("bucket", F.expr(f"pmod(xxhash64(digest), {buckets})"))
    return keyed.groupBy("bucket").applyInPandas(_build, _INDEX)


def resolve(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """(digest, keep_id, group_size) of every digest of the history and the batch."""
    keyed = distinct_digests(batch).withColumn("bucket", F.expr(f"pmod(xxhash64(digest), {buckets})"))
    found = index.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInPandas(_lookup, "digest binary, keep_id string, group_size long")
    return found.withColumn("keep_id", F.col("keep_id").cast("long"))


def exact_duplicates(history: DataFrame, batch: DataFrame) -> DataFrame:
    """One row for each row of either frame (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    def digests(df: DataFrame, old: bool) -> DataFrame:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        return df.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.lit(old).alias("old"))

    rows = materialize(digests(history, True).union(digests(batch, False)), "digests")
    buckets = max(1, math.ceil(rows.count() / BUCKET))
    index = materialize(build_index(rows.filter("old"), buckets), "index")
    winners = materialize(resolve(index, rows.filter("not old"), buckets), "winners")
    out = rows.join(winners, "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an even id are the history, the others the batch; the result doesn't depend on that."""
    docs = read(spark, sf_dir, "documents")
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    return exact_duplicates(docs.filter(even), docs.filter(~even))


OP8_SQL = """
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from (
  select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size, h as text_sha256
  from (select doc_id, sha256(coalesce(text, '')) as h from documents)
)
"""
