"""The search by segments: several blocks of questions, what it writes, and documents that hold all terms."""

import random

import numpy as np
from pyspark.sql import functions as F

from longview import storage
from longview.operators import postings, vectors
from tests.test_retrieval import corpus
from tests.test_whole import best_windows


def built(spark, docs):
    return postings.write(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), 180, 40, storage.folder(spark, "index"))


def asked_terms(spark, asked):
    return spark.createDataFrame([(q, t) for q, text in asked for t in text.split() if t not in ("the", "of")], "query_id long, term string")


def test_blocks_of_questions_give_the_same_lists(spark, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT", 60)
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "QUESTIONS", 4)
    docs, asked = corpus(random.Random(5), 120)
    want, _ = best_windows(docs, asked)
    rows = postings.best(built(spark, docs), asked_terms(spark, asked), 6)
    got = {(r["query_id"], r["rank"]): r["doc"] for r in rows.collect()}
    assert got == {(q, i + 1): d for q, found in want.items() for i, (d, _) in enumerate(found[:6])}


def test_search_writes_no_row_for_a_posting_of_a_question(spark, monkeypatch):
    """What is written grows with questions and their terms, not with questions times lots or postings."""
    monkeypatch.setattr(postings, "BLOCK", 2)
    docs, asked = corpus(random.Random(6), 150)
    index, terms, real, kept = built(spark, docs), asked_terms(spark, asked), storage.written, []

    def written(df, label):
        out = real(df, label)
        kept.append((label, out.count()))
        return out

    monkeypatch.setattr(storage, "written", written)
    postings.best(index, terms, 5)
    n = terms.distinct().count()
    assert sum(rows for _, rows in kept) <= 2 * n + len(asked) * (postings.SEEDS + 5), kept


def test_documents_that_hold_all_terms(spark, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT", 40)
    docs, asked = corpus(random.Random(7), 90)
    got = {(r["query_id"], r["doc"]) for r in postings.holding(built(spark, docs), asked_terms(spark, asked)).collect()}
    need = {q: {t for t in text.split() if t not in ("the", "of")} for q, text in asked}
    assert got == {(q, d) for q, terms in need.items() for d, text, _ in docs if terms and text and terms <= set(text.split())}
    assert any(q < 12 for q, _ in got)


def test_gaps_meet_only_the_documents_own_segment(spark):
    docs, _ = corpus(random.Random(8), 40)
    index = built(spark, docs)
    assert index.blocks.filter(F.size("docs") != F.col("n")).count() == 0
    rows = index.blocks.select("seg", F.explode("docs").alias("doc")).filter(F.col("seg") != postings.segment(F.col("doc"), index.segments))
    assert rows.count() == 0


def test_dense_search_sends_a_query_to_regions_not_to_cells(spark, monkeypatch, tmp_path):
    """Several regions, pieces and blocks give brute force's lists; a query is sent once a region at most, however many cells reach it."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(1500, 6))
    m[:500] = m[0]  # a third of all rows are one vector, in one cell of several pieces
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "REGION", 120)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "PER_CELL", 16)
    real, kept = storage.written, []

    def written(rows, label):
        out = real(rows, label)
        kept.append((label, out.count()))
        return out

    store = vectors.VectorStore.create(df, f"{tmp_path}/store")
    monkeypatch.setattr(storage, "written", written)
    rows, share = vectors.nearest(store, df.filter("vec_id % 20 = 0"), 4)
    got = {(r["query_id"], r["rank"]): r["id"] for r in rows.collect()}
    for q in range(0, 1500, 20):
        s = np.round(m @ m[q], 9)
        assert [got[q, k + 1] for k in range(4)] == sorted(range(1500), key=lambda i: (-s[i], i))[:4]
    _, n = store.balls()
    regions, seen = len(set(vectors._regions(n)[n > 0])), share.first()
    assert regions > 5 and seen["cells"] == 75 * int((n > 0).sum())
    assert sum(rows for _, rows in kept) <= 75 * (regions + vectors.FIRST + 2 + 2 * 4) < seen["visited"]


def test_index_writes_no_windows(spark, monkeypatch):
    """Only the postings and the terms are written; windows with their counts are made where a segment is."""
    docs, _ = corpus(random.Random(7), 60)
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    made = postings.counted_windows(table, 180, 40).select(F.explode("terms").alias("term")).groupBy("term").count()
    writer, paths = type(table.write), []
    real = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *more, **named: (paths.append(path.rsplit("/", 1)[1]), real(self, path, *more, **named))[1])
    index = built(spark, docs)
    assert sorted(paths) == ["blocks", "stats"]
    assert {tuple(r) for r in index.stats.select("term", "df").collect()} == {tuple(r) for r in made.collect()}


def test_index_sends_texts_once(spark, monkeypatch):
    """Texts go to their segments and nowhere else: how many windows there are, and how long, comes out with the postings."""
    docs, _ = corpus(random.Random(9), 60)
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    kind, sent = type(table), []
    dealt, mapped = kind.repartition, kind.mapInArrow

    def noted(df, how, *more):
        sent.extend([more] if "text" in df.columns else [])
        return how(df, *more)

    monkeypatch.setattr(kind, "repartition", lambda df, *more: noted(df, dealt, *more))
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *more: noted(df, mapped, *more))
    monkeypatch.setattr(postings, "SEGMENT", 20)
    index = built(spark, docs)
    monkeypatch.undo()
    assert index.segments > 2 and sent == [(index.segments, "seg")]
    windows = postings.counted_windows(table, 180, 40).agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    assert (index.n, index.avgdl) == (windows["n"], windows["mean"])


def test_gold_shuffles_no_texts_where_candidates_are_few(spark, sf, monkeypatch):
    from longview.plans import retrieval

    real, plans = storage.written, {}

    def written(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(storage, "written", written)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # below the documents' size
    try:
        assert retrieval._gold(spark, sf).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plans["gold"] and "SortMergeJoin" not in plans["gold"], plans["gold"]
