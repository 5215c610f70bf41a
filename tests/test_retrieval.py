"""The postings index and the vector store against brute force: several segments, lots, cells and bounds that skip."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from longview import storage
from longview.operators import postings, vectors
from longview.plans import retrieval
from tests.test_whole import best_windows, words, written


def corpus(rng, n):
    """Frequent and rare words, copies and a long document of many windows."""
    common = [words(rng, 1) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.7 else words(rng, 1) for _ in range(rng.randint(1, 220))), "src") for i in range(n)]
    rows += [(n + i, rows[i][1], "src") for i in range(20)] + [(n + 90, " ".join(rng.choice(common) for _ in range(9000)), "src"), (n + 91, None, "src"), (n + 92, "", "src")]
    asked = [(i, " ".join(rng.choice(common) for _ in range(5)) + " " + " ".join(rows[i][1].split()[:12])) for i in range(12)] + [(50, "nowhere"), (51, "the of"), (52, common[0] + " " + common[0])]
    return rows, asked


@pytest.mark.parametrize("seed", [1, 2])
def test_index_gives_the_best_documents(spark, monkeypatch, seed):
    monkeypatch.setattr(postings, "SEGMENT", 60)
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "SEEDS", 3)
    rng = random.Random(seed)
    docs, asked = corpus(rng, 150)
    want, df = best_windows(docs, asked)
    index = postings.write(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), 180, 40, storage.folder(spark, "index"))
    assert {r["term"]: r["df"] for r in index.stats.collect()} == df
    rows = spark.createDataFrame([(q, t) for q, text in asked for t in text.split() if t not in ("the", "of")], "query_id long, term string")
    for k in (1, 7, 400):
        got = {(r["query_id"], r["rank"]): (r["doc"], r["score"]) for r in postings.best(index, rows, k).collect()}
        assert {x: d for x, (d, _) in got.items()} == {(q, i + 1): d for q, found in want.items() for i, (d, _) in enumerate(found[:k])}
        assert all(math.isclose(s, want[q][i - 1][1], abs_tol=1e-8) for (q, i), (_, s) in got.items())


def test_lots_hold_their_postings(spark, monkeypatch):
    """Every posting is in one lot, in order, within its ends and below its highest impact, whatever the batches are."""
    monkeypatch.setattr(postings, "BLOCK", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    docs, _ = corpus(random.Random(3), 80)
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    try:
        index = postings.write(table, 180, 40, storage.folder(spark, "index"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lots = index.blocks.collect()
    assert len({(r["term"], r["seg"], r["lot"]) for r in lots}) == len(lots)
    got = Counter()
    for r in lots:
        assert r["docs"] == sorted(r["docs"]) and (r["docs"][0], r["docs"][-1], len(r["docs"])) == (r["first"], r["last"], r["n"]) and r["n"] <= 8
        assert math.isclose(r["high"], max(postings.impact(t, n, index.avgdl) for t, n in zip(r["tfs"], r["dls"], strict=True)))
        got.update({(r["term"], d, w): t for d, w, t in zip(r["docs"], r["windows"], r["tfs"], strict=True)})
    want = Counter({(t, d, i // 140 + 1): n for d, text, _ in docs for i in range(0, len((text or "").split()), 140) for t, n in Counter(text.split()[i : i + 180]).items()})
    assert got == want


def test_index_of_nothing(spark):
    index = postings.write(spark.createDataFrame([(1, None), (None, "word")], "doc_id long, text string"), 180, 40, storage.folder(spark, "index"))
    assert postings.best(index, spark.createDataFrame([(1, "word")], "query_id long, term string"), 3).count() == 0


def test_index_is_shared_while_files_stay(spark, tmp_path):
    made = []
    sf = written(spark, tmp_path, documents=([(1, "alpha")], "doc_id long, text string"))
    make = lambda path: made.append(path) or len(made)
    table = lambda: spark.read.parquet(f"{sf}/documents.parquet")
    assert [storage.shared(table(), "x", make), storage.shared(table(), "x", make), storage.shared(table(), "y", make)] == [1, 1, 2]
    written(spark, tmp_path, documents=([(1, "alpha"), (2, "beta")], "doc_id long, text string"))
    assert storage.shared(table(), "x", make) == 3


def clusters(n=1200, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(12, dim))[rng.integers(0, 12, n)] * 10 + rng.normal(0, 0.1, (n, dim))


def test_store_is_exact_and_skips_cells(spark, tmp_path):
    m = clusters()
    m[::3] = m[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None), (None, m[0].tolist()), (5001, [float("nan")] * 8)], "vec_id long, embedding array<double>")
    path = f"{tmp_path}/store"
    vectors.VectorStore.create(df.filter("vec_id < 700"), path)
    store = vectors.VectorStore.open(spark, path)
    store.extend(df.filter("vec_id >= 700"))
    assert sorted(r["id"] for r in store.read().collect()) == list(range(1200))
    far = {r["id"]: (r["far"], r["cell"]) for r in store.read().collect()}
    assert all(abs(np.linalg.norm(m[i] - store.centres[c]) - d) < 1e-6 * (1 + d) for i, (d, c) in far.items())
    rows, share = vectors.nearest(store, df.filter("vec_id % 20 = 0").select("vec_id", "embedding"), 6)
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in rows.collect()}
    for q in range(0, 1200, 20):
        s = np.round(m @ m[q], 9)
        best = sorted(range(1200), key=lambda i: (-s[i], i))[:6]
        assert [got[q, k + 1][0] for k in range(6)] == best
    seen = share.first()
    assert 0 < seen["visited"] < 0.6 * seen["cells"]


def test_store_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    store = vectors.VectorStore.create(none, f"{tmp_path}/store")
    rows, _ = vectors.nearest(store, none, 3)
    assert rows.count() == 0


def test_gold_of_passages_without_terms(spark, tmp_path):
    docs = [(1, "To be or not to be"), (2, "be to or"), (3, "the answer is 42"), (4, "THE\nANSWER is 42 !"), (5, None)]
    asked = [(1, "or not"), (2, "is 42"), (3, "the answer"), (4, " "), (5, "answer was")]
    sf = written(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(asked, "item_id long, text string"))
    assert {(r["query_id"], r["chunk_id"]) for r in retrieval._gold(spark, sf).collect()} == {(1, 1), (2, 3), (2, 4), (3, 3), (3, 4)}


def test_planted_conflict_lowers_consistency(spark):
    from longview.operators import reliability

    said = "walking every day with friends keeps joints healthy and this should "
    rows = [(1, 1, "walking for healthy joints", said + "be done", 1.0, 0.9), (1, 2, "walking for healthy joints", said + "not be done", 1.0, 0.9), (2, 1, "walking for healthy joints", said + "be done", 1.0, 0.9), (2, 2, "walking for healthy joints", said + "be done", 1.0, 0.9)]
    df = spark.createDataFrame(rows, "query_id long, rank int, question string, chunk string, authority double, cosine double")
    assert {(r["query_id"], r["conflict"]) for r in reliability.conflicts(df).collect()} == {(1, True), (2, False)}
    assert {r["query_id"]: r["consistency"] for r in reliability.reliability(df).collect()} == {1: 0.0, 2: 1.0}
