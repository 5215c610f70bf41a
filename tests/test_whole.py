"""Queries that do the whole job, against brute force over small tables with what a cut would lose."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from longview.functions.text import STOP_WORDS
from longview.operators import statistics
from longview.plans import corpus, relational, retrieval


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(2)) for _ in range(n))


@pytest.fixture(scope="module")
def passages(spark, tmp_path_factory):
    """Documents of several windows, with each passage as a line far from the start of one of them."""
    rng = random.Random(5)
    asked = [(i, words(rng, 12)) for i in range(6)]
    docs = [(i, f"{words(rng, rng.randint(150, 400))}\n{asked[i][1]}\n{words(rng, 90)}" if i < 6 else words(rng, rng.randint(1, 500)), "src") for i in range(24)]
    docs += [(24, None, "src"), (25, " \n", "src")]
    turn = [2 * math.pi * i / 24 for i in range(24)]
    vectors = [(i, [math.cos(x), math.sin(x)]) for i, x in enumerate(turn)]  # unit vectors, as documents' are
    tables = {"documents": (docs, "doc_id long, text string, source string"), "benchmark": (asked, "item_id long, text string"), "embeddings": (vectors, "vec_id long, embedding array<float>")}
    return written(spark, tmp_path_factory.mktemp("passages"), **tables), docs, asked


def best_windows(docs, asked):
    """BM25 of all windows; {query: [(document, score)]}, each document by its best window."""
    windows = []
    for d, text, _ in docs:
        w = (text or "").split()
        windows += [(d, Counter(w[s : s + 180])) for s in range(0, len(w), 140)]
    df = Counter(t for _, c in windows for t in c)
    n, avgdl = len(windows), sum(sum(c.values()) for _, c in windows) / len(windows)
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, text in asked:
        best = {}
        for d, c in windows:
            hit = [t for t in text.split() if t in c]
            part = [(floor if raw[t] < 0 else raw[t]) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl)) for t in hit]
            if hit:
                best[d] = max(best.get(d, -math.inf), round(sum(part), 9))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    return out, df


def test_all_windows_are_indexed(spark, passages):
    sf, docs, asked = passages
    want, df = best_windows(docs, asked)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.j1_bm25(spark, sf).collect()}
    assert {k: d for k, (d, _) in got.items()} == {(q, i + 1): d for q, rows in want.items() for i, (d, _) in enumerate(rows[:10])}
    assert all(math.isclose(s, want[q][i - 1][1], abs_tol=2e-6) for (q, i), (_, s) in got.items())
    assert {r["term"]: r["df"] for r in retrieval.a14_index(spark, sf).collect()} == df
    assert retrieval.j15_ir(spark, sf).first()["recall_1"] == 1.0
    assert {r["chunk_id"] for r in retrieval.j4_rerank(spark, sf).filter("place = 1 and cover = 1").collect()} == set(range(6))
    fused = retrieval.c5_fusion(spark, sf).collect()
    both = {(r["query_id"], r["chunk_id"]) for r in fused if r["dense"] > 0 and r["sparse"] > 0}
    assert both >= {(i, i) for i in range(6)} and any(r["dense"] == 0 for r in fused)
    assert {(r["query_id"], r["chunk_id"]) for r in retrieval._gold(spark, sf).collect()} == {(i, i) for i in range(6)}


def test_every_passage_is_asked_whole(spark, tmp_path):
    rng = random.Random(8)
    asked = [(i, words(rng, 60)) for i in range(45)]
    docs = [(i, text, "src") for i, text in asked] + [(100 + i, " ".join(text.split()[:30]), "src") for i, text in asked]
    sf = written(spark, tmp_path, documents=(docs, "doc_id long, text string, source string"), benchmark=(asked, "item_id long, text string"))
    want, _ = best_windows(docs, asked)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.j1_bm25(spark, sf).collect()}
    assert {q for q, _ in got} == set(range(45))
    assert all(math.isclose(s, want[q][i - 1][1], abs_tol=2e-6) for (q, i), (_, s) in got.items())
    assert retrieval.j15_ir(spark, sf).first()["questions"] == 45


def test_dense_asks_every_twentieth_vector(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("longview.operators.vectors.PER_CELL", 16)
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(130)] + [(200, None)]
    sf = written(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>"))
    got = [(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in retrieval.j2_dense(spark, sf).collect()]
    want = []
    for q, v in rows[:130:20]:
        best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in rows[:130])
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best[:5])]
    assert sorted(got) == sorted(want)


def term_set(text):
    return {w for w in re.findall("[a-z]{3,}", text.lower()) if w not in STOP_WORDS}


def test_near_copies_are_compared_whole(spark, tmp_path):
    rng = random.Random(4)
    docs, base = [], [words(rng, 40).split() for _ in range(4)]
    for i in range(60):
        w = [x if rng.random() < rng.choice([1, 0.9, 0.7]) else words(rng, 1) for x in base[i % 4]]
        docs.append((i, " ".join(w[:20]) + "\n" + " ".join(w[20:]) + rng.choice(["\nshared last line here", "\n" + words(rng, 5)])))
    docs += [(60, "alpha"), (61, "alpha"), (62, "one of\n"), (63, None)]
    asked = [(0, " ".join(base[0])), (1, "alpha")]
    sf = written(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(asked, "item_id long, text string"))
    sets = {i: term_set(t) for i, t in asked} | {i + 1000000: term_set(t or "") for i, t in docs}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r["a"], r["b"]): r["jaccard"] for r in corpus.c7_neardup(spark, sf).collect()} == want and len(want) > 20


def test_fuzzy_matches_in_whole_texts(spark, tmp_path):
    text = " ".join(["filler"] * 250) + " hospital cat"
    sf = written(spark, tmp_path, documents=([(0, text), (1, "cat"), (2, None)], "doc_id long, text string"), benchmark=([(0, "hospice cat bird cat"), (1, "cat bird"), (2, "cat")], "item_id long, text string"))
    assert {r["item_id"]: r["matches"] for r in corpus.b26_fuzzy(spark, sf).collect()} == {0: 3, 1: 1}


def test_all_orders_are_sorted_and_placed(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 40), f"2024-01-{rng.randint(1, 28):02d}", "1-URGENT", rng.choice([None, *map(float, range(0, 3000, 7))])) for i in range(400)]
    sf = written(spark, tmp_path, orders=(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_totalprice double"))
    by_customer = sorted(sorted(rows, key=lambda r: (r[2], -r[0]), reverse=True), key=lambda r: r[1])
    assert [r["o_orderkey"] for r in relational.f1_sort(spark, sf).collect()] == [r[0] for r in by_customer]
    want = {r[0]: (k + 1, "PRIMARY" if k < 50 else "RESERVE") for k, r in enumerate(sorted(rows, key=lambda r: (r[4] is None, -(r[4] or 0), r[0])))}
    assert {r["o_orderkey"]: (r["place"], r["part"]) for r in relational.f7_reserve(spark, sf).collect()} == want


def test_bootstrap_draws_the_whole_group(spark, monkeypatch):
    drawn = []
    real = np.random.default_rng

    class Watched:
        def __init__(self, seed):
            self.rng = real(seed)

        def multinomial(self, n, p, size):
            drawn.append((n, size))
            return self.rng.multinomial(n, p, size)

    monkeypatch.setattr(np.random, "default_rng", Watched)
    schema = "g string, mean double, low double, high double"
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", lambda self, run, kind: (run, kind))
    run, kind = statistics.bootstrap_means(spark.createDataFrame([("a", 0.0, 1)], "g string, v double, n long"), "g", "v", "n")
    assert kind == schema
    import pandas as pd

    for n in (5, 900, 3000, 10**9):
        drawn.clear()
        row = run(pd.DataFrame({"g": ["a", "a"], "v": [0.0, 1.0], "n": [n, 3 * n]})).iloc[0]
        half = 1.96 * math.sqrt(0.25 * 0.75 / (4 * n))
        assert row["mean"] == 0.75 and {m for m, _ in drawn} == {4 * n} and sum(k for _, k in drawn) == 10000
        if n >= 900:
            assert abs(row["low"] - (0.75 - half)) < 0.15 * half + 1e-6 and abs(row["high"] - (0.75 + half)) < 0.15 * half + 1e-6


def test_history_has_whole_messages(spark, tmp_path):
    rows = [(1, 2, "assistant", "b" * 300), (1, 1, "user", "a" * 81), (1, 3, "user", None), (2, 1, "user", "short")]
    sf = written(spark, tmp_path, conversations=(rows, "conv_id long, turn int, role string, text string"))
    got = {r["conv_id"]: r["history"] for r in corpus.b32_prompt(spark, sf).collect()}
    assert got == {1: "[1] user: " + "a" * 81 + "\n[2] assistant: " + "b" * 300, 2: "[1] user: short"}
