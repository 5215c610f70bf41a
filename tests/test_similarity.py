"""Similar sets against brute force, and what is written on the way."""

import random

import pyarrow as pa

from longview import storage
from longview.operators import similarity


def sets(rng, n):
    """Sets of frequent and rare tokens, near copies around the threshold, and copies."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, rng.sample(words, rng.randint(1, 60))) for i in range(n)]
    for i in range(0, n, 3):
        kept = [w for w in rows[i][1] if rng.random() < 0.85]
        rows.append((n + i, kept + [rng.choice(words)]))
    return rows + [(5 * n + i, list(reversed(rows[i % 3][1])) + rows[i % 3][1][:1]) for i in range(12)] + [(9 * n, []), (9 * n + 1, [])]


def test_pairs_are_those_of_brute_force(spark):
    rows = sets(random.Random(1), 60)
    for threshold in (0.5, 0.6, 1.0):
        got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), threshold).collect()}
        want = {(a, b): round(len(set(s) & set(t)) / len(set(s) | set(t)), 6) for a, s in rows for b, t in rows if a < b and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= threshold}
        assert got == want and len(want) > 20


def test_sets_that_share_frequent_tokens_are_no_pairs(spark, monkeypatch):
    """Unlike sets that meet at many tokens are dropped within the join; copies are compared once."""
    rng, real, kept = random.Random(2), storage.written, {}

    def written(df, label):
        out = real(df, label)
        kept[label] = out.count()
        return out

    monkeypatch.setattr(storage, "written", written)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, rng.sample(words, 100)) for i in range(80)] + [(100 + i, words[:100]) for i in range(40)]
    got = similarity.jaccard_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.6).count()
    assert got == 40 * 39 // 2 and kept["classes"] == 81 and kept["pairs"] == 0


def test_blocks_meet_only_where_sizes_can_be_similar(spark, monkeypatch):
    """Many small blocks, several of one size and meetings in parts give the pairs of brute force; a set is one row for each tile that it is in,
    not for each of its tokens, and goes only where partners can be."""
    rng, real, kept = random.Random(3), storage.written, {}

    def written(df, label):
        out = real(df, label)
        kept[label] = out
        return out

    monkeypatch.setattr(storage, "written", written)
    for name, value in (("BLOCK", 8), ("MET", 50), ("HELD", 3), ("WORDS", 4)):
        monkeypatch.setattr(similarity, name, value)
    rows = sets(rng, 60) + [(10000 + i, rng.sample([f"w{k}" for k in range(12)], 6)) for i in range(40)]
    rows += [(20000 + i, [f"v{k}" for k in range(900) if k % 9 != i]) for i in range(3)]
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.6).collect()}
    want = {(a, b): round(len(set(s) & set(t)) / len(set(s) | set(t)), 6) for a, s in rows for b, t in rows if a < b and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.6}
    assert got == want and len(want) > 50
    assert kept["signed"].count() == kept["classes"].count() and kept["pairs"].count() == kept["pairs"].distinct().count()
    tiles = similarity._tiles(kept["signed"], 0.6)
    assert tiles.groupBy("tile").count().count() > 20 and tiles.groupBy("tile").count().agg({"count": "max"}).first()[0] < 40
    sizes = tiles.groupBy("tile").agg({"n": "min"}).join(tiles.groupBy("tile").agg({"n": "max"}), "tile").collect()
    assert all(r["min(n)"] >= 0.6 * 0.6 * r["max(n)"] - 2 for r in sizes)


def test_pairs_of_a_tile_are_counted_by_tokens(monkeypatch):
    """Each set is there once, however many pairs it has; pairs come in any order and are counted in parts."""
    monkeypatch.setattr(similarity, "MET", 20)
    rng = random.Random(5)
    rows = [(7 * i, sorted(rng.sample([f"w{k}" for k in range(40)], rng.randint(1, 30)))) for i in range(30)]
    rng.shuffle(rows)
    pairs = rng.sample([(a, b) for a, _ in rows for b, _ in rows if a < b], 200)
    table = lambda names, got: pa.table(dict(zip(names, map(list, zip(*got, strict=True)), strict=True)))
    got = similarity._common(table(["a", "b"], pairs), table(["node", "tokens"], rows)).to_pylist()
    of = dict(rows)
    assert sorted((r["a"], r["b"], r["na"], r["nb"], r["k"]) for r in got) == sorted((a, b, len(of[a]), len(of[b]), len(set(of[a]) & set(of[b]))) for a, b in pairs)
    assert similarity._common(table(["a", "b"], pairs).slice(0, 0), table(["node", "tokens"], rows)).num_rows == 0
