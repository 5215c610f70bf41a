"""The block matrix join and the ball trees against brute force, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longview.llm import _tiles, ball_tree, matrix_join

VEC = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [(1000, None, 1), (1020, [], 1), (1040, [0.0] * 6, 1), (1060, [NAN] * 6, 1), (1080, [None, 1.0], 1), (1100, [INF, 1.0], 1), (None, [1.0] * 6, 1)]


def vectors(spark, rows):
    names = ("v", "h", "rep", "data", "place", "part", "query", "found", "rank")
    return spark.createDataFrame(rows, VEC).select("*", *(F.lit(k).alias(k) for k in names))


def made(n=400, dim=6, seed=1):
    """Clusters, a vector that a third of all rows share, ties in whole numbers, and lengths far apart."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(5, dim))[rng.integers(0, 5, n)] + rng.normal(0, 0.2, (n, dim))
    m[rng.random(n) < 0.33] = np.linspace(0.1, 0.6, dim)
    m[::11] = np.rint(m[::11])
    m[5::50] *= 1000
    return [(i, m[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]


def plain_nearest(rows, every, k):
    known = {i: np.array(v) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    dim = max(map(len, known.values()))
    known = {i: np.pad(v, (0, dim - len(v))) for i, v in known.items()}

    def score(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += float(x) * float(y)
        return total

    out = []
    for q in sorted(i for i in known if i % every == 0):
        best = sorted(((-score(known[q], v), i) for i, v in known.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_nearest_brute_force(spark, monkeypatch, small):
    if small:  # many cells, blocks and rounds
        monkeypatch.setattr(_tiles, "CELL", 40)
        monkeypatch.setattr(matrix_join, "BLOCK", 16)
        monkeypatch.setattr(matrix_join, "QUERIES", 4)
    rows = made() + ODD + [(2000, [1.0, 2.0], 1)]
    got = matrix_join.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_nearest(rows, 20, 7)


def test_nearest_few_repeated_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.5, 9.0], 2), (20, [1.0, 0.0], 1), (21, [-0.0, 2.0], None)]
    got = sorted(map(tuple, matrix_join.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 20, 1.0), (0, 2, 21, 0.0), (20, 1, 0, 1.0), (20, 2, 21, 0.0)]
    assert matrix_join.nearest(vectors(spark, rows[3:4]), F.col("vec_id") % 20 == 0).count() == 0
    assert matrix_join.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert matrix_join.nearest(vectors(spark, ODD[:2]), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_extreme_components(spark):
    rows = [(i, [10.0 ** (300 - 40 * i), 1.0], 1) for i in range(16)] + [(20, [-1e300, 1.0], 1), (40, [5e-324, 0.0], 1)]
    got = sorted(tuple(r) for r in matrix_join.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 4).collect())
    assert [r[:3] for r in got] == [r[:3] for r in plain_nearest(rows, 20, 4)]


def test_codes_bound_every_product():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 33)) * 10.0 ** rng.integers(-5, 5, (50, 1)), rng.normal(size=(60, 33))
    x, y = matrix_join.coded(a), matrix_join.coded(b)
    product = x["scale"][:, None] * (x["codes"].astype(float) @ y["codes"].T) * y["scale"]
    error = (x["near"] + x["rest"])[:, None] * y["rest"] + x["rest"][:, None] * y["near"]
    assert (np.abs(product - a @ b.T) <= error * (1 + 1e-9) + 1e-12).all() and error.max() < 1e8


def plain_negatives(rows, every):
    known = {i: (tuple(int(np.floor(256 * x)) for x in v), lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)}
    dim = max(len(v) for v, _ in known.values())
    known = {i: (v + (0,) * (dim - len(v)), lab) for i, (v, lab) in known.items()}
    out = []
    for a, (q, lab) in sorted(known.items()):
        if a % every:
            continue
        s = {i: sum(x * y for x, y in zip(q, v, strict=True)) for i, (v, _) in known.items() if i != a}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if known[i][1] == lab][:5]:
            far = [i for i in order if known[i][1] != lab and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            out += [(a, p, r + 1, n, s[p], s[n]) for r, n in enumerate(far)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(_tiles, "CELL", 40)
        monkeypatch.setattr(ball_tree, "ANCHORS", 3)
    rows = [(i, v, None if i % 97 == 3 else lab) for i, v, lab in made(500)] + ODD + [(1050, [0.3, 0.2], 2)]
    got = ball_tree.hard_negatives(ball_tree.clean(vectors(spark, rows)), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 50)
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_few_and_none(spark):
    ask = lambda rows: sorted(map(tuple, ball_tree.hard_negatives(ball_tree.clean(vectors(spark, rows)), F.col("vec_id") % 50 == 0).collect()))
    assert ask([]) == [] and ask(ODD[:1]) == [] and ask([(0, [1.0], 1)]) == []
    same = [(0, [1.0], 1), (0, [1.0], 1), (50, [1.0], 1), (3, [0.75], 2), (4, [0.75], 2), (5, [0.75], 2), (6, [0.75], 2), (7, [0.1], 2)]
    p, n = 256 * 256, 256 * 192
    assert ask(same) == sorted((a, b, r + 1, i, p, n) for a, b in ((0, 50), (50, 0)) for r, i in enumerate((3, 4, 5)))


def test_negatives_beyond_doubles(spark):
    rows = [(0, [2.0**60, 1.0], 1), (1, [2.0**59, 3.0], 1), (2, [2.0**58, 1.0], 2), (3, [2.0**40, 1.0], 2)]
    got = ball_tree.hard_negatives(ball_tree.clean(vectors(spark, rows)), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r)[:2] for r in got] == [] and all(r["positive_score"] == (1 << 63) - 1 for r in got)


def test_tree_bounds_and_pruning(monkeypatch):
    """Every node's ball holds its rows; clustered rows let whole nodes go, and what is left gives the brute-force list."""
    monkeypatch.setattr(ball_tree, "LEAF", 8)
    rng = np.random.default_rng(7)
    m = np.rint(rng.normal(size=(12, 4))[rng.integers(0, 12, 900)] * 300 + rng.normal(0, 3, (900, 4)))
    ids, labels = np.arange(900), rng.integers(0, 4, 900)
    t = ball_tree.tree(m, ids, labels)
    for (lo, hi), c, r in zip(t["spans"], t["centre"], t["radius"], strict=True):
        assert np.sqrt(((t["m"][lo:hi] - c) ** 2).sum(1)).max() <= r
    assert (t["spans"][-1][1] - t["spans"][-1][0]) <= 8 and sorted(t["ids"]) == list(range(900))
    given = [np.array([int(m[i] @ m[i])]) for i in range(20)]
    head = _tiles.unpack(ball_tree._head(m[:20], ids[:20], labels[:20], np.array(given, dtype=object)[:, 0].reshape(-1, 1)))
    asked = ball_tree._Windows(head, {}, 3, False)
    entered = []
    leaf = asked.leaf
    asked.leaf = lambda w, *rest: (entered.append(len(w)), leaf(w, *rest))
    list(asked.meet(0, t))
    leaves = (len(t["spans"]) + 1) // 2
    assert sum(entered) < 0.5 * 20 * leaves
    for w in range(20):
        s = m @ m[w]
        lo, hi = ball_tree.windows(int(m[w] @ m[w]))
        fit = [i for i in sorted(range(900), key=lambda i: (-s[i], i)) if labels[i] != labels[w] and lo <= s[i] <= hi][:3]
        assert asked.ids[w, : asked.n[w]].tolist() == fit
