"""Places, quantiles, tests of paired rows, keyed tables, routing and reports, against plain functions."""

import math
import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from longview.operators import care_state as cs
from longview.operators import curation, places
from longview.operators import statistics as S
from longview.sources.keyed import KeyedTable


@pytest.mark.parametrize("parts, sample", [(1, 10), (4, 3), (64, 8192)])
def test_places_are_those_of_a_sort(spark, parts, sample):
    rng = random.Random(parts)
    rows = [(rng.choice([None, 1.0, 1.0, 2.5, rng.random()]), i) for i in range(300)]
    got = places.running(spark.createDataFrame(rows, "v double, k long"), ["v", "k"], parts=parts, sample=sample).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.v, r.k) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 301))


def test_running_sums_and_no_rows(spark):
    rows = spark.createDataFrame([(3, 5), (1, 2), (2, 10)], "v long, n long")
    assert {(r.v, r.upto) for r in places.running(rows, ["v"], "upto", "n").collect()} == {(1, 2), (2, 12), (3, 17)}
    assert places.running(rows.filter("v > 9"), ["v"]).count() == 0


@pytest.mark.parametrize("n", [4, 10, 20])
def test_exclusive_quantiles(spark, n):
    rng = random.Random(n)
    groups = {"a": [rng.choice([1.0, 2.0, rng.random()]) for _ in range(137)], None: [rng.random() for _ in range(25)], "two": [1.0, 5.0], "one": [7.0]}
    rows = [(g, v, i) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", None, 999), ("none", None, 1)]
    got = {(r.g, r.i): r.q for r in places.exclusive_quantiles(spark.createDataFrame(rows, "g string, v double, k long"), "g", "v", "k", n).collect()}
    want = {(g, i): q for g, vs in groups.items() for i, q in enumerate(plain.quantiles(vs, n=n) if len(vs) > 1 else vs * (n - 1), 1)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_paired_tests(spark):
    # values of a t table: 97.5 % points
    assert abs(S.t_quantile(0.975, 1) - 12.7062) < 1e-3 and abs(S.t_quantile(0.975, 9) - 2.262157) < 1e-5 and abs(S.t_quantile(0.975, 10**7) - 1.959964) < 1e-4
    a, b = [5.1, 4.9, 6.2, 5.8, 6.0, 5.5, 5.3, 6.7, 5.9, 6.1], [4.8, 5.0, 5.6, 5.4, 5.7, 5.6, 4.9, 6.0, 5.2, 5.9]
    rows = spark.createDataFrame([*zip(a, b, strict=True), (1.0, None)], "a double, b double")
    d = [x - y for x, y in zip(a, b, strict=True)]
    m, se = plain.mean(d), plain.stdev(d) / math.sqrt(10)
    r = S.paired_t_test(rows, "a", "b").first()
    assert r.n == 10 and abs(r.t - m / se) < 1e-6 and abs(r.low - (m - 2.2621571628 * se)) < 1e-6 and abs(r.high - (m + 2.2621571628 * se)) < 1e-6 and 0 < r.p < 0.05
    assert tuple(S.paired_t_test(rows.limit(1), "a", "b").first()) == (1, None, None, None, None)
    assert S.paired_t_test(rows.filter("a > 99"), "a", "b").first().n == 0
    ranks = sorted(abs(round(x, 9)) for x in d)
    rank = {v: plain.mean([i for i, x in enumerate(ranks, 1) if x == v]) for v in ranks}
    w = min(sum(rank[abs(round(x, 9))] for x in d if x > 0), sum(rank[abs(round(x, 9))] for x in d if x < 0))
    got = S.wilcoxon_test(rows, "a", "b").first()
    # two differences of 0.1 apart: the approximation with the ties' correction, worked out by hand
    ties = sum(t**3 - t for t in (ranks.count(v) for v in set(ranks)))
    sd = math.sqrt(10 * 11 * 21 / 24 - ties / 48)
    assert ties > 0 and (got.n, got.w) == (10, w) and abs(got.p - 2 * (1 - plain.NormalDist().cdf(abs(w - 27.5) / sd))) < 1e-8
    assert S.wilcoxon_test(rows.limit(5), "a", "b").first().p is None and tuple(S.wilcoxon_test(rows.filter("a > 99"), "a", "b").first()) == (0, 0.0, None)


def test_signed_ranks_exact_null(spark):
    """Published points of the exact distribution, and all signs gone through."""
    import itertools

    assert S.wilcoxon_p_value(0, 6) == 0.03125 and S.wilcoxon_p_value(8, 10) == 0.048828125 and abs(S.wilcoxon_p_value(52, 20) - 0.0484) < 1e-4
    for n, w in ((4, 3), (7, 9), (9, 20)):
        sums = [sum(r for r, up in zip(range(1, n + 1), signs, strict=True) if up) for signs in itertools.product((0, 1), repeat=n)]
        assert abs(S.wilcoxon_p_value(w, n) - min(1, 2 * sum(x <= w for x in sums) / 2**n)) < 1e-12
    rows = spark.createDataFrame([(float(x), 0.0) for x in (1, 2, -3, 4, 5, 6, 7, 8, 9, -10)], "a double, b double")
    assert tuple(S.wilcoxon_test(rows, "a", "b").first()) == (10, 13.0, round(S.wilcoxon_p_value(13, 10), 9))
    with_zero = rows.union(spark.createDataFrame([(1.0, 1.0)], "a double, b double"))
    assert abs(S.wilcoxon_test(with_zero, "a", "b").first().p - S.wilcoxon_p_value(13, 10, zeros=True)) < 1e-9 != S.wilcoxon_p_value(13, 10)
    noise = spark.createDataFrame([(0.1 + 0.2, 0.3), (1.0, 0.5), (0.5, 1.0)], "a double, b double")
    assert [S.paired(noise, "a", "b").first()[c] for c in ("above", "equal", "below")] == [1, 1, 1]


def test_spearman_with_many_ties(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 3)), float(rng.randint(0, 3)), i) for i in range(200)]
    place = lambda c: {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[c], r[2])))}
    x, y = place(0), place(1)
    want = plain.correlation([x[i] for i in range(200)], [y[i] for i in range(200)])
    got = S.spearman(spark.createDataFrame(rows, "a double, b double, k long"), "a", "b", "k").first()
    assert got.n == 200 and abs(got.r - want) < 1e-6


def test_within_one(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.25, 0.5), (0.0, 0.5), (None, 1.0)], "a double, b double")
    assert tuple(S.within_one(rows, "a", "b").first()) == (3, 1, 2, 0.666667)
    assert S.within_one(rows.filter("a > 9"), "a", "b").first().near_share is None


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, v string, _change string", ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string, _change string")
    got = lambda: sorted(((r.k, r.v) for r in t.read().collect()), key=str)
    assert got() == []
    t.upsert(rows((1, "a", "x"), (2, "b", "x"), (None, "n", "x")))
    t.upsert(rows((2, None, "y"), (3, "c", "y")))
    assert got() == sorted([(1, "a"), (2, None), (3, "c"), (None, "n")], key=str)
    t.delete(rows((1, "", ""), (1, "", ""), (9, "", "")))
    assert got() == sorted([(2, None), (3, "c"), (None, "n")], key=str)
    t.upsert(rows((1, "again", "z")))
    t.compact()
    assert {r._change for r in t.read().collect()} == {"x", "y", "z"}
    assert got() == sorted([(1, "again"), (2, None), (3, "c"), (None, "n")], key=str)
    again = KeyedTable(spark, str(tmp_path / "t"), t.schema, ["k"])
    assert (again.changes, again.first) == (t.changes, t.first) == (5, 5)
    again.upsert(rows((4, "d", "z")))
    t = KeyedTable(spark, str(tmp_path / "t"), t.schema, ["k"])
    assert got() == sorted([(1, "again"), (2, None), (3, "c"), (4, "d"), (None, "n")], key=str)
    with pytest.raises(ValueError):
        t.upsert(rows((1, "a", "x"), (1, "b", "x")))


def test_router(spark, monkeypatch):
    made = []

    def maker(name, fails=None):
        def make():
            made.append(name)
            if fails == "made":
                raise OSError("no index")
            return lambda q: spark.range(1).select(F.lit(name).alias("backend"), F.lit(q).alias("q") if fails != "run" else F.raise_error(F.lit("broken")).cast("string").alias("q"))
        return make

    r = curation.Router({"plain": maker("plain"), "dense": maker("dense"), "gone": maker("gone", "made"), "broken": maker("broken", "run")}, "plain", "backend string, q string")
    monkeypatch.delenv("RETRIEVAL_BACKEND", raising=False)
    ask = lambda **k: [x.backend for x in r.retrieve(spark, "q", **k).collect()]
    assert ask() == ["plain"] and ask(backend=" Dense ") == ["dense"] and ask(backend="both") == ["plain"] and ask(backend="?") == ["plain"]
    assert made == ["plain", "dense"]
    for name in ("gone", "broken"):
        assert ask(backend=name) == ["plain"] and ask(backend=name, fallback=False) == []
    monkeypatch.setenv("RETRIEVAL_BACKEND", "dense")
    assert ask() == ["dense"] and ask(backend="plain") == ["plain"]
    r.reset()
    ask()
    assert made.count("dense") == 2


def test_reports_and_cohorts(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "x string, n long")
    assert curation.markdown(rows) == "| x | n |\n| --- | --- |\n| a | 1 |\n|  | 2 |\n"
    with pytest.raises(ValueError):
        curation.markdown(rows, 1)
    people = spark.createDataFrame([(1, "1950-06-01"), (2, "1961-01-02"), (3, None)], "id long, born string")
    assert [r.id for r in curation.cohort(people, "born", "2026-01-01", 65).collect()] == [1]
    assert [r.x for r in curation.rendered(rows, "x", str.upper).collect()] == ["A", None]


@pytest.mark.parametrize("before, now, want", [
    (None, "STABLE", ("INITIAL", "NONE", 0.0, 0.5)), ("NO_DATA", "STABLE", ("INITIAL", "NONE", 0.0, 0.3)), ("STABLE", "STABLE", ("CONTINUATION", "STABLE", 0.0, 0.3)),
    ("STABLE", "MODERATE_ACTIVITY", ("ESCALATION", "UP", 3.0, 0.3)), ("HIGH_ACTIVITY", "LOW_ACTIVITY", ("DE_ESCALATION", "DOWN", 3.0, 0.3)), ("STABLE", "NO_DATA", ("DE_ESCALATION", "DOWN", 3.0, 0.3)),
])
def test_realtime_moves(spark, before, now, want):
    row = spark.createDataFrame([(before, now, None if before is None else 0.2, 0.5)], "p string, s string, a double, b double")
    move = cs.realtime_move(F.col("p"), F.col("s"), F.col("a"), F.col("b"))
    assert tuple(row.select(*(c.alias(n) for n, c in move.items())).first()) == want
