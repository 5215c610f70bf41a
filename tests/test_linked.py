"""Intervals, identities and acceptance against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from longview.functions import text as X
from longview.operators import acceptance, identity, intervals, similarity
from longview.plans import linked

DAY = dt.date(2020, 1, 1)
POINT, WINDOW = "entity string, at date, n long", "entity string, first date, last date, window long, gap boolean"


def test_blocks_cover_exactly(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 1, 2, 7, 100, 5000])) for a in (rng.randint(-3000, 3000) for _ in range(60))] + [(5, 4), (0, 0), (-8, 7)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", intervals.blocks(F.col("a"), F.col("b")).alias("blocks")).collect()
    for r in rows:
        held = [x for b in r["blocks"] for x in range(b["block"] << b["level"], (b["block"] + 1) << b["level"])]
        assert sorted(held) == list(range(r["a"], r["b"] + 1)) and len(r["blocks"]) <= 26


def plain_holder(p, windows, carried):
    entity, at, _ = p
    if entity is None or at is None:
        return None, None
    own = sorted((w for w in windows if w[0] == entity), key=lambda w: (w[1] or dt.date.min, w[3]))
    hold = [w for w in own if (w[1] is None or w[1] <= at) and (w[2] is None or at <= w[2])]
    if hold:
        return hold[0][3], "CONTAINS"
    if carried:
        own = [w for w in own if w[1] is None or w[1] <= at]
    good = [w for w in own if not w[4]]
    return (good[-1][3], "LAST_KNOWN") if good else (own[-1][3], "LAST") if own else (None, None)


@pytest.mark.parametrize("carried", [False, True])
def test_containing(spark, carried):
    """Overlapping, open, reversed and missing windows of any length; an entity with half of all rows."""
    rng = random.Random(2)
    who = lambda: rng.choice(["a", "a", "a", "b", "c", "d"])
    day = lambda: DAY + dt.timedelta(rng.randint(-900, 900))
    windows = []
    for k in range(120):
        first, owner = day(), who()
        windows.append((owner, None if k % 17 == 0 and owner == "a" else first, None if k % 13 == 0 and owner == "a" else first + dt.timedelta(rng.choice([-3, 0, 1, 5, 30, 400])), k, rng.random() < 0.4 or k % 6 == 0))
    windows = [w for w in windows if w[0] != "d" or w[4]] + [(None, DAY, DAY, 500, False)]
    points = [(rng.choice(["a", "a", "b", "c", "d", "e"]), day(), n) for n in range(300)] + [(None, DAY, 900), ("a", None, 901)]
    got = intervals.containing(spark.createDataFrame(points, POINT), spark.createDataFrame(windows, WINDOW), carried).collect()
    want = {p[2]: plain_holder(p, windows, carried) for p in points}
    assert {r["n"]: (r["window"], r["how"]) for r in got} == want and len(got) == len(points)
    assert {h for _, h in want.values()} == {"CONTAINS", "LAST_KNOWN", "LAST", None}


def test_containing_nothing(spark):
    none, some = spark.createDataFrame([], WINDOW), spark.createDataFrame([("a", DAY, 1)], POINT)
    assert [tuple(r) for r in intervals.containing(some, none).collect()] == [("a", DAY, 1, None, None)]
    assert intervals.containing(some.limit(0), none).count() == 0


def test_same_records(spark):
    """Equal to union-find over three kinds of keys, a third of all records with one of them."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 2000, 2001]), "hot" if i % 3 == 0 and i < 300 else rng.choice([None, f"p{rng.randint(0, 400)}"]), rng.choice([None, f"d{rng.randint(0, 500)}"]), rng.choice([None, f"p{rng.randint(0, 400)}"])) for i in range(600)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in (2, 3, 4):
        seen = {}
        for r in rows:
            if r[k] is not None:
                parent[root(r[0])] = root(seen.setdefault(r[k], r[0]))
    groups = {}
    for r in rows:
        groups.setdefault(root(r[0]), []).append(r)
    want = {r[0]: (min(g, key=lambda x: (x[1] or 9999, x[0]))[0], len(g)) for g in groups.values() for r in g}
    df = spark.createDataFrame(rows, "id long, year int, pmid string, doi string, pmcid string")
    got = identity.same_records(df, {c: F.col(c) for c in ("pmid", "doi", "pmcid")}, [F.coalesce("year", F.lit(9999))]).collect()
    assert {r["id"]: (r["duplicate_group"], r["size"]) for r in got} == want and len(got) == 600
    assert all(r["kept"] == (r["duplicate_group"] == r["id"]) for r in got) and len(groups) < 400


def test_a_chain_of_records(spark):
    """A long chain, each record tied to the next by another key, is one group."""
    df = spark.createDataFrame([(i, f"k{i}", f"k{i + 1}") for i in range(200)], "id long, x string, y string").withColumn("y", F.col("y"))
    rows = df.select("id", F.array("x", "y").alias("k"))
    got = identity.same_records(rows, {"low": F.col("k")[0], "odd": F.when(F.col("id") % 2 == 1, F.lit("same"))}, [F.lit(0)]).collect()
    assert {r["duplicate_group"] for r in got if r["id"] % 2} == {1} and all(r["size"] == 1 for r in got if r["id"] % 2 == 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["component"] for r in identity.components(edges).collect()} == {0}


def greedy(rows, similar, caps):
    near, taken, out = {}, {}, {}
    for a, b in similar:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        values = [(c, v) for c, v in zip(caps, r[2:], strict=True) if v is not None]
        good = not any(out.get(x) for x in near.get(r[0], ())) and all(taken.get(v, 0) < caps[v[0]] for v in values)
        out[r[0]] = good
        for v in values if good else []:
            taken[v] = taken.get(v, 0) + 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_acceptance_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 30), rng.choice("aaab") if rng.random() < 0.9 else None, rng.randint(0, 25)) for i in range(150)]
    similar = [(rng.randint(0, 149), rng.randint(0, 149)) for _ in range(160 * (seed - 1))]
    similar = [(a, b) for a, b in similar if a != b]
    caps = {"kind": 30, "chunk": 2}
    out, rounds = acceptance.accept(spark.createDataFrame(rows, "id long, place int, kind string, chunk long"), spark.createDataFrame(similar, "a long, b long"), caps)
    got = {r["id"]: r["accepted"] for r in out.collect()}
    assert got == greedy(rows, similar, caps) and any(got.values()) and 1 <= rounds < 60


def test_acceptance_over_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null")
    pairs = similarity.jaccard_pairs(docs.select(F.col("doc_id").alias("id"), X.terms(F.col("text")).alias("tokens")), linked.ALIKE).collect()
    rows = [(r["doc_id"], -len(r["text"]), r["source"], r["lang"]) for r in docs.collect()]
    want = greedy(rows, [(p["a"], p["b"]) for p in pairs], {"source": linked.PER_SOURCE, "lang": linked.PER_LANG})
    assert {r["doc_id"]: r["accepted"] for r in linked.e10_rounds(spark, sf).collect()} == want
