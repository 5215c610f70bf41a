import math

import pytest
from pyspark.sql import functions as F

from longview.functions import scores, text, values
from longview.operators import chunking, gate, reliability, sampling, similarity, statistics


def one(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column.alias("x")).first()["x"]


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.33, 0.34, 0.5, 0.67, 0.75, 1.0)], ["x"])
    got = [tuple(r) for r in rows.select(scores.window_state(F.col("x")), scores.level(F.col("x"))).collect()]
    assert got == [("STABLE", "LOW"), ("LOW_ACTIVITY", "LOW"), ("LOW_ACTIVITY", "LOW"), ("LOW_ACTIVITY", "MODERATE"), ("MODERATE_ACTIVITY", "MODERATE"), ("MODERATE_ACTIVITY", "HIGH"), ("HIGH_ACTIVITY", "HIGH"), ("HIGH_ACTIVITY", "HIGH")]


@pytest.mark.parametrize("raw,as_float,as_int", [("3.0", 3.0, 3), ("", 0.0, -1), (" x ", 0.0, -1), ("NaN", 0.0, -1), ("Infinity", 0.0, -1), ("1e3", 1000.0, 1000), (None, 0.0, -1)])
def test_lenient_numbers(spark, raw, as_float, as_int):
    df = spark.createDataFrame([(raw,)], "r string").select(values.safe_float(F.col("r")), values.safe_int(F.col("r"), -1))
    assert tuple(df.first()) == (as_float, as_int)


def test_dates(spark):
    assert str(one(spark, values.local_date(F.col("s")), s="2024-03-31T23:30:00-05:00")) == "2024-03-31"
    assert one(spark, values.local_date(F.col("s")), s="March") is None
    assert one(spark, values.utc_timestamp(F.col("s")), s="soon") is None


def test_references(spark):
    uuid = "0a1b2c3d-0000-4000-8000-000000000001"
    assert one(spark, values.is_uuid(F.col("s")), s=f"urn:uuid:{uuid}") and not one(spark, values.is_uuid(F.col("s")), s="Aspirin")
    assert one(spark, values.reference_id(F.col("s")), s=f"urn:uuid:{uuid}") == uuid
    assert one(spark, values.without_zeros(F.col("s")), s="000") == "0"


def test_text(spark):
    assert one(spark, F.array_join(text.split_words(F.col("s")), "|"), s="A b  C") == "a|b|c"
    assert one(spark, text.normalise_span(F.col("s")), s="Exam­ ple​ of hyphen-\nation!") == "example of hyphenation"
    assert one(spark, text.answer_only(F.col("s")), s="<think>no\nno</think>Answer: yes\nSources:\n1") == "yes"
    assert one(spark, text.clean(F.col("s")), s="a\r\n\r\n\r\n 12 \r\nb") == "a\n\nb"
    assert one(spark, F.size(text.sentences(F.col("s"))), s="One. Two! three? Four.") == 3
    empty = F.array().cast("array<string>")
    assert one(spark, text.jaccard(empty, empty), s="") == 0.0
    assert one(spark, text.coverage(empty, F.array(F.lit("a"))), s="") == 1.0
    assert one(spark, text.fuzzy_equal(F.lit("hospital"), F.lit("hospice")), s="") and not one(spark, text.fuzzy_equal(F.lit("cat"), F.lit("ca")), s="")


@pytest.mark.parametrize("cosine,want", [(-1, 0.0), (-0.5, 0.25), (0, 0.5), (0.5, 0.75), (1, 1.0)])
def test_cosine_to_relevance(spark, cosine, want):
    e = spark.createDataFrame([(1, 1, "blood pressure advice", "blood pressure", 1.0, float(cosine))], "query_id long, rank int, question string, chunk string, authority double, cosine double")
    assert reliability.reliability(e).first()["relevance"] == want


def evidence(spark, rows):
    return spark.createDataFrame([(1, k + 1, "managing blood pressure daily", t, float(a), float(c)) for k, (a, c, t) in enumerate(rows)], "query_id long, rank int, question string, chunk string, authority double, cosine double")


GOOD, OFF = "managing blood pressure daily with care", "unrelated words entirely"


@pytest.mark.parametrize("first,second,final,retrievals,refinements,refused", [
    ([(1.0, 0.9, GOOD)], [(1.0, 0.9, GOOD)], "ACCEPT", 1, 0, False),
    ([(1.0, 0.0, GOOD), (1.0, 0.0, GOOD), (1.0, 0.0, OFF)], [(1.0, 0.9, GOOD)], "ACCEPT", 1, 1, False),
    ([(1.0, -1.0, GOOD)], [(1.0, 0.9, GOOD)], "REFINE", 1, 1, False),
    ([(0.5, -1.0, GOOD)], [(1.0, 0.9, GOOD)], "ACCEPT", 2, 0, False),
    ([(0.5, -1.0, GOOD)], [(0.5, -1.0, GOOD)], "RE-RETRIEVE", 2, 0, True),
    ([(0.1, -1.0, OFF)], [(1.0, 0.9, GOOD)], "REJECT", 1, 0, True),
])
def test_gate(spark, first, second, final, retrievals, refinements, refused):
    r = gate.run(evidence(spark, first), evidence(spark, second)).first()
    assert (r["final_decision"], r["retrievals"], r["refinements"], r["refused"]) == (final, retrievals, refinements, refused)


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        reliability.check_weights({"authority": 1.0})
    with pytest.raises(ValueError):
        reliability.check_thresholds(0.5, 0.6, 0.4)


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, ""), (3, "a b")], ["doc_id", "text"])
    rows = {(r["doc_id"], r["chunk_id"]): (r["start"], r["words"]) for r in chunking.word_windows(docs, 180, 40).collect()}
    assert rows == {(1, 1): (0, 180), (1, 2): (140, 160), (1, 3): (280, 20), (3, 1): (0, 2)}
    with pytest.raises(ValueError):
        chunking.word_windows(docs, 40, 40)


def test_paragraph_fold():
    long = " ".join(f"Word{i} is here." for i in range(200))
    parts = chunking.fold_paragraphs("a b\n\nc d\n" + long + "\ne", 3, 300)
    assert parts[:2] == ["a b", "c d"] and parts[-1] == "e" and all(len(p.split()) <= 300 for p in parts)


def test_jaccard_pairs(spark):
    import random

    rng = random.Random(3)
    sets = {i: {rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))} for i in range(60)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], ["id", "tokens"])
    got = {(r["a"], r["b"]) for r in similarity.jaccard_pairs(rows, 0.7).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}


def test_allocation():
    got = sampling.allocate({"a": 100, "b": 10, "c": 0}, 20, floor=2, cap=15)
    assert sum(got.values()) == 20 and got["c"] == 0 and got["a"] <= 15 and got["b"] >= 2


def test_probabilities():
    assert math.isclose(statistics.t_p_value(2.262157, 9), 0.05, rel_tol=1e-4)
    low, high = statistics.clopper_pearson(8, 10)
    assert math.isclose(low, 0.44390, abs_tol=1e-4) and math.isclose(high, 0.97479, abs_tol=1e-4)
    assert statistics.clopper_pearson(0, 5)[0] == 0.0 and statistics.clopper_pearson(5, 5)[1] == 1.0
    assert statistics.wilcoxon_p_value(8, 9) == 50 / 512  # 25 of 512 signs give 8 or less
    assert math.isclose(statistics.wilcoxon_p_value(8, 9, zeros=True), 0.0858, abs_tol=2e-3)  # the approximation


def test_kappa_without_rows(spark):
    assert statistics.kappa(spark.createDataFrame([], "a int, b int"), "a", "b").first()["kappa"] is None
