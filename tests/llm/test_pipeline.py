"""The pipeline's stages and the registered queries."""

import pytest

import corpus_pipeline
from longview.llm import queries
from longview.llm._common import materialize
from tests.harness import compare
from tests.llm.test_operators import brute_components, lines_left


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, con, name):
    assert compare(queries.QUERIES[name](spark, sf), con, queries.SQL[name]) == ""


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before, seen = {r["doc_id"]: r["text"] for r in docs.collect()}, []
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            # unlabelled documents may be toxic too, so only labelled ones tell
            right = sum((i in gone) == bool(y) for i, y in labels.items())
            assert gone and right >= 0.9 * len(labels), (right, len(labels), len(gone))
        elif name == "line dedup":
            want = {i: t for i, t in lines_left(list(before.items())).items() if t or not before[i]}
            assert after == want
        elif name == "near-dedup":
            found = brute_components(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in found.items() if i == c}
        seen.append(name)
        before = after
    assert seen == ["toxicity", "line dedup", "near-dedup", "mixing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_odd_rows_and_names(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns with inner names go through all stages; an empty table stays empty."""
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "a b c d e f", "en", None), (3, "a b c d e f", "en", None), (None, "x y z", None, "s"), (4, "word " * 60000, "en", "s"), (5, "l1\nl2\nl3\nown five", "de", "s"), (6, "l1\nl2\nl3\nown six", "de", "s")]
    names = ("domain", "epoch", "n_tokens", "n_lines", "n_removed", "_whole", "_cut", "_row", "cut", "held_out")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as int) as n_chars", *(f"'own {c}' as {c}" for c in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, docs.filter("false")):
        kept = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = materialize(stage(spark, kept, str(tmp_path)), "odd")
            assert kept.schema.names == docs.schema.names
            assert all(r[c] == f"own {c}" for r in kept.collect() for c in names)
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        if start is docs:
            left = {r["doc_id"]: r["text"] for r in kept.collect()}
            assert set(left) <= {3, 4, 5, 6} and left.get(6, "own six") == "own six" and {r["doc_id"] for r in packed.collect()} == set(left)
        else:
            assert packed.count() == 0
