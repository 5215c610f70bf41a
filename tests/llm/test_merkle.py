"""The Merkle manifest against a tree that is built plainly, and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from longview.llm import merkle

DOC = "doc_id long, source string, lang string, n_chars int, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """(root, for each node the (index in its run, run) level by level)."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        for leaf, at in enumerate(where):
            paths[leaf].append((at % 2, runs[at // 2]))
        where, nodes = [at // 2 for at in where], [h("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaf = {}
    for r in rows:
        leaf.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h("".join(map(field, r))), r))
    trees = {x: tree([y[2] for y in sorted(leaf[x], key=lambda y: y[:3])]) for x in langs}
    root, upper = tree([trees[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for path, (_, _, digest, r) in zip(trees[x][1], sorted(leaf[x], key=lambda y: y[:3]), strict=True):
            whole = path + upper[k]
            cur = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                cur = h("".join(map(field, (*r[:3], r[3] + 1, r[4]))))
            for at, run in whole:
                cur = h("".join(run[:at] + [cur] + run[at + 1 :]))
            proof = h("".join("".join(run[:at] + run[at + 1 :]) for at, run in whole))
            out.append((r[0], digest, trees[x][0], root, proof, cur, cur == root))
    return sorted(out, key=str)


def made(n):
    langs = ["en", "en", "en", "dé", None, "", "zz"]
    rows = [(i * 3, f"src{i % 4}" if i % 9 else None, langs[(i * i) % 7], i if i % 5 else None, None if i % 11 == 0 else f"text é {i} " * (i % 4)) for i in range(n)]
    return rows + [(1, "s", "lone", 2147483647, ""), (7, None, "en", 3, "x"), (7, None, "en", 3, "x"), (7, None, "en", 4, "y"), (None, "s", "en", 1, "no id"), (8, "s", "lone2", 1, "long " * 50000)]


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = made(120)
    df = spark.createDataFrame(rows, DOC).select("*", *(F.lit(k).alias(k) for k in ("key", "pos", "n", "leaf", "path", "row", "block")))
    got = merkle.proofs(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and {r[-1] for r in want} == {True, False}


def test_manifest_of_one_group_one_row_and_none(spark):
    one = [(14, "s", "en", 4, "text")]
    got = [tuple(r) for r in merkle.proofs(spark.createDataFrame(one, DOC)).collect()]
    assert got == plain(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
    five = [(i, "s", "en", 4, "text") for i in range(5)]
    assert sorted(map(tuple, merkle.proofs(spark.createDataFrame(five, DOC)).collect()), key=str) == plain(five)
    assert merkle.proofs(spark.createDataFrame([], DOC)).count() == 0
