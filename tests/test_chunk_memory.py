"""Chunks of paragraphs are handed on in small batches, whatever the size of the batch that came."""

import pyarrow as pa

from longview.operators import chunking


def test_chunks_are_handed_on_as_they_come(monkeypatch):
    monkeypatch.setattr(chunking, "HELD", 1000)
    texts = ["\n".join("word " * 40 for _ in range(30)), None, "", "short", "one. " * 5]
    rows = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts * 10, pa.string())], names=["doc_id", "text"])
    got = list(chunking._folded(iter([rows]), 100, 120))
    assert max(sum(map(len, b.column("chunk").to_pylist())) for b in got) < 1000 + 120 * 10
    flat = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert flat == [(i, k + 1, len(c.split()), c) for i, t in enumerate(texts * 10) for k, c in enumerate(chunking.fold_paragraphs(t or "", 100, 120))]
