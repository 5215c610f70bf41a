"""Language identification by a byte convolutional network trained in numpy.

The text's lower-cased UTF-8 bytes are cut into windows of WINDOW bytes that overlap by the widest filter less one,
so that every byte run lies in some window. Filters of several widths over one-hot bytes, a ReLU and max pooling
over the window feed a softmax; a document's distribution is the mean of its windows'. All windows of every text
are read.

Training uses at most PER_LABEL documents of each language (those with the smallest id hashes among the learnable
ones) and at most TRAIN_WINDOWS windows of each, spread over the text, and the MAX_LABELS most frequent languages.
A pair of byte tables turns the filters into five lookups per position when applied.

Defined results: a null text, or one without a letter, is `und` with score 0; without any learnable row all are
`und`; repeated rows and null ids are answered row by row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import held_out, materialize, read, tidy

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LABEL, TRAIN_WINDOWS, MAX_LABELS = 300, 4, 200
EPOCHS, BATCH, RATE = 4, 64, 0.01
STEP = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"


def byte_windows(text: str) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(b) - WINDOW) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        params = [*self.filters.values(), self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                rows = order[at : at + BATCH]
                for p, g, a, b in zip(params, self._gradients(x[rows], y[rows]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, pooled, where = len(x), [], []
        for w, table in self.filters.items():
            size = WINDOW - w + 1
            conv = table[0][x[:, :size]]
            for j in range(1, w):
                conv = conv + table[j][x[:, j : j + size]]
            best = conv.argmax(1)
            where.append(best)
            pooled.append(np.take_along_axis(conv, best[:, None, :], 1)[:, 0, :])
        pre = np.concatenate(pooled, 1) + self.bias
        hidden = np.maximum(pre, 0)
        p = softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (pre > 0)
        grads = []
        for k, (w, best) in enumerate(zip(self.filters, where, strict=True)):
            g, part = np.zeros_like(self.filters[w]), back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                byte = np.take_along_axis(x, best + j, 1)
                np.add.at(g[j], (byte, np.arange(FILTERS)[None, :]), part)
            grads.append(g)
        return [*grads, back.sum(0), hidden.T @ p, p.sum(0)]

    def tables(self) -> dict:
        """For each width, lookups by a pair of bytes and what follows it."""
        def pair(a, b):
            return (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)

        f = self.filters
        return {"2": pair(f[2][0], f[2][1]), "3": pair(f[3][0], f[3][1]), "3b": f[3][2], "4": pair(f[4][0], f[4][1]), "4b": pair(f[4][2], f[4][3])}

    def predict(self, x: np.ndarray, tables: dict) -> np.ndarray:
        """Each window's distribution."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), 32):
            b = x[at : at + 32]
            bigram = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            third = tables["3"].take(bigram[:, :-1], axis=0)
            third += tables["3b"].take(b[:, 2:], axis=0)
            fourth = tables["4"].take(bigram[:, :-2], axis=0)
            fourth += tables["4b"].take(bigram[:, 2:], axis=0)
            pooled = np.concatenate([tables["2"].take(bigram, axis=0).max(1), third.max(1), fourth.max(1)], 1)
            out[at : at + 32] = softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sample_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True):
            if text and any(map(str.isalpha, text)):
                x = byte_windows(text)
                for i in sorted(set(np.linspace(0, len(x) - 1, TRAIN_WINDOWS).astype(int))):
                    out.append((doc, int(i), lang, x[i].tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "i", "lang", "window"])


def train(docs: DataFrame) -> Network | None:
    """docs (doc_id, text, lang); held-out rows are left out here."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LABELS).select("lang")
    known = known.join(F.broadcast(common), "lang", "left_semi")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= PER_LABEL).select("doc_id").distinct()
    ids = materialize(ids, "language-sample")  # small: at most PER_LABEL * MAX_LABELS rows
    rows = known.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text")
    sample = rows.mapInPandas(tidy(_sample_windows), "doc_id long, i int, lang string, window binary").toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["doc_id", "i", "lang", "window"])
    labels = sorted(sample["lang"].unique())
    x = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    return Network(labels).fit(x, np.searchsorted(labels, sample["lang"].to_numpy(str)))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            langs, scores = [], []
            for value in batch.column("text"):
                text = value.as_py()
                if net is None or not text or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                x, total = byte_windows(text), np.zeros(len(net.labels))
                for at in range(0, len(x), 1024):
                    total += net.predict(x[at : at + 1024], tables).sum(0)
                best = int(total.argmax())
                langs.append(net.labels[best])
                scores.append(min(1.0, float(total[best] / len(x))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=_PREDICTED)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), from_arrow_schema(_PREDICTED))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs))


