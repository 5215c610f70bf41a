"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over words and their beginnings (log counts). Besides the labels' loss, it minimises how much
a sentence's score changes when its identity terms are swapped for others of the same kind: labelled sentences
with such terms are paired with their swapped forms, and the squared differences of their scores are penalised. So
a mention of a group carries no weight of its own, and neutral mentions aren't flagged.

Training uses at most PER_CLASS labelled documents of each class (smallest id hashes) and at most SENTENCES
sentences with identity terms of each. Document frequencies of their features are counted in the engine, the
FEATURES that speak most clearly for toxicity are taken, and the fit runs on the bounded sample's counts. Every
document is then scored on its whole text.

Defined results: a null text is an empty one and gets the intercept's score; labels other than 0 and 1 and null
ids aren't learned from; without any label all scores are 0; repeated rows are answered row by row; extra
columns are ignored (kept by `reject`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import held_out, materialize, read, tidy

PER_CLASS, SENTENCES, SWAPS = 3000, 8, 3
FEATURES, LEAST_DOCS = 1024, 4
STEPS, RATE, RIDGE, FAIRNESS = 400, 0.05, 3e-4, 1.0
#: A missed toxic document weighs this many times a clean one that is flagged.
TOXIC_WEIGHT = 2.0
#: Characters that are scored at once.
BATCH = 1 << 21
#: Features a task counts before it passes them on.
PART = 300_000

# fixed values: identity terms by kind; terms of one kind are swapped for each other
IDENTITY = {
    "gender": ["women", "men", "woman", "man", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    "religion": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "hindu"],
    "origin": ["immigrants", "refugees", "foreigners", "africans", "asians", "europeans", "mexicans", "arabs", "germans", "spaniards"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "transgender", "queer"],
    "skin": ["black", "white", "brown"],
    "age": ["elderly", "seniors", "teenagers", "children"],
    "ability": ["disabled", "deaf", "blind", "autistic"],
}
_KIND = {t: k for k, terms in IDENTITY.items() for t in terms}
_TRIM = ".,;:!?\"'()[]{}<>|*#$%&+-=/\\`~^_"
_SENTENCE = re.compile(r"[.!?\n]+")


def features(token: str) -> list[str]:
    """A word and its beginnings of three to six letters."""
    w = token.strip(_TRIM)
    return [w, *(w[:n] + "*" for n in (3, 4, 5, 6) if len(w) > n)] if w else []


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def counts(words: list[str]) -> Counter:
    out: Counter = Counter()
    for token, n in Counter(words).items():
        for f in features(token):
            out[f] += n
    return out


def swapped(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """Pairs of a sentence's words and the words with each identity term moved on within its kind."""
    found = 0
    for sentence in _SENTENCE.split(text.lower()):
        words = sentence.split()
        kinds = [(i, w) for i, w in enumerate(x.strip(_TRIM) for x in words) if w in _KIND]
        if not kinds:
            continue
        for s in range(1, SWAPS + 1):
            other = list(words)
            for i, w in kinds:
                terms = IDENTITY[_KIND[w]]
                other[i] = terms[(terms.index(w) + s) % len(terms)]
            yield words, other
        found += 1
        if found == SENTENCES:
            return


def score_one(names: dict[str, int], weights: np.ndarray, bias: float, text: str | None) -> float:
    """The score of one text, word by word: what `Model.scores` computes for many at once."""
    at, value = _vector(tokens(text), names)
    return float(1 / (1 + np.exp(-np.clip(bias + sum(weights[i] * v for i, v in zip(at, value, strict=True)), -40, 40))))


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, np.asarray(weights, float), bias

    def scores(self, texts: list, index: dict[str, int]) -> np.ndarray:
        """The score of each text. Each distinct word's features are looked up once, those that the model knows are
        counted by document."""
        words = pc.utf8_split_whitespace(pa.array([(t or "").lower() for t in texts], pa.large_string()))
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
        code = coded.indices.to_numpy()
        real = np.array([bool(w) for w in known], bool)
        n = np.bincount(row[real[code]], minlength=len(texts))
        hits = [[index[f] for f in features(w) if f in index] for w in known]
        many = np.array([len(h) for h in hits], np.int64)
        flat = np.array([i for h in hits for i in h], np.int64)
        live = np.flatnonzero(many[code]) if len(known) else np.zeros(0, np.int64)
        row, code = row[live], code[live]
        each = many[code]
        ends = np.cumsum(each)
        at = flat[np.repeat((np.cumsum(many) - many)[code] - (ends - each), each) + np.arange(each.sum())]
        pair, count = np.unique(np.repeat(row, each) * len(self.weights) + at, return_counts=True)
        z = np.bincount(pair // len(self.weights), np.log1p(count) * self.weights[pair % len(self.weights)], len(texts))
        z = z + self.bias + self.weights[-1] * np.log1p(n) / 5
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def scorer(self):
        index = {f: i for i, f in enumerate(self.names)}

        def score(texts: list) -> np.ndarray:
            sizes = np.cumsum([len(t or "") + 1 for t in texts]) // BATCH
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
            return np.concatenate([np.zeros(0), *(self.scores(texts[lo:hi], index) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo)])

        return score


def _vector(words: list[str], index: dict[str, int]) -> tuple[list[int], list[float]]:
    at, value = [len(index)], [float(np.log1p(len(words)) / 5)]
    for f, n in counts(words).items():
        if f in index:
            at.append(index[f])
            value.append(float(np.log1p(n)))
    return at, value


def _document_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and part of it, how many documents hold each feature and how many of those are toxic."""
    def table(every: Counter, bad: Counter) -> pd.DataFrame:
        return pd.DataFrame({"feature": list(every), "a": [bad[f] for f in every], "d": list(every.values())})

    every, bad = Counter(), Counter()
    for pdf in frames:
        for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
            names = {f for t in set(tokens(text)) for f in features(t)}
            every.update(names)
            if y:
                bad.update(names)
            if len(every) > PART:
                yield table(every, bad)
                every, bad = Counter(), Counter()
    if every:  # a frame without rows has no string column that the engine takes
        yield table(every, bad)


def _vectors(index: dict[str, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc, text, y in zip(pdf["doc_id"], pdf["text"], pdf["toxic"], strict=True):
                out.append((doc, 0, y, *_vector(tokens(text), index)))
                for k, (a, b) in enumerate(swapped(text or "")):
                    change = Counter(dict(zip(*_vector(a, index), strict=True)))
                    change.subtract(dict(zip(*_vector(b, index), strict=True)))
                    left = {i: v for i, v in change.items() if v}
                    out.append((doc, k + 1, -1, list(left), list(left.values())))
            yield pd.DataFrame(out, columns=["doc_id", "k", "y", "at", "value"])

    return run


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the weighted logistic loss, a ridge, and fairness times half the mean
    squared change of a score under a swap; change is the mean of the changes' outer products."""
    x, y, weight, change = (np.asarray(z, np.float32) for z in (x, y, weight, change))
    p = np.zeros(x.shape[1] + 1, np.float32)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, STEPS + 1):
        grad = gradient(p, x, y, weight, change, fairness)
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:-1], float(p[-1])


def gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray, fairness: float) -> np.ndarray:
    w, b = p[:-1], p[-1]
    g = (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y) * weight / weight.sum()
    return np.append(x.T @ g + RIDGE * w + fairness * (change @ w), g.sum())


def loss(p: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray, fairness: float) -> float:
    w, b = p[:-1], p[-1]
    z = x @ w + b
    return float(((np.logaddexp(0, z) - y * z) * weight).sum() / weight.sum() + RIDGE / 2 * w @ w + fairness / 2 * w @ change @ w)


def sample_labels(given: DataFrame, share: dict[int, int]) -> DataFrame:
    """The PER_CLASS rows of each class of given (doc_id, toxic) with the smallest id hashes; of a class with many more
    rows, those with a hash that twice as many rows are expected to have are looked at."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    for y, n in share.items():
        if n > 4 * PER_CLASS:
            given = given.filter((F.col("toxic") != y) | (part < F.lit(int((1 << 40) * 2 * PER_CLASS / n))))
    w = Window.partitionBy("toxic").orderBy(part, "doc_id")
    return given.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= PER_CLASS).drop("k")


def train(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS) -> Model | None:
    """docs (doc_id, text) and labels (doc_id, toxic); held-out rows are left out here."""
    given = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("toxic").cast("long")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}  # two rows
    picked = materialize(sample_labels(given, share), "toxic-sample")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    sample = materialize(rows.dropDuplicates(["doc_id"]).repartition(24, "doc_id"), "toxic-texts")  # at most 2 * PER_CLASS rows
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n:
        return None
    n1, n0 = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    df = sample.mapInPandas(tidy(_document_features), "feature string, a long, d long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    a, b = (F.col("a") + 0.5) / (n1 + 1), (F.col("d") - F.col("a") + 0.5) / (n0 + 1)
    clear = F.abs(a - b) / F.sqrt(a * (1 - a) / n1 + F.abs(b * (1 - b)) / n0 + 1e-9) * F.when(a > b, 1.0).otherwise(0.5)
    best = df.filter(F.col("a") >= LEAST_DOCS).orderBy(clear.desc(), "feature").limit(FEATURES).select("feature").collect()  # FEATURES rows
    names = list(dict.fromkeys([r["feature"] for r in best] + [f for t in _KIND for f in features(t)]))
    index = {f: i for i, f in enumerate(names)}
    got = sample.mapInPandas(tidy(_vectors(index)), "doc_id long, k int, y int, at array<int>, value array<double>").toPandas().sort_values(["doc_id", "k"])

    docs_, pairs = got[got["y"] >= 0], got[got["y"] < 0]
    x = np.zeros((len(docs_), len(names) + 1), np.float32)
    for i, (at, value) in enumerate(zip(docs_["at"], docs_["value"], strict=True)):
        x[i, np.asarray(at, int)] = np.asarray(value)
    change = np.zeros((len(names) + 1, len(names) + 1))
    for at, value in zip(pairs["at"], pairs["value"], strict=True):
        change[np.ix_(np.asarray(at, int), np.asarray(at, int))] += np.outer(value, value)
    y = docs_["y"].to_numpy(float)
    weight = np.where(y == 1, TOXIC_WEIGHT * share.get(1, 0) / n1, share.get(0, 0) / n0)
    return Model(names, *fit(x, y, weight, change / max(1, len(pairs)), fairness))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer() if model else lambda texts: np.zeros(len(texts))
        for batch in batches:
            s = score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=_PREDICTED)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), from_arrow_schema(_PREDICTED))


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer() if model else lambda texts: np.zeros(len(texts))
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(docs, train(docs, read(spark, sf_dir, "labels")))
