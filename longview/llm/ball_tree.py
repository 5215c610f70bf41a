"""Hard negatives by branch and bound over ball trees, one tree for each partition.

Vectors become whole numbers, floor(256 * x). A partition's rows are split at the median of their widest coordinate until LEAF are
left; a node keeps its centre, its radius and its least and largest label. For a query q the products of a node's rows lie within
|q| * radius of q times the centre, above and below. A node is left out where that range misses the score window
altogether, where it lies strictly beneath the query's k-th best so far, or where its labels can't fit; the
other leaves are visited by descending bound and their products are computed whole, so that what is returned is exact.

Two searches: for each anchor the first POSITIVES other rows of its label (no window), then for each positive
the first NEGATIVES rows of other labels within the window that its score gives. Anchors are taken in blocks, trees in rounds
that pass on each query's proven k-th score. Copies of one vector and label count once on either side, but for
the POSITIVES + 1 smallest ids, which alone can rank.

Defined results: rows with a null id, a null label, a null vector or a null or non-finite component take no part; a shorter vector,
and an empty one, counts as padded with zeros; rows repeated under one id are one, the largest by vector, then
label; equal scores go by the smaller id; a positive whose window holds no row has none in the result; a score that
no long holds is held at the long's end, all others are exact; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, read, tidy
from ._tiles import CELL, asked_once, dealt, finite, first_copies, in_rounds, pack, packed
from .topk import scores

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Anchors are the rows whose id is divisible by this; every ODD-th id's label is moved on by one of LABELS.
EVERY, ODD, LABELS = 50, 7, 10
#: A negative's score lies between these hundredths of the positive's.
FLOOR, CEILING = 50, 95
#: Rows of a leaf and anchors of a block.
LEAF, ANCHORS = 256, 256
#: Longer vectors than this give no bounds, since doubles may not hold their products.
LONG = 2.0**40
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, label long) of the rows that take part, labels as given."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"), F.col("label").cast("long"))
    rows = rows.filter("vec_id is not null and embedding is not null and label is not null").filter(finite(F.col("embedding")))
    best = rows.groupBy("vec_id").agg(F.max(F.struct(F.transform("embedding", whole).alias("v"), "label")).alias("row"))
    return best.select("vec_id", "row.v", "row.label")


def tree(m: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Rows in the order of the leaves, and the nodes level by level: the children of node i are 2i + 1 and 2i + 2."""
    order, spans, last = np.arange(len(m)), [(0, len(m))], 0
    while (spans[last][1] - spans[last][0] > LEAF) or any(hi - lo > LEAF for lo, hi in spans[last:]):
        level = spans[last:]
        last = len(spans)
        for lo, hi in level:
            rows, mid = m[order[lo:hi]], (hi - lo) // 2
            with np.errstate(all="ignore"):
                wide = int(np.argmax(np.nan_to_num(rows.max(0) - rows.min(0)))) if rows.shape[1] else 0
            order[lo:hi] = order[lo:hi][np.argpartition(rows[:, wide], mid)] if mid else order[lo:hi]
            spans += [(lo, lo + mid), (lo + mid, hi)]
    m, ids, labels = m[order], ids[order], labels[order]
    centre, radius = np.zeros((len(spans), m.shape[1])), np.full(len(spans), np.inf)
    for i, (lo, hi) in enumerate(spans):
        with np.errstate(all="ignore"):
            c = m[lo:hi].mean(0)
            r = np.sqrt(((m[lo:hi] - c) ** 2).sum(1)).max()
        if np.abs(m[lo:hi]).max(initial=0) < LONG:
            centre[i], radius[i] = c, r * (1 + 1e-9) + 1e-9
    each = lambda f: np.array([f(labels[lo:hi]) for lo, hi in spans], np.int64)
    return {"m": m, "ids": ids.astype(np.int64), "labels": labels.astype(np.int64), "spans": np.array(spans, np.int64), "centre": centre, "radius": radius, "least": each(np.min), "most": each(np.max)}


def narrow(m: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    most = np.abs(m).max(initial=0)
    return m.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8")


def _packed_tree(v: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> bytes:
    t = tree(v, ids, labels)
    return pack(**(t | {"m": narrow(t["m"])}))


_FOUND = pa.schema([("block", pa.int64()), ("query", pa.int64()), ("rep", pa.int64()), ("given", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class _Windows:
    """A block of anchors with score windows; each window, numbered in the block, keeps its k best rows."""

    def __init__(self, head: dict[str, np.ndarray], known: dict[int, float], k: int, same: bool):
        self.k, self.same = k, same
        self.q, self.rep, self.label = head["m"].astype(float), head["rep"], head["labels"]
        self.anchor, self.given, self.lo, self.hi = head["anchor"], head["given"], head["lo"], head["hi"]
        n = len(self.anchor)
        with np.errstate(all="ignore"):
            self.length = np.sqrt((self.q * self.q).sum(1))
        self.sure = self.length < LONG
        self.low = np.array([known.get(i, -np.inf) for i in range(n)], float)
        self.s, self.ids, self.n = np.full((n, k), _LEAST), np.full((n, k), _MOST), np.zeros(n, np.int64)

    def open(self, t: dict[str, np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows by nodes that have to be entered, the nodes' upper bounds by anchor)."""
        with np.errstate(all="ignore"):
            middle = self.q @ t["centre"][nodes].T
            reach = self.length[:, None] * t["radius"][nodes][None, :]
            slack = 1e-9 * (1 + reach + np.abs(middle)) + 1e-9 * (self.length[:, None] * np.sqrt((t["centre"][nodes] ** 2).sum(1))[None, :])
            upper, lower = middle + reach + slack, middle - reach - slack
        unsure = ~self.sure[:, None] | ~np.isfinite(t["radius"][nodes])[None, :]
        upper[unsure | np.isnan(upper)], lower[unsure | np.isnan(lower)] = np.inf, -np.inf
        least, most = t["least"][nodes][None, :], t["most"][nodes][None, :]
        fits = (least <= self.label[:, None]) & (self.label[:, None] <= most) if self.same else ~((least == most) & (least == self.label[:, None]))
        up, down = upper[self.anchor], lower[self.anchor]
        return fits[self.anchor] & (up >= self.lo[:, None].astype(float)) & (down <= self.hi[:, None].astype(float)) & (up >= self.low[:, None]), upper

    def meet(self, key: int, t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Down the tree a level at a time; then its leaves by descending bound."""
        m, spans = t["m"].astype(float), t["spans"]
        nodes = np.array([0])
        live, upper = self.open(t, nodes)
        while 2 * nodes[0] + 1 < len(spans):
            nodes = np.repeat(2 * nodes[live.any(0)] + 1, 2)
            nodes[1::2] += 1
            if not len(nodes):
                return
            above = np.repeat(live[:, live.any(0)], 2, axis=1)
            live, upper = self.open(t, nodes)
            live &= above
        for at in np.argsort(-np.where(live.any(0), upper.max(0), -np.inf), kind="stable"):
            w = np.flatnonzero(live[:, at] & (upper[self.anchor, at] >= self.low))
            if len(w):
                lo, hi = spans[nodes[at]]
                self.leaf(w, m[lo:hi], t["ids"][lo:hi], t["labels"][lo:hi])
        return
        yield

    def leaf(self, w: np.ndarray, m: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        asked, at = np.unique(self.anchor[w], return_inverse=True)
        s = scores(self.q[asked], m)[at]
        fits = labels[None, :] == self.label[self.anchor[w]][:, None]
        fits = (fits if self.same else ~fits) & (s >= self.lo[w][:, None]) & (s <= self.hi[w][:, None]) & (s >= self.low[w][:, None])
        some = fits.any(1)
        w, s, fits = w[some], s[some], fits[some]
        if not len(w):
            return
        # rows that don't fit rank behind all others
        rank = np.concatenate([np.arange(self.k)[None, :] >= self.n[w][:, None], ~fits], 1)
        s = np.concatenate([self.s[w], s], 1)
        who = np.concatenate([self.ids[w], np.broadcast_to(ids, fits.shape)], 1)
        order = np.lexsort((who, ~s, rank), axis=1)[:, : self.k]
        self.s[w], self.ids[w] = np.take_along_axis(s, order, 1), np.take_along_axis(who, order, 1)
        self.n[w] = np.minimum(self.k, self.n[w] + fits.sum(1))
        full = w[self.n[w] == self.k]
        self.low[full] = np.maximum(self.low[full], bound(self.s[full, -1]))

    def rows(self, key: int) -> Iterator[pa.RecordBatch]:
        w, k = np.nonzero(np.arange(self.k)[None, :] < self.n[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(w), key, np.int64), w, self.rep[self.anchor[w]], self.given[w], self.ids[w, k], self.s[w, k])], schema=_FOUND)


def bound(s: np.ndarray) -> np.ndarray:
    """Doubles that aren't above the scores."""
    out = s.astype(float)
    return np.where(np.abs(out) >= 2.0**53, out - 2048.0, out)


def windows(given: int) -> tuple[int, int]:
    """The negatives' least and largest score for a positive's."""
    return -(-FLOOR * given // 100), CEILING * given // 100


def _head(v: np.ndarray, rep: np.ndarray, labels: np.ndarray, given: np.ndarray | None = None) -> bytes:
    """A block of anchors; each has one window without ends, or one for each distinct score it is given."""
    if given is None:
        at, each = np.arange(len(v)), np.zeros(len(v), np.int64)
        lo, hi = np.full(len(v), _LEAST), np.full(len(v), _MOST)
    else:
        at = np.repeat(np.arange(len(v)), [len(g) for g in given])
        each = np.concatenate([np.asarray(g, np.int64) for g in given])
        lo, hi = (np.array(x, np.int64) for x in zip(*(windows(int(g)) for g in each), strict=True))
    return pack(m=narrow(v), rep=rep.astype(np.int64), labels=labels.astype(np.int64), anchor=at, given=each, lo=lo, hi=hi)


def search(anchors: DataFrame, cells: DataFrame, dim: int, k: int, same: bool, label: str) -> DataFrame | None:
    """(block, query, rep, given, vec_id, score, rank): each window's k best rows."""
    columns = ["vec_id", "label"] + ([] if same else ["given"])
    heads = packed(anchors.coalesce(max(1, -(-anchors.count() // (8 * ANCHORS)))), dim, ANCHORS, columns, _head, label)
    best = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    # a double below a score beyond 2^53 may lie above it, so that bound is lowered
    last = F.min(F.when(F.col("rank") == k, F.col("score"))).cast("double")
    return in_rounds(heads, cells, lambda head, known: _Windows(head, known, k, same), _FOUND, lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), F.when(F.abs(last) >= 2.0**53, last - 2048.0).otherwise(last))


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, v, label), v whole numbers."""
    rows = materialize(rows.select("vec_id", "v", "label"), "labelled")
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    cells = packed(dealt(materialize(first_copies(rows, POSITIVES + 1, "label"), "first-copies"), dim), dim, CELL, ["vec_id", "label"], _packed_tree, "trees")
    anchors, members = asked_once(rows.filter(is_anchor), "label")
    near = search(anchors, cells, dim, POSITIVES + 1, True, "anchors")
    if near is None:
        return empty
    # of the POSITIVES + 1 first rows of its label, each anchor takes its own out
    near = materialize(near.groupBy("rep").agg(F.collect_list(F.struct("rank", "vec_id", "score")).alias("found"), F.collect_set("score").alias("given")), "near")
    asked = materialize(anchors.join(near.select(F.col("rep").alias("vec_id"), "given"), "vec_id"), "asked-windows")
    far = search(asked, cells, dim, NEGATIVES, False, "windows")
    if far is None:
        return empty
    first = F.slice(F.array_sort(F.filter("found", lambda x: x["vec_id"] != F.col("anchor_id"))), 1, POSITIVES)
    own = members.select(F.col("vec_id").alias("anchor_id"), "rep").join(near.select("rep", "found"), "rep")
    pairs = own.select("anchor_id", "rep", F.explode(first).alias("p")).select("anchor_id", "rep", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("given"))
    lists = materialize(far.groupBy("rep", "given").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("far")), "far")
    out = pairs.join(lists, ["rep", "given"]).select("anchor_id", "positive_id", F.explode("far").alias("n"), F.col("given").alias("positive_score"))
    return out.select("anchor_id", "positive_id", "n.rank", F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % ODD == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % EVERY == 0)


OP12_SQL = """
with v as (
  select vec_id, max(struct_pack(v := list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)), label := label)) as r from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id
), w as (
  select vec_id, cast(r.v as double[]) as v, case when vec_id % 7 = 0 then (r.label + 1) % 10 else r.label end as label from v
), s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.v, c.v) as bigint) as score
  from w a join w c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0
), p as (
  select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
