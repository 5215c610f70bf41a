"""Exact top-k inner products over norm-sorted, rotated blocks.

Vectors become integers, floor(64 * x). Their second moments, summed in the engine, give the SVD's rotation (its right
singular vectors), which gathers length in the leading coordinates. Vectors are range-sorted by descending length and laid
in blocks; a range of blocks is a cell. A block of queries goes through a cell's blocks in that order, and each
query's k-th best score so far is its bound: a block is skipped where query length * longest length in it
(Cauchy-Schwarz) is below the bound; inside a block, the first coordinates' partial product plus the product of the
residual lengths bounds each score, so that only the rest is finished. Cells are taken in rounds that grow: the longest one
first, then the next GROWTH and so on, each with the bounds of the rounds before. Pairs of a query block and a cell are
first chosen by their lengths and bounds alone, and vectors are sent for those that are left. Scores that are
returned are products of the integers themselves, so rounding in the rotation can't change a result (bounds get a
slack for it).

Query blocks meet cells through an equi-join on the cell: blocks of a stated query set against all rows, never a pair
of rows.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
a shorter vector, and an empty one, counts as padded with zeros; rows repeated under one id are one vector, the
largest of them in order of components; a score that no long holds is held at the long's end, all others are exact;
equal vectors are separate candidates, ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import discard, materialize, read, tidy

SCALE, K, EVERY = 64, 20, 20
#: Rows of a candidate block and of a query block.
BLOCK, QUERIES = 4096, 256
#: Candidate blocks of a cell, about.
GROUP = 8
#: Blocks that go to Python at once.
AT_ONCE = 8
#: How many times as many cells as the round before a round takes.
GROWTH = 8
#: Share of a block's pairs left by the bounds above which their products are made all at once.
DENSE = 0.05
#: Tasks of a round at most.
TASKS = 20_000
#: Rotated coordinates of the partial sums.
LEAD = 0.375
#: Longer vectors than this are compared without bounds, since doubles may not hold their products.
LONG = 2.0**40
_MAX = (1 << 63) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, norm) of the vectors that take part."""
    def whole(c):
        y = c.cast("double") * SCALE
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).filter("vec_id is not null and embedding is not null").filter(good)
    rows = rows.groupBy("vec_id").agg(F.max(F.transform("embedding", whole)).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    n = lists.value_lengths().to_numpy()
    out = np.zeros((len(n), dim))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


_MOMENTS = pa.schema([("i", pa.int32()), ("s", pa.list_(pa.float64()))])


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            m = m[np.sqrt((m * m).sum(1)) < LONG]
            total += m.T @ m
        for i in range(dim):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i].tolist()], pa.list_(pa.float64()))], schema=_MOMENTS)

    return run


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all rows, by descending singular value. dim * dim numbers come to the driver."""
    sums = rows.select("v").mapInArrow(tidy(_moments(dim)), from_arrow_schema(_MOMENTS))
    total = sums.select("i", F.posexplode("s").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    got = total.toArrow()
    moments = np.zeros((dim, dim))
    moments[got["i"].to_numpy(), got["j"].to_numpy()] = got["s"].to_numpy()
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


_BLOCKS = pa.schema([("cell", pa.int64()), ("place", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("v", pa.binary()), ("longest", pa.float64())])


def _narrow(m: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    most = np.abs(m).max(initial=0)
    return m.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8")


def _pack(dim: int, rows: int):
    """Rows sorted by descending length as blocks of that many; the task's number is the cell."""
    def block(cell: int, place: int, ids: list, vectors: list, norms: list) -> pa.RecordBatch:
        m = _narrow(np.concatenate(vectors))
        row = [cell, place, np.concatenate(ids).astype("<i8").tobytes(), m.dtype.str, m.tobytes(), float(max(x.max() for x in norms))]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, place, held, ids, vectors, norms = TaskContext.get().partitionId(), 0, 0, [], [], []
        for batch in batches:
            i, m, n = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim), batch.column("norm").to_numpy()
            at = 0
            while at < len(i):
                took = min(len(i) - at, rows - held)
                ids.append(i[at : at + took])
                vectors.append(m[at : at + took])
                norms.append(n[at : at + took])
                at, held = at + took, held + took
                if held == rows:
                    yield block(cell, place, ids, vectors, norms)
                    place, held, ids, vectors, norms = place + 1, 0, [], [], []
        if held:
            yield block(cell, place, ids, vectors, norms)

    return run


def _bound(q: np.ndarray, c: np.ndarray) -> float:
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of whole numbers in doubles, held within a long."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    bound = _bound(q, c)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda m: [[int(x) for x in row] for row in m]
    cs = whole(c)
    return np.array([[max(-_MAX - 1, min(_MAX, sum(a * b for a, b in zip(x, y, strict=True)))) for y in cs] for x in whole(q)], np.int64)


class _Queries:
    """A block of queries with each one's k best so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.low, self.k, self.turn = ids, q, low, k, turn
        self.lead = max(1, int(len(turn) * LEAD))
        with np.errstate(all="ignore"):
            self.length = np.sqrt((q * q).sum(1))
        self.big = ~(self.length < LONG)
        self.turned = np.where(self.big[:, None], 0.0, q) @ turn
        self.rest = np.sqrt((self.turned[:, self.lead :] ** 2).sum(1))
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def meet(self, ids: np.ndarray, c: np.ndarray, longest: float) -> None:
        slack = 1e-9 * (1 + np.minimum(self.length, LONG) * min(longest, LONG))
        live = np.flatnonzero(self.big | ~(longest < LONG) | (self.length * longest + slack >= self.low))
        if not len(live):
            return
        with np.errstate(all="ignore"):
            length = np.sqrt((c * c).sum(1))
        big = ~(length < LONG)
        turned = np.where(big[:, None], 0.0, c) @ self.turn
        rest = np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        upper = self.turned[live, : self.lead] @ turned[:, : self.lead].T
        upper += self.rest[live][:, None] * rest[None, :]
        upper += slack[live][:, None]
        open_ = upper >= self.low[live][:, None]
        open_ |= big[None, :] | self.big[live][:, None]
        whole = None
        if open_.mean() > DENSE and not big.any() and not self.big[live].any() and _bound(self.q[live], c) < 2**53:
            # most are left: all products at once cost less than picking rows, and doubles hold them exactly
            whole = self.q[live] @ c.T
            open_ &= whole >= self.low[live][:, None]
        for i, x in enumerate(live.tolist()):
            at = np.flatnonzero(open_[i])
            s = scores(self.q[x : x + 1], c[at])[0] if whole is None else whole[i, at].astype(np.int64)
            ok = (s >= self.low[x]) & (ids[at] != self.ids[x])
            if ok.any():
                s, who = np.concatenate([self.best[x][0], s[ok]]), np.concatenate([self.best[x][1], ids[at][ok]])
                order = np.lexsort((who, ~s))[: self.k]
                self.best[x] = s[order], who[order]
                if len(order) == self.k:
                    self.low[x] = max(self.low[x], np.nextafter(float(s[order[-1]]), -np.inf) if abs(int(s[order[-1]])) >= 2**53 else float(s[order[-1]]))

    def rows(self, block: int) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        return pa.RecordBatch.from_arrays([pa.array(np.full(sum(n), block)), pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([w for _, w in self.best])), pa.array(np.concatenate([s for s, _ in self.best]))], schema=_FOUND)


_FOUND = pa.schema([("block", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(dim: int, turn: np.ndarray, k: int):
    """Rows sorted by block, cell and place: a query block, then a cell's blocks by descending length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, i=row, b=batch: b.column(c)[i].as_py()
                ids = np.frombuffer(get("ids"), "<i8")
                m = np.frombuffer(get("v"), get("kind")).reshape(-1, dim).astype(float)
                if get("place") < 0:
                    if queries:
                        yield queries.rows(key[0])
                    key, known = (get("block"), get("cell")), dict(zip(get("asked") or [], get("lows") or [], strict=True))
                    queries = _Queries(ids, m, np.array([known.get(i, -np.inf) for i in ids.tolist()], float), turn, k)
                else:
                    queries.meet(ids, m, get("longest"))
        if queries:
            yield queries.rows(key[0])

    return run


def exact_topk(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) where is_query (of vec_id) holds, the k
    rows other than itself with the highest inner products."""
    rows = materialize(integers(vectors), "integers")
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.count_if(is_query).alias("asked")).first()
    dim, n, asked = max(1, shape["dim"] or 1), shape["n"], shape["asked"]
    turn = rotation(rows, dim)
    order = [F.desc("norm"), F.asc("vec_id")]

    def blocks(df: DataFrame, size: int, label: str) -> DataFrame:
        return materialize(df.sortWithinPartitions(*order).mapInArrow(tidy(_pack(dim, size)), from_arrow_schema(_BLOCKS)), label)

    candidates = blocks(rows.repartitionByRange(max(1, min(-(-n // (BLOCK * GROUP)), 100_000)), *order), BLOCK, "blocks")
    # queries are sorted where they lie: their blocks are of like lengths, and need no place in a row of all
    queries = blocks(rows.filter(is_query).coalesce(max(1, -(-asked // (QUERIES * GROUP)))), QUERIES, "queries")
    queries = queries.withColumn("block", F.col("cell") * (1 << 31) + F.col("place")).drop("cell", "place")
    spans = candidates.groupBy("cell").agg(F.max("longest").alias("reach"))
    cells = 1 + (candidates.agg(F.max("cell")).first()[0] or 0)

    blocks_asked = queries.count()
    none = queries.sparkSession.createDataFrame([], "block long, least double, held long, asked array<long>, lows array<double>")
    best, lows, lo, width = None, none, 0, 1
    while lo < cells:
        met = F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(min(cells, lo + width) - 1).cast("long")))
        sizes = queries.select("block", "longest", (F.octet_length("ids") / 8).alias("size")).join(lows.select("block", "least", "held"), "block", "left")
        # a block some of whose queries have fewer than k so far has no bound
        bound = F.when(F.col("held") == F.col("size"), F.col("least")).otherwise(F.lit(-float("inf")))
        pairs = sizes.select("block", "longest", bound.alias("least"), met.alias("cell")).join(spans, "cell")
        pairs = materialize(pairs.filter((F.col("reach") >= LONG) | (F.col("longest") >= LONG) | (F.col("longest") * F.col("reach") * (1 + 1e-9) + 1 >= F.col("least"))).select("block", "cell"), "pairs")
        if pairs.isEmpty():
            break
        sent = ["block", "cell", "place", "ids", "kind", "v", "longest", "asked", "lows"]
        heads = pairs.join(queries, "block").join(lows.select("block", "asked", "lows"), "block", "left").withColumn("place", F.lit(-1)).select(sent)
        tails = pairs.join(candidates, "cell").withColumns({"asked": F.lit(None).cast("array<long>"), "lows": F.lit(None).cast("array<double>")}).select(sent)
        work = heads.unionByName(tails).repartition(max(8, min(blocks_asked * width, TASKS)), "block", "cell").sortWithinPartitions("block", "cell", "place")
        found = materialize(work.mapInArrow(tidy(_search(dim, turn, k)), from_arrow_schema(_FOUND)), "found", AT_ONCE)
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        every = found if best is None else best.select(found.columns).unionByName(found)
        better = materialize(every.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k), "best")
        for table in (pairs, found, best):
            if table is not None:
                discard(table)
        best, lo, width = better, lo + width, width * GROWTH
        if lo < cells:
            # a double below a score beyond 2^53 may lie above it, so that bound is lowered
            low = F.min("score").cast("double") - F.when(F.abs(F.min("score").cast("double")) >= 2.0**53, 2048.0).otherwise(0.0)
            each = best.groupBy("block", "query_id").agg(F.count("*").alias("n"), low.alias("low")).filter(F.col("n") == k)
            lows = materialize(each.groupBy("block").agg(F.min("low").alias("least"), F.count("*").alias("held"), F.collect_list("query_id").alias("asked"), F.collect_list("low").alias("lows")), "lows")
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP9_SQL = """
with v as (
  select vec_id, max(list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))) as v
  from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 20
"""
