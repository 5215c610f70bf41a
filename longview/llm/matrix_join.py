"""Nearest neighbours by a block matrix join over int8 codes with error bounds.

Each vector x becomes s * c + e: a scale, int8 codes and a residual. For a query q and a candidate x the product of the codes times
both scales differs from the inner product by at most |q'||e_x| + |e_q||x'| + |e_q||e_x| (Cauchy-Schwarz; the primes
are the coded vectors), and these lengths travel with the codes. A tile multiplies a block of query codes by a block of
candidate codes; each product is a whole number that floats hold exactly. A query's bound is the k-th largest
lower end seen, and pairs whose upper end lies below it are left out. The pairs that survive all rounds are
joined to the original vectors, computed again in doubles, component by component from the first, and merged by one heap a
query. No pair that could rank is left out, so the lists are those of an exhaustive search: recall is 1.

Copies of one vector count once on either side: of equal candidates the k + 1 smallest ids can rank, and equal
queries are asked once for k + 1 neighbours, from which each takes its own id out.

Defined results: vectors that are null, zero or empty or hold null or non-finite components take no part, nor do rows with a
null id; a shorter vector counts as padded with zeros; rows repeated under one id are one vector, the largest of
them in order of components; equal scores go by the smaller id; a query without another vector has no row; products
beyond a double are infinite as doubles give them, and one that is no number ranks last; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import materialize, read, tidy
from ._tiles import asked_once, dealt, finite, first_copies, in_rounds, matrix, pack, packed

K, EVERY = 20, 20
#: Rows of a candidate block, of a query block, and queries of a tile.
BLOCK, QUERIES, TILE = 4096, 4096, 256
#: Dimensions up to which a product of int8 codes is a whole number that a 32-bit float holds.
SINGLE = (1 << 24) // (127 * 127)
#: Surviving pairs that a task holds before it gives them out.
HELD = 1 << 20


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).filter("vec_id is not null and embedding is not null").filter(finite(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    return rows.filter(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.max("v").alias("v"))


def _length(m: np.ndarray) -> np.ndarray:
    """Lengths of rows, without squares that overflow or vanish."""
    most = np.abs(m).max(1, initial=0)
    with np.errstate(all="ignore"):
        return np.where(most > 0, most * np.sqrt(((m / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1)), 0.0)


def coded(m: np.ndarray) -> dict[str, np.ndarray]:
    """Scales, int8 codes, and the lengths of the coded vectors and of what the codes leave out."""
    scale = np.abs(m).max(1, initial=0) / 127
    scale[scale == 0] = 1.0
    codes = np.clip(np.rint(m / scale[:, None]), -127, 127).astype(np.int8)
    near = codes * scale[:, None]
    return {"scale": scale, "codes": codes, "near": _length(near), "rest": _length(m - near)}


def _block(v: np.ndarray, ids: np.ndarray) -> bytes:
    return pack(ids=ids.astype(np.int64), **coded(v))


_FOUND = pa.schema([("block", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])


class _Tiles:
    """A block of queries with the k largest lower ends of each, and the pairs that survive so far."""

    def __init__(self, head: dict[str, np.ndarray], known: dict[int, float], k: int):
        self.q, self.k = head, k
        self.kind = np.float32 if head["codes"].shape[1] <= SINGLE else np.float64
        self.low = np.array([known.get(i, -np.inf) for i in head["ids"].tolist()], float)
        self.most = np.full((len(self.low), k), -np.inf)
        self.pairs, self.held = [], 0

    def meet(self, key: int, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes = c["codes"].astype(self.kind).T
        with np.errstate(all="ignore"):
            ends = np.stack([c["rest"] + 1e-9 * (c["near"] + c["rest"]), c["near"]])
            for at in range(0, len(self.low), TILE):
                rows = slice(at, at + TILE)
                scale, near, rest = (self.q[x][rows] for x in ("scale", "near", "rest"))
                product = (self.q["codes"][rows].astype(self.kind) @ codes).astype(float)
                product *= scale[:, None]
                product *= c["scale"][None, :]
                error = np.stack([near + rest, rest], 1) @ ends + 1e-300
                lower, upper = np.nan_to_num(product - error, nan=-np.inf, posinf=np.inf, neginf=-np.inf), product + error
                best = np.concatenate([self.most[rows], lower], 1)
                self.most[rows] = np.partition(best, best.shape[1] - self.k, 1)[:, best.shape[1] - self.k :]
                self.low[rows] = np.maximum(self.low[rows], self.most[rows].min(1))
                i, j = np.nonzero(~(upper < self.low[rows][:, None]))
                high = upper[i, j]
                self.pairs.append((i + at, c["ids"][j], lower[i, j], np.where(np.isnan(high), np.inf, high)))
                self.held += len(i)
                if self.held > HELD:
                    yield from self.rows(key)

    def rows(self, key: int) -> Iterator[pa.RecordBatch]:
        if self.pairs:
            i, ids, lower, upper = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
            stay = upper >= self.low[i]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(stay.sum(), key, np.int64), self.q["ids"][i[stay]], ids[stay], lower[stay], upper[stay])], schema=_FOUND)
        self.pairs, self.held = [], 0


def surviving(candidates: DataFrame, reps: DataFrame, dim: int, k: int) -> DataFrame | None:
    """(query, vec_id) of the pairs whose upper end reaches their query's k-th largest lower end."""
    cells = packed(dealt(candidates, dim), dim, BLOCK, ["vec_id"], _block, "codes")
    queries = packed(reps.coalesce(max(1, -(-reps.count() // (8 * QUERIES)))), dim, QUERIES, ["vec_id"], _block, "asked-codes")
    each = Window.partitionBy("query")
    ranked = F.row_number().over(each.orderBy(F.desc("lower"), "vec_id"))

    def merge(found: DataFrame) -> DataFrame:
        rows = found.withColumn("at", ranked).withColumn("bound", F.max(F.when(F.col("at") == k, F.col("lower"))).over(each))
        return rows.filter("bound is null or upper >= bound").drop("at")

    return in_rounds(queries, cells, lambda head, known: _Tiles(head, known, k), _FOUND, merge, F.max("bound"))


def dot(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of q and each row, summed from the first component on."""
    total = np.zeros(len(m))
    with np.errstate(all="ignore"):
        for i in np.flatnonzero(q):
            total += q[i] * m[:, i]
    return total


_LISTS = pa.schema([("rep", pa.int64()), ("found", pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))])


def _heaps(dim: int, k: int):
    """Rows sorted by query, its own vector first: a heap of each query's k best."""
    def listed(rep: int, heap: list) -> pa.RecordBatch:
        best = [{"vec_id": -i, "score": float("nan") if s == (-1, 0.0) else s[1]} for s, i in sorted(heap, reverse=True)]
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([best], _LISTS.field("found").type)], schema=_LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, q, heap = None, None, []
        for batch in batches:
            query, own, ids, m = (batch.column("query").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy(), matrix(batch.column("v"), dim))
            cuts = np.flatnonzero((np.diff(query) != 0) | own[1:] | own[:-1]) + 1 if len(query) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(query)], strict=True):
                if lo == hi:
                    continue
                if own[lo]:
                    if rep is not None:
                        yield listed(rep, heap)
                    rep, q, heap = int(query[lo]), m[lo], []
                    continue
                for s, i in zip(dot(q, m[lo:hi]).tolist(), ids[lo:hi].tolist(), strict=True):
                    entry = ((0, s) if s == s else (-1, 0.0), -i)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        if rep is not None:
            yield listed(rep, heap)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) where is_query (of vec_id) holds, the k
    rows other than itself with the largest inner products."""
    rows = materialize(clean(vectors), "vectors")
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    candidates = materialize(first_copies(rows, k + 1), "first-copies")
    reps, members = asked_once(rows.filter(is_query))
    pairs = surviving(candidates, reps, dim, k + 1)
    if pairs is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = ["query", "own", "vec_id", "v"]
    found = pairs.select("query", "vec_id").join(candidates, "vec_id").withColumn("own", F.lit(False)).select(sent)
    heads = reps.select(F.col("vec_id").alias("query"), F.lit(True).alias("own"), "vec_id", "v").select(sent)
    work = heads.unionByName(found).repartition("query").sortWithinPartitions("query", F.desc("own"))
    lists = materialize(work.mapInArrow(tidy(_heaps(dim, k + 1)), from_arrow_schema(_LISTS)), "lists")
    own = members.join(lists, "rep").select(F.col("vec_id").alias("query_id"), "found")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op11_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP11_SQL = """
with v as (
  select vec_id, max(list_transform(embedding, lambda x: cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
  group by vec_id
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 20
"""
