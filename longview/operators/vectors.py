"""A vector store in cells with exact balls, and exact nearest vectors by it.

Centres are fitted to a bounded sample; every vector lies in the partition of its nearest centre, with its distance from it. A cell's
ball, its centre and its largest distance, bounds all products with a query q: at most q times the centre plus |q| times the
radius. A search first visits the FIRST cells of highest bound for each query, whose k-th best product is proven, and
then all cells whose bound reaches it; only those cells' partitions are read. The lists are exact whatever the centres are:
the sample decides how much is skipped, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .. import storage

#: Vectors to which centres are fitted at most (those first by a hash of their id), and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Cells at most; some PER_CELL vectors a cell below that.
CELLS, PER_CELL = 4096, 64
#: Cells that each query visits before it has a bound.
FIRST = 2
#: Vectors of a region of cells and queries of a block that meet in one task, about.
REGION, BLOCK = 32_768, 16_384


def _rows(lists: pa.ListArray, dim: int) -> np.ndarray:
    n = lists.value_lengths().to_numpy()
    if (n != dim).any():
        raise ValueError(f"vectors have {dim} components")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(n), dim)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from evenly spaced rows; a centre without rows stays where it is."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        at = np.argmin((centres**2).sum(1)[None, :] - 2 * sample @ centres.T, axis=1)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


_PLACED = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("far", pa.float64()), ("cell", pa.int32())])


@dataclass
class VectorStore:
    """Vectors by cell under path: `vectors` (id, v, far, cell) in files sorted by cell, `centres` (cell, centre)."""

    spark: SparkSession
    path: str
    centres: np.ndarray

    @classmethod
    def create(cls, vectors: DataFrame, path: str) -> VectorStore:
        """A store of vectors (id, v): centres from a sample, then all rows. Rows without an id or a vector, and those with a null or
        non-finite component, take no part."""
        rows = storage.written(clean(vectors), "clean")
        n = rows.count()
        sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], float)
        centres = fit_centres(sample, max(1, min(CELLS, n // PER_CELL))) if n else np.zeros((1, 0))
        spark = vectors.sparkSession
        kept = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        kept.coalesce(1).write.parquet(f"{path}/centres")
        store = cls(spark, path, centres)
        store.extend(rows)
        storage.delete(spark, rows._written)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorStore:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return cls(spark, path, np.array([r["centre"] for r in rows], float))

    def extend(self, vectors: DataFrame) -> None:
        """Vectors (id, v) put into the cells of their nearest centres."""
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    m = _rows(batch.column("v"), centres.shape[1])
                    at = np.argmin((centres**2).sum(1)[None, :] - 2 * m @ centres.T, axis=1)
                    far = np.sqrt(((m - centres[at]) ** 2).sum(1)) * (1 + 1e-9)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(far), pa.array(at.astype(np.int32))], schema=_PLACED)

        placed = clean(vectors).mapInArrow(place, from_arrow_schema(_PLACED))
        # files are sorted by cell, so that only the pages of wanted cells are read; large cells are dealt to several files
        dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell")
        dealt.write.mode("append").option("parquet.page.row.count.limit", 1024).parquet(f"{self.path}/vectors")

    def read(self) -> DataFrame:
        """(id, v, far, cell) of all vectors stored."""
        schema = from_arrow_schema(_PLACED)
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def balls(self) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's radius and its number of vectors, from the distances alone; at most CELLS rows come to the driver."""
        radius, n = np.zeros(len(self.centres)), np.zeros(len(self.centres), np.int64)
        for r in self.read().groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
            radius[r["cell"]], n[r["cell"]] = r["far"], r["n"]
        return radius, n


def clean(vectors: DataFrame) -> DataFrame:
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    first, second = vectors.columns[:2]
    rows = vectors.select(F.col(first).cast("long").alias("id"), F.col(second).cast("array<double>").alias("v"))
    return rows.filter("id is not null and v is not null").filter(good)


_ASKED = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("low", pa.float64()), ("lead", pa.list_(pa.int32()))])


def _up(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What each query's product with a vector of each cell can be at most."""
    up = q @ centres.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
    return up + 1e-9 * (1 + np.abs(up))


def _reached(batch: pa.RecordBatch, centres: np.ndarray, radius: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which of these cells each asked row has to visit: those of its lead while it has no bound, else all others that reach the bound."""
    lead = batch.column("lead")
    held = np.zeros((batch.num_rows, len(centres)), bool)
    held[np.repeat(np.arange(batch.num_rows), lead.value_lengths().to_numpy()), lead.flatten().to_numpy()] = True
    low = batch.column("low").to_numpy(zero_copy_only=False).astype(float)
    others = ~held[:, cells] & ~(_up(_rows(batch.column("q"), centres.shape[1]), centres[cells], radius[cells]) < low[:, None])
    started = batch.column("started").to_numpy(zero_copy_only=False).astype(bool)
    return np.where(started[:, None], others, held[:, cells])


def _slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _leads(store: VectorStore, radius: np.ndarray, n: np.ndarray):
    """asked (query_id, q) with the FIRST cells of highest bound that hold vectors."""
    centres, full = store.centres, np.flatnonzero(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            up = _up(_rows(batch.column("q"), centres.shape[1]), centres[full], radius[full])
            lead = full[np.argsort(-up, axis=1, kind="stable")[:, :FIRST]].astype(np.int32)
            offsets = pa.array((np.arange(batch.num_rows + 1) * lead.shape[1]).astype(np.int32))
            rows = [batch.column("query_id"), batch.column("q"), pa.nulls(batch.num_rows, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(lead.ravel()))]
            yield pa.RecordBatch.from_arrays(rows, schema=_ASKED)

    return run


_SENT = pa.schema([("region", pa.int32()), *((f.name, f.type) for f in _ASKED), ("started", pa.bool_())])


def _sent(store: VectorStore, radius: np.ndarray, n: np.ndarray, region: np.ndarray):
    """Asked rows once for each region in which they have to visit a cell."""
    full = np.flatnonzero(n)
    centres, starts = store.centres, np.flatnonzero(np.diff(region[full], prepend=-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            i, r = np.nonzero(np.logical_or.reduceat(_reached(batch, centres, radius, full), starts, axis=1))
            rows = batch.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([pa.array(region[full[starts]][r].astype(np.int32)), *(rows.column(f.name) for f in list(_SENT)[1:])], schema=_SENT)

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _met(store: VectorStore, radius: np.ndarray, k: int):
    """The products of a block of queries with the vectors of the cells that they visit in one piece of a region: the k best of each query."""
    centres = store.centres

    def run(lots: pa.Table, asked: pa.Table) -> pa.Table:
        found = [_FOUND.empty_table()]
        if lots.num_rows and asked.num_rows:
            ids, cell, v = lots.column("id").to_numpy(), lots.column("cell").to_numpy(), _rows(lots.column("v").combine_chunks(), centres.shape[1])
            order = np.lexsort((ids, cell))
            ids, cell, v = ids[order], cell[order], v[order]
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            for batch in _slices(asked.combine_chunks().to_batches(), 64):
                q, reach = _rows(batch.column("q"), centres.shape[1]), _reached(batch, centres, radius, cell[starts])
                low = batch.column("low").to_numpy(zero_copy_only=False).astype(float)
                score = np.full((len(q), len(ids)), -np.inf)
                for j, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    at = np.flatnonzero(reach[:, j])
                    if len(at):
                        score[at, lo:hi] = np.round(q[at] @ v[lo:hi].T, 9)
                least = -np.partition(-score, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                for i, s in enumerate(score):
                    place = np.flatnonzero((s >= least[i]) & (s > -np.inf) & ~(s < low[i]))
                    place = place[np.lexsort((ids[place], -s[place]))][:k]
                    found.append(pa.table([pa.array(np.full(len(place), batch.column("query_id")[i].as_py()), pa.int64()), pa.array(ids[place]), pa.array(s[place])], schema=_FOUND))
        return pa.concat_tables(found)

    return run


def _regions(n: np.ndarray) -> np.ndarray:
    """Each cell's region: neighbouring cells that hold about REGION vectors together."""
    return (np.cumsum(n) - n) // REGION


def _visited(store: VectorStore, radius: np.ndarray, n: np.ndarray, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """The products of asked rows with the cells they have to visit that reach their bound, the k best of each piece of a region. Only those regions' partitions are read.

    A region's vectors meet the queries in blocks of about BLOCK, so that a query goes to a region once, not to each of its cells; a
    region of one large cell is dealt to pieces."""
    region = _regions(n)
    sent = storage.written(asked.mapInArrow(_sent(store, radius, n, region), from_arrow_schema(_SENT)), "sent")
    regions = [r[0] for r in sent.select("region").distinct().collect()]  # CELLS at most
    pieces = {int(r): max(1, -(-int(n[region == r].sum()) // (2 * REGION))) for r in regions}
    cells = [(int(c), int(region[c]), pieces[int(region[c])]) for c in np.flatnonzero(np.isin(region, regions) & (n > 0))]
    cells = store.spark.createDataFrame(cells, "cell int, region int, pieces int")  # CELLS at most
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    lots = store.read().join(F.broadcast(cells), "cell").select("region", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), every, "id", "v", "cell")
    parts = store.spark.createDataFrame(list(pieces.items()), "region int, pieces int")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    to = sent.join(F.broadcast(parts), "region").select("region", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), block, *_ASKED.names, "started")
    keys = ["region", "piece", "block"]
    return lots.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInArrow(_met(store, radius, k), from_arrow_schema(_FOUND))


def _counted(store: VectorStore, radius: np.ndarray, n: np.ndarray):
    """How many cells each asked row visits."""
    centres, full = store.centres, np.flatnonzero(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            visited = _reached(batch, centres, radius, full).sum(1) + batch.column("lead").value_lengths().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(visited), pa.array(np.full(batch.num_rows, len(full)))], names=["visited", "cells"])

    return run


def nearest(store: VectorStore, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, id, score), (visited, cells)) of asked (query_id, q): each query's k largest products, rounded to nine places, ties by id,
    and how many pairs of a query and a cell were visited of all there are."""
    radius, n = store.balls()
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    asked = clean(asked).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    if not n.any():
        none = asked.limit(0).select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id"), F.lit(0.0).alias("score"))
        return none, store.spark.createDataFrame([(0, 0)], "visited long, cells long")
    asked = storage.written(asked.mapInArrow(_leads(store, radius, n), from_arrow_schema(_ASKED)), "leads")
    blocks = max(1, -(-asked.count() // BLOCK))
    begun = storage.written(ranked(_visited(store, radius, n, asked.withColumn("started", F.lit(False)), blocks, k)), "begun")
    # a score is rounded, so a bound lies lower by more than that
    low = begun.filter(F.col("rank") == k).select("query_id", (F.col("score") - 2e-9).alias("low"))
    going = storage.written(asked.drop("low").join(low, "query_id", "left").select("query_id", "q", "low", "lead", F.lit(True).alias("started")), "going")
    more = _visited(store, radius, n, going, blocks, k)
    rows = storage.written(ranked(begun.select("query_id", "id", "score").unionByName(more)), "nearest")
    counts = going.mapInArrow(_counted(store, radius, n), "visited long, cells long")
    return rows, counts.agg(F.coalesce(F.sum("visited"), F.lit(0)).alias("visited"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"))
