"""What the searches over all vectors share: clean rows, first copies, blocks of rows, and rounds of blocks against cells.

Candidates lie in cells, one for each partition that packed them; queries lie in blocks. Each block meets each cell through an
equi-join on the cell: a stated query set against all rows, in blocks, never a pair of rows. Cells are taken in rounds that
grow by GROWTH, and each round starts from the bounds that the rounds before it have proved, so that what a
round finds stays near k rows a query however many cells there are.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import discard, materialize, tidy

#: How many times as many cells as the round before a round takes.
GROWTH = 8
#: Tasks of a round at most.
TASKS = 20_000
#: Rows of a cell at most, about, and at least where there are enough for EVEN cells.
CELL, EVEN = 32_768, 8
#: Bytes of a cell's vectors as doubles, about, which bounds its rows where vectors are long.
CELL_BYTES = 1 << 25
#: Packed rows that go to Python at once.
AT_ONCE = 4

PACKED = pa.schema([("part", pa.int64()), ("place", pa.int32()), ("data", pa.binary())])


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return {k: arrays[k] for k in arrays.files}


def finite(c: Column) -> Column:
    """No component is null, NaN or infinite."""
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def first_copies(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """Of rows with equal v (and equal by) the k with the smallest ids: the others have the same score for any query and rank
    behind these, so no list of k can hold them. Each task drops its own surplus before the shuffle."""
    order = Window.partitionBy(F.xxhash64("v"), "v", *by).orderBy("vec_id")
    return rows.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") <= k).drop("_copy")


def asked_once(rows: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Queries with equal v (and equal by) are asked once: (the smallest id's row of each, (vec_id, rep) of every query)."""
    rows = materialize(rows.withColumn("h", F.xxhash64("v")), "asked")
    reps = materialize(rows.groupBy("h", "v", *by).agg(F.min("vec_id").alias("rep")), "reps")
    members = rows.select("vec_id", "h", "v", *by).join(reps, ["h", "v", *by]).select("vec_id", "rep")
    return reps.select(F.col("rep").alias("vec_id"), "v", *by), materialize(members, "members")


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Lists as rows; shorter ones are padded with zeros."""
    n = lists.value_lengths().to_numpy()
    out = np.zeros((len(n), dim))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


def packed(rows: DataFrame, dim: int, size: int, columns: list[str], make: Callable[..., bytes], label: str) -> DataFrame:
    """(part, place, data): rows (v, columns ...) where they lie, size at a time, each lot through make(v, columns ...)."""
    size = max(1, min(size, CELL_BYTES // (8 * dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, lots = TaskContext.get().partitionId(), 0, 0, []

        def lot() -> pa.RecordBatch:
            arrays = [np.concatenate([x[i] for x in lots]) for i in range(1 + len(columns))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([place], pa.int32()), pa.array([make(*arrays)], pa.binary())], schema=PACKED)

        for batch in batches:
            v, rest = matrix(batch.column("v"), dim), [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            at = 0
            while at < len(v):
                took = min(len(v) - at, size - held)
                lots.append([v[at : at + took], *(x[at : at + took] for x in rest)])
                at, held = at + took, held + took
                if held == size:
                    yield lot()
                    place, held, lots = place + 1, 0, []
        if held:
            yield lot()

    return materialize(rows.select("v", *columns).mapInArrow(tidy(run), from_arrow_schema(PACKED)), label)


def dealt(rows: DataFrame, dim: int) -> DataFrame:
    """Rows dealt to cells by their id."""
    n = rows.count()
    return rows.repartition(max(1, min(EVEN, n), -(-n // max(1, min(CELL, CELL_BYTES // (8 * dim))))), "vec_id")


def in_rounds(queries: DataFrame, cells: DataFrame, search: Callable, schema: pa.Schema, merge: Callable[[DataFrame], DataFrame], least: Column) -> DataFrame | None:
    """The merged rows of all rounds, or None where there are no cells.

    search(head data, {query: bound so far}) gives an object that meets each tail's data and then gives rows of schema, which has
    block and query. merge ranks what all rounds have found; least, an aggregate over a query's merged rows, is its proven bound
    (null if there is none yet)."""
    spark = queries.sparkSession
    queries = queries.withColumn("block", F.col("part") * (1 << 31) + F.col("place")).select("block", "data")
    blocks, last = queries.count(), cells.agg(F.max("part")).first()[0]
    best, lows, lo, width = None, spark.createDataFrame([], "block long, asked array<long>, lows array<double>"), 0, 1
    sent = ["block", "cell", "place", "data", "asked", "lows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in sent}
                if row["place"] < 0:
                    if state:
                        yield from state.rows(key)
                    key, state = row["block"], search(unpack(row["data"]), dict(zip(row["asked"] or [], row["lows"] or [], strict=True)))
                else:
                    yield from state.meet(key, unpack(row["data"]))
        if state:
            yield from state.rows(key)

    while last is not None and lo <= last:
        hi = min(last, lo + width - 1)
        pairs = queries.select("block", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).alias("cell"))
        heads = pairs.join(queries, "block").join(lows, "block", "left").withColumn("place", F.lit(-1)).select(sent)
        tails = pairs.join(cells.withColumnRenamed("part", "cell"), "cell").withColumns({"asked": F.lit(None).cast("array<long>"), "lows": F.lit(None).cast("array<double>")}).select(sent)
        work = heads.unionByName(tails).repartition(max(8, min(blocks * (hi - lo + 1), TASKS)), "block", "cell").sortWithinPartitions("block", "cell", "place")
        found = materialize(work.mapInArrow(tidy(run), from_arrow_schema(schema)), "found", AT_ONCE)
        better = materialize(merge(found if best is None else best.select(found.columns).unionByName(found)), "best")
        for table in (found, best):
            if table is not None:
                discard(table)
        best, lo, width = better, hi + 1, width * GROWTH
        if lo <= last:
            each = best.groupBy("block", "query").agg(least.alias("low")).filter("low is not null")
            lows = materialize(each.groupBy("block").agg(F.collect_list("query").alias("asked"), F.collect_list("low").alias("lows")), "lows")
    return best
