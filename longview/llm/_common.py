"""What the operators of this subpackage share: the scratch folder and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to Python while a table is written; texts can be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL_DEFAULT = "file:///tmp/checkpoints/longview"
_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder for written intermediate tables, one per application.

    It lies in spark.checkpoint.dir, which every executor and the driver see. Only a local session
    (tests), where that setting is absent, gets a folder of this machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            base = _LOCAL_DEFAULT
        root = f"{base.rstrip('/')}/longview-{uuid.uuid4().hex}"
        _roots[app] = root
        atexit.register(_remove, spark, root)
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage ends at replicated files, so a
    lost executor costs a re-read, and values made once (ranks, task numbers) can't change on a retry.

    While it is written, Python gets batches of at most batch_rows rows; the session's setting is put back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, str(min(batch_rows, int(rows)) if int(rows) > 0 else batch_rows))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that `materialize` wrote and nothing reads any more."""
    _remove(table.sparkSession, table._written)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInPandas or mapInArrow, after which the worker gives freed memory back: workers idle between
    stages, beside the executor's own memory."""
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library, which has no such call
                pass

    return tidied


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: the held-out fifth is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
