"""Written intermediate tables: evidence and indexes that several later steps read."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_roots: dict[str, str] = {}
_shared: dict[tuple, object] = {}


def root(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors see; a local session without that
    setting gets one of this machine. It is removed when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            base = "file:///tmp/checkpoints/longview"
        _roots[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def delete(spark: SparkSession, path: str) -> None:
    """A written table that nothing reads any more goes."""
    _remove(spark, path)


def fingerprint(table: DataFrame) -> tuple:
    """The names, sizes and times of a table's files."""
    sc = table.sparkSession.sparkContext
    out = []
    for name in sorted(table.inputFiles()):
        p = sc._jvm.org.apache.hadoop.fs.Path(name)
        status = p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def shared(table: DataFrame, label: str, make: Callable[[str], T]) -> T:
    """What make(folder) made of this table, once for each application while the table's files stay as they are."""
    key = (table.sparkSession.sparkContext.applicationId, label, fingerprint(table))
    if key not in _shared:
        _shared[key] = make(folder(table.sparkSession, label))
    return _shared[key]


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores is dealt to all of them before costly work on its rows; larger
    ones stay as they lie."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= 2 * cores else table.repartition(2 * cores)


def folder(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back, so that what reads it several times doesn't make it again."""
    path = folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out
