"""A table of rows by key in a folder: create, read, upsert and delete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


class KeyedTable:
    """Changes are appended as numbered Parquet folders, so a write costs what it changes, and a write that is run again
    under its number replaces itself. A key's newest change counts; compact() makes one change of all. A folder
    that is there is taken up where it ends; a write that didn't finish counts for nothing.

    One writer at a time. A change must hold a key once (ValueError); null keys are keys. A table without changes has no rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        self.schema = spark.createDataFrame([], schema).schema
        numbers = self._numbers()
        self.changes, self.first = max(numbers, default=0), max((n for n, whole in numbers.items() if whole), default=1)
        self.whole = self.first if numbers.get(self.first) else 0

    def _numbers(self) -> dict[int, bool]:
        """The finished changes in the folder, and whether each is a whole table."""
        sc = self.spark.sparkContext
        root = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [n for n in names if fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return {int(n.rpartition("=")[2]): n.startswith("whole=") for n in done if n.startswith(("change=", "whole="))}

    def _folder(self, number: int, whole: bool) -> str:
        return f"{self.path}/{'whole' if whole else 'change'}={number}"

    def _append(self, rows: DataFrame, gone: bool, whole: bool = False) -> int:
        if not rows.groupBy(*self.keys).count().filter("count > 1").isEmpty():
            raise ValueError("a key is there twice")
        rows.select(F.struct(*rows.columns).alias("row"), F.lit(gone).alias("gone")).write.mode("overwrite").parquet(self._folder(self.changes + 1, whole))
        self.changes += 1
        self.whole = self.changes if whole else self.whole
        return self.changes

    def upsert(self, rows: DataFrame) -> int:
        """Adds rows with new keys and replaces those with known ones; gives the change's number."""
        return self._append(rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)), False)

    def delete(self, rows: DataFrame) -> int:
        """Removes the rows of these keys; unknown ones change nothing."""
        keyed = rows.select(*(F.col(k).cast(self.schema[k].dataType) for k in self.keys)).distinct()
        rest = [f for f in self.schema if f.name not in self.keys]
        return self._append(keyed.select(*self.keys, *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest)).select(self.schema.names), True)

    def read(self) -> DataFrame:
        if not self.changes:
            return self.spark.createDataFrame([], self.schema)
        kinds = StructType([StructField("row", self.schema), StructField("gone", BooleanType())])
        at = [self.spark.read.schema(kinds).parquet(self._folder(n, n == self.whole)).withColumn("change", F.lit(n)) for n in range(self.first, self.changes + 1)]
        rows = reduce(DataFrame.union, at)
        if len(at) > 1:
            rows = rows.groupBy(*(F.col(f"row.`{k}`").alias(f"key{i}") for i, k in enumerate(self.keys))).agg(F.max_by(F.struct("row", "gone"), "change").alias("last")).select("last.*")
        return rows.filter("not gone").select("row.*")

    def compact(self) -> None:
        """Writes what is there as one change, which reading then starts at."""
        self.first = self._append(self.read(), False, True)
