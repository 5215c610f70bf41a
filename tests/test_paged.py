"""A paged source that fails on schedule, and differences by digests."""

import pathlib

import pytest
from pyspark.sql import functions as F

from longview.operators import difference
from longview.sources.paged import again, paged_source


class Flaky:
    """Ids of a table, only the first 30 while the file `few` is there; every third page fails twice, and `lost` pages fail for good while
    the file `down` is there."""

    def __init__(self, ids, folder, lost=()):
        self.ids, self.folder, self.lost = ids, str(folder), lost

    def count(self):
        return min(30, len(self.ids)) if (pathlib.Path(self.folder) / "few").exists() else len(self.ids)

    def page(self, offset, size):
        folder = pathlib.Path(self.folder)
        if offset in self.lost and (folder / "down").exists():
            raise ConnectionError("refused")
        tries = len(list(folder.glob(f"try-{offset}-*")))
        (folder / f"try-{offset}-{tries}").touch()
        if offset // size % 3 == 0 and tries < 2:
            raise TimeoutError("timed out")
        return [(i, f"title {i}") for i in self.ids[offset : min(offset + size, self.count())]]


def ids_of(spark, sf):
    return sorted(r[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id").collect())


def test_batch_reads_each_id_once(spark, sf, tmp_path):
    ids = ids_of(spark, sf)
    spark.dataSource.register(paged_source("flaky_batch", "id long, title string", Flaky(ids, tmp_path)))
    rows = spark.read.format("flaky_batch").option("page", 7).option("pause", 0.001).load().collect()
    assert sorted(r["id"] for r in rows) == ids and len(list(tmp_path.glob("try-0-*"))) == 3
    spark.dataSource.register(paged_source("no_ids", "id long, title string", Flaky([], tmp_path)))
    assert spark.read.format("no_ids").load().count() == 0


def test_pages_that_fail_for_good_raise():
    with pytest.raises(OSError):
        again(lambda: (_ for _ in ()).throw(ConnectionError("refused")), 2, 0.001)
    with pytest.raises(KeyError):  # what isn't the transport's failure isn't tried again
        again(lambda: {}["x"], 5, 100)


def test_stream_goes_on_after_a_restart(spark, sf, tmp_path):
    ids = ids_of(spark, sf)
    (tmp_path / "few").touch()
    spark.dataSource.register(paged_source("flaky_stream", "id long, title string", Flaky(ids, tmp_path, lost=(37,))))

    def run():
        rows = spark.readStream.format("flaky_stream").option("page", 7).option("pause", 0.001).option("tries", 3).load()
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    written = lambda: sorted(r["id"] for r in spark.read.schema("id long").parquet(f"{tmp_path}/out").collect())
    run()
    assert written() == ids[:30]
    run()  # nothing new
    (tmp_path / "few").unlink()
    (tmp_path / "down").touch()
    with pytest.raises(Exception, match="refused"):
        run()
    assert written() == ids[:30]
    (tmp_path / "down").unlink()
    run()
    assert written() == ids
    assert len(list(tmp_path.glob("try-7-*"))) == 1  # what was written before isn't fetched again


def test_differences_read_few_buckets(spark, tmp_path):
    rows = [(i, f"g{i % 5}", None if i % 7 == 0 else float(i)) for i in range(2000)]
    schema = "id long, g string, x double"
    a = spark.createDataFrame(rows, schema)
    b = a.filter("id <> 77").withColumn("x", F.when(F.col("id") == 500, -1.0).when(F.col("id") == 700, F.lit(0.0)).otherwise(F.col("x"))).unionByName(spark.createDataFrame([(9999, "new", 1.0)], schema))
    left, right, again_ = f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c"
    difference.write(a, ["id"], left)
    difference.write(b, ["id"], right)
    difference.write(a.orderBy(F.desc("id")), ["id"], again_)
    assert difference.differing_buckets(spark, left, again_) == [] and difference.differences(spark, left, again_, ["id"]).count() == 0
    found = difference.differing_buckets(spark, left, right)
    assert 1 <= len(found) <= 4 < 64
    got = sorted(tuple(r) for r in difference.differences(spark, left, right, ["id"]).collect())
    assert got == [(77, "-", "present", None), (500, "x", "500.0", "-1.0"), (700, "x", None, "0.0"), (9999, "-", None, "present")]
    read = spark.read.parquet(f"{left}/rows").filter(F.col("_bucket").isin(found))
    assert len(read.inputFiles()) > 0 and read.count() < 0.15 * 2000
    difference.frozen(spark, a, left, ["id"], f"{tmp_path}/d")
    with pytest.raises(ValueError, match="buckets differ"):
        difference.frozen(spark, b, left, ["id"], f"{tmp_path}/e")
