import datetime as dt

from longview.streaming import windows as W


def write(spark, path, rows, name):
    data = [(i, dt.datetime(2024, 1, d, h), u, k, 1.0, "{}") for i, d, h, u, k in rows]
    spark.createDataFrame(data, W.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def test_state_lives_over_batches(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    write(spark, src, [(1, 1, 0, 7, "view"), (2, 1, 1, 7, "view")], "b1")
    read = lambda: spark.readStream.schema(W.EVENTS).option("recursiveFileLookup", True).parquet(src)
    W.upsert(W.moves(read()), str(tmp_path / "out"), cp)
    write(spark, src, [(3, 1, 2, 7, "view"), (4, 1, 3, 7, "click")], "b2")
    W.upsert(W.moves(read()), str(tmp_path / "out"), cp)
    got = {(r["previous"], r["current"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(None, "view"), ("view", "click")}


def test_late_rows_are_left_out_and_sessions_close(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    write(spark, src, [(1, 1, 0, 7, "view"), (2, 1, 1, 7, "view"), (3, 5, 0, 7, "view"), (4, 9, 0, 7, "view")], "b1")
    read = lambda: spark.readStream.schema(W.EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
    W.upsert(W.sessions(read(), "3 hours"), str(tmp_path / "out"), cp)
    write(spark, src, [(5, 1, 2, 7, "view")], "b2")
    W.upsert(W.sessions(read(), "3 hours"), str(tmp_path / "out"), cp)
    got = {(r["start"].day, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2), (5, 1)}
