"""Points meet a row for each tier of block sizes, not for each size."""

import datetime

from pyspark.sql import functions as F

from longview import storage
from longview.operators import intervals


def test_points_meet_a_row_for_each_tier(spark, monkeypatch):
    day = lambda n: datetime.date(1970, 1, 1) + datetime.timedelta(n)
    spans = [(1, 3, 10 + 37 * i % 400, i) for i in range(40)] + [(1, 100, 9000, 50), (2, 500, 500, 60), (2, 9, 3, 61)]
    windows = spark.createDataFrame([(e, day(a), day(b), w, False) for e, a, b, w in spans], "entity int, first date, last date, window int, gap boolean")
    points = spark.createDataFrame([(e, day(d)) for e in (1, 2, 3) for d in range(0, 600, 7)], "entity int, at date")
    real, kept = storage.written, {}

    def written(df, label):
        kept[label] = real(df, label)
        return kept[label]

    monkeypatch.setattr(storage, "written", written)
    rows = intervals.containing(points, windows)
    got = {(r["entity"], r["at"]): r["window"] for r in rows.filter("how = 'CONTAINS'").collect()}
    want = {}
    for e in (1, 2, 3):
        for d in range(0, 600, 7):
            holding = [(a, w) for x, a, b, w in spans if x == e and a <= d <= b]
            if holding:
                want[e, day(d)] = min(holding)[1]
    assert got == want and got
    # the rows a point can meet: one for each tier of its entity, though the blocks are of more sizes
    regions = kept["regions"]
    assert regions.select("tier").distinct().count() == 2 < regions.select(F.explode("blocks.level")).distinct().count()
