"""Windows and transitions on small timelines."""

import datetime as dt

from longview.operators import care_state as cs

EVENTS = "entity long, seq long, kind string, ts timestamp, d date, code string, value double"


def timeline(spark, days):
    rows = [(1, k, kind, dt.datetime(2024, 1, d), dt.date(2024, 1, d), "1", 1.0) for k, (d, kind) in enumerate(days)]
    return spark.createDataFrame(rows, EVENTS)


def test_gap_rows(spark):
    rows = cs.spine(timeline(spark, [(1, "view"), (4, "click")])).orderBy("window_start").collect()
    assert [r["has_data"] for r in rows] == [True, False, False, True] and rows[1]["total"] == 0


def test_single_window_population(spark):
    r = cs.scored(cs.spine(timeline(spark, [(1, "view")]))).first()
    assert r["overall_score"] == 0.0 and r["care_state"] == "STABLE"


def test_gap_blocks_and_observed_resumes(spark):
    states = cs.scored(cs.spine(timeline(spark, [(1, "view"), (2, "view"), (4, "view")])))
    types = [r["transition_type"] for r in cs.transitions(states).orderBy("window_start").collect()]
    assert types == ["INITIAL_STATE", "NO_CHANGE", "GAP", "GAP"]
    seen = [r["transition"] for r in cs.observed_transitions(states).orderBy("window_start").collect()]
    assert seen == ["INITIAL_STATE", "NO_CHANGE", "NO_DATA", "GAP"]


def test_delta_of_exactly_a_tenth(spark):
    rows = [(1, dt.date(2024, 1, 1), 0.5, "MODERATE_ACTIVITY", True), (1, dt.date(2024, 1, 2), 0.6, "MODERATE_ACTIVITY", True)]
    df = spark.createDataFrame([(*r, *([0.0] * 8)) for r in rows], "entity long, window_start date, overall_score double, care_state string, has_data boolean, " + ", ".join(f"{n} double" for n in cs.DIMENSIONS))
    r = cs.transitions(df).orderBy("window_start").collect()[1]
    raw = 0.6 - 0.5
    assert r["transition_type"] == ("INCREASING_ACTIVITY" if raw >= 0.1 else "NO_CHANGE")
    assert r["transition_direction"] == ("INCREASING" if raw > 0.1 else "UNCHANGED")


def test_empty_timeline(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert cs.transitions(cs.scored(cs.spine(empty))).count() == 0
