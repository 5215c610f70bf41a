"""Each rule of each layer: rows that keep all of them, and for each rule a row that breaks it, in both engines."""

from datetime import date

import duckdb
import pytest

from longview.operators import care_state as cs
from longview.operators import validation as V

D1, D2 = date(2020, 1, 1), date(2021, 1, 1)
PROFILE = dict(first_date=D1, last_date=D2, events=5, dated=5, codes=2, purchases=1, per_year=5.0, span_days=366, copies=1)
FEATURE = dict(last_date=D2, events=5, recent=3, purchases=1, copies=1, **dict.fromkeys(V.RECENT, 0) | {"recent_view": 2, "recent_purchase": 1})
WINDOW = dict(current_state="STABLE", previous_state="STABLE", overall_score=0.2, transition_type="NO_CHANGE", transition_direction="STABLE", assistance_mode="MONITOR")
PLAN = dict(strategy="ONBOARDING_SUPPORT", actions="a", safety_flags="f", place=1, copies=1)
CHUNK = dict(words=180, chunk_id=1, last=2, chunks=2, id="doc000001__00001")
QUESTION = dict(n=2, last=2, kinds=2)
EXPERIMENT = dict(n=3, above=1, equal=1, below=1, mean_a=2.0, mean_b=1.0, mean_diff=1.0, sd_diff=0.5, t=2.0, low=0.5, high=1.5)

CASES = {
    "PROFILES": (PROFILE, {
        "span_order": dict(first_date=D2, last_date=D1), "dated_within_events": dict(dated=6), "codes_within_events": dict(codes=6), "negative_rate": dict(per_year=-1.0), "no_events": dict(events=0),
        "dated_without_first": dict(first_date=None), "first_without_last": dict(last_date=None), "purchases_within_events": dict(purchases=6), "rate_without_span": dict(span_days=0), "negative_span": dict(span_days=-1), "repeated_entity": dict(copies=2),
    }),
    "FEATURES": (FEATURE, {
        "recent_within_total": dict(recent=6), "parts_make_total": dict(recent_view=1), "negative_count": dict(recent_error=-1), "recent_without_date": dict(last_date=None), "purchases_within_all": dict(recent_purchase=2), "repeated_entity": dict(copies=2),
    }),
    "WINDOWS": (WINDOW, {
        "no_data_without_score": dict(current_state="NO_DATA"), "score_range": dict(overall_score=1.1), "no_data_waits": dict(current_state="NO_DATA", overall_score=None), "gap_has_no_data": dict(transition_type="GAP"),
        "escalation_increases": dict(transition_type="STATE_ESCALATION"), "known_state": dict(current_state="FINE"),
    }),
    "PLANS": (PLAN, {"unknown_strategy": dict(strategy="NONE"), "gap_flag_missing": dict(strategy="DATA_COLLECTION_SUPPORT"), "no_actions": dict(actions=None), "onboarding_first_only": dict(place=2), "repeated_key": dict(copies=2)}),
    "CHUNKS": (CHUNK, {"empty_chunk": dict(words=0), "too_many_words": dict(words=181), "short_before_last": dict(words=20), "missing_chunk": dict(chunks=1), "id_form": dict(id="d1")}),
    "QUESTIONS": (QUESTION, {"place_gap": dict(last=3), "repeated_sentence": dict(kinds=1)}),
    "EXPERIMENTS": (EXPERIMENT, {
        "wins_make_n": dict(n=4), "mean_difference": dict(mean_a=3.0), "interval_order": dict(low=2.0), "mean_outside_interval": dict(high=0.9), "t_sign": dict(t=-2.0), "negative_deviation": dict(sd_diff=-0.1),
    }),
}


@pytest.mark.parametrize("layer", sorted(CASES))
def test_each_rule_fires(spark, layer):
    rules, (good, broken) = getattr(V, layer), CASES[layer]
    assert broken.keys() == rules.keys()
    schema = ", ".join(f"{k} {dict(date='date', int='long', float='double', str='string')[type(v).__name__]}" for k, v in good.items())
    table = spark.createDataFrame([(n, *(good | change).values()) for n, change in [("", {}), *broken.items()]], "broken string, " + schema)
    counted = {n: {r.rule: r.violations for r in V.violations(table.filter(table.broken == n), rules).collect()} for n in broken}
    assert all(counted[n][n] == 1 for n in broken), counted
    assert set(dict(V.violations(table.filter("broken = ''"), rules).collect()).values()) == {0}
    con = duckdb.connect()
    con.register("given", table.toPandas().convert_dtypes())
    for n in ["", *broken]:
        got = dict(con.sql(V.violations_sql(f"select * from given where broken = '{n}'", rules)).fetchall())
        assert got == (counted[n] if n else dict.fromkeys(rules, 0))


def test_fixed_names_are_known():
    assert "STABLE" in cs.ORDER and "ONBOARDING_SUPPORT" in cs.ACTIONS
