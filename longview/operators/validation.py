"""Rules that rows of a layer must keep, as SQL conditions that hold where one is broken, and how many rows break each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import care_state as cs


def _names(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


RECENT = [f"recent_{k}" for k in ("view", "click", "error", "purchase", "signup")]

PROFILES = {
    "span_order": "first_date > last_date", "dated_within_events": "dated > events", "codes_within_events": "codes > events", "negative_rate": "per_year < 0", "no_events": "events < 1",
    "dated_without_first": "(dated > 0) <> (first_date is not null)", "first_without_last": "(first_date is null) <> (last_date is null)", "purchases_within_events": "purchases > events",
    "rate_without_span": "coalesce(span_days, 0) = 0 and per_year <> 0", "negative_span": "span_days < 0", "repeated_entity": "copies > 1",
}
FEATURES = {
    "recent_within_total": "recent > events", "parts_make_total": " + ".join(RECENT) + " <> recent", "negative_count": f"least({', '.join(RECENT)}) < 0", "recent_without_date": "recent > 0 and last_date is null",
    "purchases_within_all": "recent_purchase > purchases", "repeated_entity": "copies > 1",
}
WINDOWS = {
    "no_data_without_score": "current_state = 'NO_DATA' and overall_score is not null", "score_range": "overall_score < 0 or overall_score > 1",
    "no_data_waits": "current_state = 'NO_DATA' and transition_type <> 'INITIAL_STATE' and assistance_mode <> 'WAIT_FOR_DATA'",
    "gap_has_no_data": "transition_type = 'GAP' and current_state <> 'NO_DATA' and previous_state <> 'NO_DATA'",
    "escalation_increases": "transition_type = 'STATE_ESCALATION' and transition_direction <> 'INCREASING'", "known_state": f"current_state not in ({_names(['NO_DATA', *cs.ORDER])})",
}
PLANS = {
    "unknown_strategy": f"strategy not in ({_names(cs.ACTIONS)})", "gap_flag_missing": f"strategy = 'DATA_COLLECTION_SUPPORT' and not contains(safety_flags, '{cs.GAP_SAFETY}')", "no_actions": "coalesce(actions, '') = ''",
    "onboarding_first_only": "strategy = 'ONBOARDING_SUPPORT' and place > 1", "repeated_key": "copies > 1",
}
CHUNKS = {
    "empty_chunk": "words < 1", "too_many_words": "words > 180", "short_before_last": "chunk_id < last and words <> 180", "missing_chunk": "chunks <> last",
    "id_form": "length(id) < 16 or substring(id, 1, 3) <> 'doc' or not contains(id, '__')",
}
QUESTIONS = {"place_gap": "n <> last", "repeated_sentence": "n <> kinds"}
EXPERIMENTS = {
    "wins_make_n": "above + equal + below <> n", "mean_difference": "abs(mean_a - mean_b - mean_diff) > 1e-5", "interval_order": "low > high", "mean_outside_interval": "mean_diff < low - 1e-5 or mean_diff > high + 1e-5",
    "t_sign": "t * mean_diff < 0", "negative_deviation": "sd_diff < 0",
}


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations); a condition that is null isn't one."""
    sums = rows.agg(*(F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in rules.items()))
    return sums.selectExpr(f"stack({len(rules)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in rules)}) as (rule, violations)")


def violations_sql(rows: str, rules: dict[str, str]) -> str:
    """The same over a query's rows."""
    return f"with checked as ({rows}) select unnest([{_names(rules)}]) as rule, unnest([{', '.join(f'count(*) filter ({c})' for c in rules.values())}]) as violations from checked"
