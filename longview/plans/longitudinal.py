"""Longitudinal queries over events: windows, scores, transitions, assistance and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import level, pct, signed
from ..operators import care_state as cs
from ..operators import validation
from ..tables import timeline

KEYS = ["entity", "window_start"]


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return cs.spine(timeline(spark, sf))


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return cs.scored(_windows(spark, sf))


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    return cs.transitions(_states(spark, sf))


def _helped(spark: SparkSession, sf: str) -> DataFrame:
    return cs.assistance(cs.transitions(_states(spark, sf), dimensions=False))


def d1_window_counts(spark, sf):
    return cs.window_counts(timeline(spark, sf)).select("entity", "d", *cs.COUNTS)


def h1_spine(spark, sf):
    return _windows(spark, sf).select(*KEYS, *cs.COUNTS, "has_data")


def e1_percentile(spark, sf):
    ranks = cs.percentile_ranks(_windows(spark, sf).filter("has_data"), KEYS, list(cs.COUNTS))
    return ranks.select(*KEYS, *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in cs.COUNTS))


def k1_state(spark, sf):
    return _states(spark, sf).select(*KEYS, *cs.DIMENSIONS, "overall_score", "care_state", level(F.col("overall_score")).alias("level"))


def e2_transition(spark, sf):
    return cs.transitions(_states(spark, sf), dimensions=False)


def e3_last_observed(spark, sf):
    return cs.observed_transitions(_states(spark, sf))


def e4_dim_delta(spark, sf):
    rows = _moves(spark, sf).select(*KEYS, F.explode("changed_dimensions").alias("c"))
    way = F.when(F.col("c.delta") > 0, "INCREASED").otherwise("DECREASED")
    return rows.select(*KEYS, "c.dimension", "c.previous_score", "c.current_score", "c.delta", way.alias("direction"), signed(F.col("c.delta")).alias("label"))


def k4_assistance(spark, sf):
    return _helped(spark, sf).select(*KEYS, "previous_state", "current_state", "transition_type", "transition_magnitude", "transition_direction", "assistance_mode", "priority", "reason_codes")


def k5_strategy(spark, sf):
    return cs.strategies(_helped(spark, sf)).select(*KEYS, "transition_type", "context_status", "assistance_mode", "strategy")


def k6_actions(spark, sf):
    return cs.plans(cs.strategies(_helped(spark, sf))).select(*KEYS, "strategy", "actions", "safety_flags")


def k8_rule_check(spark, sf):
    """Assistance rederived from state and move by joins with rule tables, and the rows on which both differ."""
    helped = _helped(spark, sf)
    modes = spark.createDataFrame(list(cs.MOVE_MODE.items()), "transition_type string, by_move string")
    states = spark.createDataFrame(list(cs.STATE_MODE.items()), "current_state string, by_state string")
    rows = helped.join(F.broadcast(modes), "transition_type", "left").join(F.broadcast(states), "current_state", "left")
    expected = F.coalesce("by_move", "by_state")
    return rows.groupBy("transition_type").agg(F.count("*").alias("windows"), F.count_if(expected != F.col("assistance_mode")).alias("mismatches"))


def c2_junction(spark, sf):
    """Windows joined with states, moves and assistance on the key, and per-entity features; missing sides counted."""
    states = _states(spark, sf)
    helped = cs.assistance(cs.transitions(states, dimensions=False)).select(*KEYS, "transition_type", "assistance_mode")
    active = states.filter("has_data").select(*KEYS, "overall_score")
    people = timeline(spark, sf).filter("kind = 'purchase'").groupBy("entity").agg(F.count("*").alias("purchases"))
    rows = states.select(*KEYS, "care_state").join(helped, KEYS, "left").join(active, KEYS, "left").join(people, "entity", "left")
    return rows.groupBy("care_state").agg(
        F.count("*").alias("windows"), F.count_if(F.col("assistance_mode").isNull()).alias("missing_assistance"),
        F.count_if(F.col("overall_score").isNull()).alias("missing_score"), F.count_if(F.col("purchases").isNull()).alias("missing_entity"),
    )


def d2_dist(spark, sf):
    rows = _states(spark, sf).groupBy("care_state").agg(F.count("*").alias("n"))
    return rows.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def d15_matrix(spark, sf):
    """Moves between states with their share of all and of the previous state, with and without gaps."""
    cells = _helped(spark, sf).filter("previous_state is not null").groupBy("previous_state", "current_state").agg(F.count("*").alias("n"))
    both = cells.withColumn("scope", F.lit("all")).unionByName(cells.filter("previous_state <> 'NO_DATA' and current_state <> 'NO_DATA'").withColumn("scope", F.lit("active")))
    total, row = Window.partitionBy("scope"), Window.partitionBy("scope", "previous_state")
    return both.withColumns({"pct_total": pct(F.col("n"), F.sum("n").over(total)), "pct_row": pct(F.col("n"), F.sum("n").over(row))})


def d16_crosstab(spark, sf):
    cells = _helped(spark, sf).groupBy("current_state", "assistance_mode", "priority").agg(F.count("*").alias("n"))
    total, row = Window.partitionBy(F.lit(1)), Window.partitionBy("current_state")
    return cells.withColumns({"pct_total": pct(F.col("n"), F.sum("n").over(total)), "pct_row": pct(F.col("n"), F.sum("n").over(row))})


def d17_dominant(spark, sf):
    return cs.dominant_state(_states(spark, sf))


def d17_ever_seen(spark, sf):
    return _states(spark, sf).groupBy("care_state").agg(F.countDistinct("entity").alias("entities"))


def d21_decision_moves(spark, sf):
    rows = _helped(spark, sf).select(F.concat_ws("->", F.coalesce("previous_state", F.lit("MISSING")), "current_state").alias("move"))
    counts = rows.groupBy("move").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def d23_policies(spark, sf):
    """Full policy against the state-only and the fixed ones: distinct modes, agreement and rates of change."""
    rows = _helped(spark, sf).withColumn("by_state", cs.choose(F.col("current_state"), cs.STATE_MODE, "WAIT_FOR_DATA"))
    differs = F.count_if(F.col("assistance_mode") != F.col("by_state"))
    return rows.groupBy("transition_type").agg(
        F.count("*").alias("windows"), F.countDistinct("assistance_mode").alias("modes"), F.countDistinct("by_state").alias("state_modes"),
        differs.alias("driven_by_move"), F.round(100.0 * differs / F.count("*"), 2).alias("driven_pct"),
    )


def e5_runs(spark, sf):
    runs = cs.run_lengths(_states(spark, sf))
    return runs.groupBy("care_state").agg(F.count("*").alias("runs"), F.max("windows").alias("longest"), F.round(F.avg("windows"), 4).alias("mean_windows"))


def h4_status(spark, sf):
    return cs.strategies(_helped(spark, sf)).groupBy("context_status").agg(F.count("*").alias("n"))


def d14_rollup(spark, sf):
    rows = _states(spark, sf).filter("has_data")
    out = rows.rollup("care_state").agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 6).alias("mean_score"), F.max("total").alias("most_events"))
    return out.withColumn("care_state", F.coalesce("care_state", F.lit("ALL")))


def m4_rules(spark, sf):
    """Invariants of windows and moves: violations by rule, 0 each."""
    rows = _helped(spark, sf).join(_states(spark, sf).select(*KEYS, "overall_score", "has_data"), KEYS)
    return validation.violations(rows, validation.WINDOWS)


# SQL

_C = ", ".join(f"count(*) filter (event_type = '{k}') as {n}" for n, k in cs.KINDS.items())
_COUNTS = f"""
cnt as (select entity, d, {_C}, count(*) as total, {", ".join(f"0::bigint as {n}" for n in cs.ABSENT)} from ev group by entity, d),
cn as (select *, medication_request + medication_administration as medication from cnt)"""
BASE = f"""with ev as (select user_id as entity, event_id as seq, event_type, ts, cast(ts as date) as d, json_extract_string(props, '$.k') as code, value from events), {_COUNTS},
sp as (select entity, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as window_start from cn group by entity),
w as (select sp.entity, sp.window_start, {", ".join(f"coalesce({c}, 0) as {c}" for c in cs.COUNTS)}, cn.total is not null as has_data
  from sp left join cn on sp.entity = cn.entity and sp.window_start = cn.d)"""
_P = ", ".join(f"case when count(*) over () > 1 then (count(*) over (order by {c} range between unbounded preceding and current row) - 1)::double / (count(*) over () - 1) else 0.0 end as p_{c}" for c in cs.COUNTS)
PCT = BASE + f", p as (select entity, window_start, {_P} from w where has_data)"


def _weights(parts: dict[str, float], prefix: str) -> str:
    return " + ".join(f"{prefix}{n} * {v}::double" for n, v in parts.items())


STATE = PCT + f""", dm as (select entity, window_start, {", ".join(f"round(greatest(0.0::double, least(1.0::double, {_weights(v, 'p_')})), 4) as {n}" for n, v in cs.DIMENSIONS.items())} from p),
ov as (select *, round({_weights(cs.OVERALL, '')}, 4) as overall_score from dm),
st as (select w.*, {", ".join(f"ov.{n}" for n in cs.DIMENSIONS)}, ov.overall_score,
  case when not has_data then 'NO_DATA' when overall_score < 0.25 then 'STABLE' when overall_score < 0.5 then 'LOW_ACTIVITY' when overall_score < 0.75 then 'MODERATE_ACTIVITY' else 'HIGH_ACTIVITY' end as care_state
  from w left join ov on w.entity = ov.entity and w.window_start = ov.window_start)"""
_RANK = "case {} when 'STABLE' then 0 when 'LOW_ACTIVITY' then 1 when 'MODERATE_ACTIVITY' then 2 when 'HIGH_ACTIVITY' then 3 end"
MOVE = STATE + f""", lg as (select *, coalesce(overall_score, 0.0) as current_score, lag(care_state) over o as previous_state, lag(coalesce(overall_score, 0.0)) over o as previous_score
  from st window o as (partition by entity order by window_start)),
mv0 as (select *, current_score - previous_score as raw, care_state as current_state from lg),
mv1 as (select *, case when previous_state is null then 'INITIAL_STATE' when previous_state = 'NO_DATA' or current_state = 'NO_DATA' then 'GAP'
  when previous_state <> current_state and {_RANK.format("current_state")} > {_RANK.format("previous_state")} then 'STATE_ESCALATION' when previous_state <> current_state then 'STATE_DEESCALATION'
  when raw >= 0.1::double then 'INCREASING_ACTIVITY' when raw <= -0.1::double then 'DECREASING_ACTIVITY' else 'NO_CHANGE' end as transition_type from mv0),
mv as (select entity, window_start, current_state, current_score, previous_state, previous_score, transition_type, round(raw, 4) as score_delta, has_data, overall_score,
  case transition_type when 'INITIAL_STATE' then 'INITIAL' when 'GAP' then 'UNKNOWN' when 'STATE_ESCALATION' then 'INCREASING' when 'STATE_DEESCALATION' then 'DECREASING'
    else case when raw > 0.1::double then 'INCREASING' when raw < -0.1::double then 'DECREASING' else 'UNCHANGED' end end as transition_direction,
  case when transition_type in ('INITIAL_STATE', 'GAP') then null when abs(raw) < 0.1::double then 'MINOR' when abs(raw) < 0.25::double then 'MODERATE' else 'LARGE' end as transition_magnitude
  from mv1)"""


def _case(column: str, table: dict[str, str], other: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {other} end"


_BASE_MODE, _BASE_PRIORITY = _case("current_state", cs.STATE_MODE, "'WAIT_FOR_DATA'"), _case("current_state", cs.STATE_PRIORITY, "'LOW'")
HELP = MOVE + f""", hp as (select *, {_case("transition_type", cs.MOVE_MODE, _BASE_MODE)} as assistance_mode,
  case transition_type when 'GAP' then 'LOW' when 'STATE_ESCALATION' then 'HIGH' when 'STATE_DEESCALATION' then 'MODERATE'
    when 'INCREASING_ACTIVITY' then (case when {_BASE_PRIORITY} = 'HIGH' then 'HIGH' else 'MODERATE' end) when 'DECREASING_ACTIVITY' then (case when {_BASE_PRIORITY} = 'HIGH' then 'HIGH' else 'MODERATE' end)
    else {_BASE_PRIORITY} end as priority, {_case("transition_type", cs.REASONS, "'DEFAULT_RULE'")} as reason_codes from mv)"""
_STRATEGY = _case("transition_type", cs.MOVE_STRATEGY, _case("assistance_mode", cs.MODE_STRATEGY, "'CONTEXTUAL_SUPPORT'"))
PLAN = HELP + f""", sg as (select *, case when current_state = 'NO_DATA' then 'DATA_GAP' when transition_type = 'INITIAL_STATE' then 'INITIAL' else 'ACTIVE' end as context_status,
  case when transition_type = 'INITIAL_STATE' then 'ONBOARDING_SUPPORT' when current_state = 'NO_DATA' then 'DATA_COLLECTION_SUPPORT' else {_STRATEGY} end as strategy from hp)"""
_ACTIONS = _case("strategy", {k: "|".join(v) for k, v in cs.ACTIONS.items()}, "'PROVIDE_GENERAL_GUIDANCE'")
_DELTA = " union all ".join(f"select entity, window_start, '{n}' as dimension, coalesce({n}, 0.0) as c, lag(coalesce({n}, 0.0)) over (partition by entity order by window_start) as b from st" for n in cs.DIMENSIONS)
_PCT = "case when {1} > 0 then round(100.0::double * {0} / {1}, 2) else 0.0 end"



def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


SQL = {
    "d1_window_counts": BASE + f" select entity, d, {', '.join(cs.COUNTS)} from cn",
    "h1_spine": BASE + f" select entity, window_start, {', '.join(cs.COUNTS)}, has_data from w",
    "e1_percentile": PCT + f" select entity, window_start, {', '.join(f'round(p_{c}, 6) as p_{c}' for c in cs.COUNTS)} from p",
    "k1_state": STATE + f" select entity, window_start, {', '.join(cs.DIMENSIONS)}, overall_score, care_state, case when overall_score < 0.34 then 'LOW' when overall_score < 0.67 then 'MODERATE' else 'HIGH' end as level from st",
    "e2_transition": MOVE + " select entity, window_start, current_state, current_score, previous_state, previous_score, transition_type, score_delta, transition_direction, transition_magnitude from mv",
    "e3_last_observed": STATE + f""", ob as (select *, last_value(case when has_data then care_state end ignore nulls) over o as ps, last_value(case when has_data then window_start end ignore nulls) over o as pd
      from st window o as (partition by entity order by window_start rows between unbounded preceding and 1 preceding))
      select entity, window_start, care_state,
        case when not has_data then 'NO_DATA' when ps is null then 'INITIAL_STATE' when window_start - pd <> 1 then 'GAP' when ps = care_state then 'NO_CHANGE' else ps || '_TO_' || care_state end as transition,
        case when not has_data then 'NO_DATA' when ps is null then 'INITIAL' when window_start - pd <> 1 then 'UNKNOWN_DUE_TO_GAP' when ps = care_state then 'NO_CHANGE'
          when {_RANK.format('care_state')} > {_RANK.format('ps')} then 'INCREASING' else 'DECREASING' end as transition_direction from ob""",
    "e4_dim_delta": MOVE + f""", dl as ({_DELTA}) select dl.entity, dl.window_start, dimension, b as previous_score, c as current_score, round(c - b, 4) as delta,
      case when round(c - b, 4) > 0 then 'INCREASED' else 'DECREASED' end as direction, 'Δ' || format('{{:+.4f}}', round(c - b, 4)) as label
      from dl join mv on dl.entity = mv.entity and dl.window_start = mv.window_start where transition_type not in ('INITIAL_STATE', 'GAP') and abs(c - b) >= 0.1::double""",
    "k4_assistance": HELP + " select entity, window_start, previous_state, current_state, transition_type, transition_magnitude, transition_direction, assistance_mode, priority, reason_codes from hp",
    "k5_strategy": PLAN + " select entity, window_start, transition_type, context_status, assistance_mode, strategy from sg",
    "k6_actions": PLAN + f" select entity, window_start, strategy, {_ACTIONS} as actions, '{'|'.join(cs.SAFETY)}' || case when strategy = 'DATA_COLLECTION_SUPPORT' then '|{cs.GAP_SAFETY}' else '' end as safety_flags from sg",
    "k8_rule_check": HELP + f""", by_move(k, m) as (values {_values(cs.MOVE_MODE)}), by_state(k, m) as (values {_values(cs.STATE_MODE)}),
      ex as (select hp.*, coalesce(by_move.m, by_state.m, 'WAIT_FOR_DATA') as expected from hp left join by_move on by_move.k = transition_type left join by_state on by_state.k = current_state)
      select transition_type, count(*) as windows, count(*) filter (assistance_mode is distinct from expected) as mismatches from ex group by 1""",
    "c2_junction": HELP + """ select current_state as care_state, count(*) as windows, 0::bigint as missing_assistance, count(*) filter (overall_score is null) as missing_score,
      count(*) filter (entity not in (select entity from ev where event_type = 'purchase')) as missing_entity from hp group by 1""",
    "d2_dist": STATE + f" select care_state, count(*) as n, {_PCT.format('count(*)', 'sum(count(*)) over ()')} as pct from st group by 1",
    "d15_matrix": MOVE + f""", ce as (select previous_state, current_state, count(*) as n from mv where previous_state is not null group by all),
      bo as (select *, 'all' as scope from ce union all select *, 'active' from ce where previous_state <> 'NO_DATA' and current_state <> 'NO_DATA')
      select *, {_PCT.format('n', 'sum(n) over (partition by scope)')} as pct_total, {_PCT.format('n', 'sum(n) over (partition by scope, previous_state)')} as pct_row from bo""",
    "d16_crosstab": HELP + f""", ce as (select current_state, assistance_mode, priority, count(*) as n from hp group by all)
      select *, {_PCT.format('n', 'sum(n) over ()')} as pct_total, {_PCT.format('n', 'sum(n) over (partition by current_state)')} as pct_row from ce""",
    "d17_dominant": STATE + """, ce as (select entity, care_state, count(*) as n, min(window_start) as f from st group by all)
      select entity, care_state as dominant from ce qualify row_number() over (partition by entity order by n desc, f) = 1""",
    "d17_ever_seen": STATE + " select care_state, count(distinct entity) as entities from st group by 1",
    "d21_decision_moves": MOVE + f" select coalesce(previous_state, 'MISSING') || '->' || current_state as move, count(*) as n, {_PCT.format('count(*)', 'sum(count(*)) over ()')} as pct from mv group by 1",
    "d23_policies": HELP + f""" select transition_type, count(*) as windows, count(distinct assistance_mode) as modes, count(distinct {_BASE_MODE}) as state_modes,
      count(*) filter (assistance_mode <> {_BASE_MODE}) as driven_by_move, round(100.0::double * count(*) filter (assistance_mode <> {_BASE_MODE}) / count(*), 2) as driven_pct from hp group by 1""",
    "e5_runs": STATE + """, ru as (select entity, care_state, row_number() over (partition by entity order by window_start) - row_number() over (partition by entity, care_state order by window_start) as k from st),
      rn as (select care_state, count(*) as windows from ru group by entity, care_state, k)
      select care_state, count(*) as runs, max(windows) as longest, round(avg(windows), 4) as mean_windows from rn group by 1""",
    "h4_status": PLAN + " select context_status, count(*) as n from sg group by 1",
    "d14_rollup": STATE + " select coalesce(care_state, 'ALL') as care_state, count(*) as n, round(avg(overall_score), 6) as mean_score, max(total) as most_events from st where has_data group by rollup (care_state)",
    "m4_rules": validation.violations_sql(HELP + " select * from hp", validation.WINDOWS),
}
QUERIES = {name: globals()[name] for name in SQL}
