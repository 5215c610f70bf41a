"""Windows, population-relative scores, states, transitions and the rules that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp, weighted, window_state

# fixed values: which event kind stands for which resource
KINDS = {"observation": "view", "encounter": "click", "condition": "error", "medication_request": "purchase", "immunization": "signup"}
#: Resources with no event kind here count 0 in every window.
ABSENT = ("medication_administration", "procedure", "report", "care_plan")
COUNTS = ("medication", *KINDS, *ABSENT, "total")

# fixed values: weights of percentile features in each dimension, and of dimensions in the overall score
DIMENSIONS = {
    "medication_burden": {"medication": 0.45, "medication_request": 0.35, "medication_administration": 0.20},
    "clinical_activity": {"total": 0.30, "encounter": 0.25, "procedure": 0.25, "report": 0.20},
    "observation_intensity": {"observation": 1.0},
    "encounter_intensity": {"encounter": 1.0},
    "condition_burden": {"condition": 1.0},
    "recent_activity": {"total": 0.40, "encounter": 0.25, "observation": 0.20, "medication": 0.15},
    "care_complexity": {"condition": 0.20, "medication": 0.20, "encounter": 0.15, "observation": 0.15, "procedure": 0.15, "report": 0.15},
    "preventive_care": {"immunization": 0.60, "care_plan": 0.40},
}
OVERALL = {
    "medication_burden": 0.12, "clinical_activity": 0.18, "observation_intensity": 0.12, "encounter_intensity": 0.12,
    "condition_burden": 0.10, "recent_activity": 0.18, "care_complexity": 0.13, "preventive_care": 0.05,
}
ORDER = {"STABLE": 0, "LOW_ACTIVITY": 1, "MODERATE_ACTIVITY": 2, "HIGH_ACTIVITY": 3}
CHANGE = 0.1


def window_counts(events: DataFrame) -> DataFrame:
    """Per entity and day: a count for each resource, their total, and medication as requests and administrations."""
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(name) for name, k in KINDS.items()]
    absent = [F.lit(0).cast("long").alias(name) for name in ABSENT]
    rows = events.groupBy("entity", "d").agg(*counts, F.count("*").alias("total")).select("*", *absent)
    return rows.withColumn("medication", F.col("medication_request") + F.col("medication_administration"))


def spine(events: DataFrame) -> DataFrame:
    """Every day from an entity's first event to its last, with its counts (0 where there are none) and has_data."""
    counts = window_counts(events)
    days = counts.groupBy("entity").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = days.select("entity", F.explode(F.sequence("lo", "hi")).alias("window_start")).withColumn("d", F.col("window_start"))
    rows = days.join(counts, ["entity", "d"], "left")
    return rows.select("entity", "window_start", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS), F.col("total").isNotNull().alias("has_data"))


def _ranked(rows: DataFrame, keys: list[str], features: list[str], rank, constant: tuple[str, ...] | list[str]) -> DataFrame:
    """rows' keys with p_<feature>, rank of (number of values up to one's own, number of rows).

    A histogram of each feature's values with a running sum stands in for sorting the population, so no
    partition holds more than a feature's distinct values. Features that have one value for all rows need no join.
    """
    pairs = ", ".join(f"'{f}', cast({f} as double)" for f in features)
    long = rows.selectExpr(*keys, f"stack({len(features)}, {pairs}) as (feature, v)")
    hist = long.groupBy("feature", "v").agg(F.count("*").alias("n"))
    by = Window.partitionBy("feature")
    total, upto = F.sum("n").over(by), F.sum("n").over(by.orderBy("v"))
    ranked = hist.select("feature", "v", rank(upto, total).alias("p"), rank(total, total).alias("all"))
    wide = [F.max(F.when(F.col("feature") == f, F.col("p"))).alias(f"p_{f}") for f in features]
    return long.join(ranked, ["feature", "v"]).groupBy(*keys).agg(*wide, *(F.max("all").alias(f"p_{f}") for f in constant))


def percentile_ranks(rows: DataFrame, keys: list[str], features: list[str], constant: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """rows' keys with p_<feature>: (number of values up to one's own - 1) / (n - 1), 0 where n is 1; constant names
    features that have one value for all rows."""
    return _ranked(rows, keys, features, lambda upto, n: F.when(n > 1, (upto - 1).cast("double") / (n - 1)).otherwise(F.lit(0.0)), constant)


def percentile_points(rows: DataFrame, keys: list[str], features: list[str], constant: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The same ranks in whole ten-thousandths, rounded half up."""
    return _ranked(rows, keys, features, lambda upto, n: F.when(n > 1, F.floor(((upto - 1) * 20000 + n - 1) / (2 * (n - 1)))).otherwise(0).cast("long"), constant)


def scored(windows: DataFrame) -> DataFrame:
    """Windows with the eight dimensions, overall score and state; NO_DATA and null scores where nothing is documented."""
    keys = ["entity", "window_start"]
    active = windows.filter("has_data")
    ranks = percentile_ranks(active, keys, [c for c in COUNTS if c not in ABSENT], ABSENT)
    dims = ranks.select(*keys, *(F.round(clamp(_sum(parts)), 4).alias(name) for name, parts in DIMENSIONS.items()))
    dims = dims.withColumn("overall_score", weighted(OVERALL))
    out = windows.join(dims, keys, "left")
    return out.withColumn("care_state", F.when(F.col("has_data"), window_state(F.col("overall_score"))).otherwise("NO_DATA"))


def _sum(parts: dict[str, float]) -> Column:
    total = None
    for name, w in parts.items():
        term = F.col(f"p_{name}") * F.lit(w)
        total = term if total is None else total + term
    return total


def _rank(state: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, k in ORDER.items():
        out = F.when(state == name, k).otherwise(out)
    return out


def transitions(states: DataFrame, dimensions: bool = True) -> DataFrame:
    """Each window against the one before it: type, magnitude, direction and the dimensions that changed.

    A window without data has score 0 here, and a gap on either side blocks the comparison.
    """
    w = Window.partitionBy("entity").orderBy("window_start")
    names = list(DIMENSIONS)
    now = F.array(*(F.coalesce(F.col(n), F.lit(0.0)) for n in names))
    rows = states.select("entity", "window_start", F.col("care_state").alias("current_state"), F.coalesce("overall_score", F.lit(0.0)).alias("current_score"), now.alias("now"))
    rows = rows.withColumns({
        "previous_state": F.lag("current_state").over(w), "previous_score": F.lag("current_score").over(w), "before": F.lag("now").over(w),
    })
    first, gap = F.col("previous_state").isNull(), (F.col("previous_state") == "NO_DATA") | (F.col("current_state") == "NO_DATA")
    raw = F.col("current_score") - F.col("previous_score")
    up = _rank(F.col("current_state")) > _rank(F.col("previous_state"))
    kind = (
        F.when(first, "INITIAL_STATE").when(gap, "GAP")
        .when((F.col("current_state") != F.col("previous_state")) & up, "STATE_ESCALATION")
        .when(F.col("current_state") != F.col("previous_state"), "STATE_DEESCALATION")
        .when(raw >= CHANGE, "INCREASING_ACTIVITY").when(raw <= -CHANGE, "DECREASING_ACTIVITY").otherwise("NO_CHANGE")
    )
    rows = rows.withColumn("transition_type", kind).withColumn("score_delta", F.round(raw, 4))
    kind = F.col("transition_type")
    direction = (
        F.when(kind == "INITIAL_STATE", "INITIAL").when(kind == "GAP", "UNKNOWN").when(kind == "STATE_ESCALATION", "INCREASING")
        .when(kind == "STATE_DEESCALATION", "DECREASING").when(raw > CHANGE, "INCREASING").when(raw < -CHANGE, "DECREASING").otherwise("UNCHANGED")
    )
    size = F.abs(raw)
    magnitude = F.when(kind.isin("INITIAL_STATE", "GAP"), None).when(size < 0.1, "MINOR").when(size < 0.25, "MODERATE").otherwise("LARGE")
    changed = F.filter(
        F.zip_with(F.zip_with(F.array(*map(F.lit, names)), "before", lambda n, b: F.struct(n.alias("dimension"), b.alias("previous_score"))), "now",
                   lambda p, c: F.struct(p["dimension"].alias("dimension"), p["previous_score"].alias("previous_score"), c.alias("current_score"), F.round(c - p["previous_score"], 4).alias("delta"))),
        lambda x: F.abs(x["current_score"] - x["previous_score"]) >= CHANGE,
    )
    rows = rows.withColumns({"transition_direction": direction, "transition_magnitude": magnitude})
    if dimensions:
        rows = rows.withColumn("changed_dimensions", F.when(kind.isin("INITIAL_STATE", "GAP"), F.slice(changed, 1, 0)).otherwise(changed))
    return rows.drop("now", "before")


# fixed values: assistance by state, and by transition where that decides
STATE_MODE = {"NO_DATA": "WAIT_FOR_DATA", "STABLE": "MAINTENANCE_SUPPORT", "LOW_ACTIVITY": "LIGHT_SUPPORT", "MODERATE_ACTIVITY": "CONTEXTUAL_SUPPORT", "HIGH_ACTIVITY": "ENHANCED_SUPPORT"}
STATE_PRIORITY = {"NO_DATA": "LOW", "STABLE": "LOW", "LOW_ACTIVITY": "LOW", "MODERATE_ACTIVITY": "MODERATE", "HIGH_ACTIVITY": "HIGH"}
MOVE_MODE = {"INITIAL_STATE": "INITIAL_CONTEXT", "GAP": "WAIT_FOR_DATA", "STATE_ESCALATION": "ADAPTIVE_ESCALATION", "STATE_DEESCALATION": "ADAPTIVE_DEESCALATION", "INCREASING_ACTIVITY": "MONITORING_SUPPORT", "DECREASING_ACTIVITY": "FOLLOW_UP_SUPPORT"}
REASONS = {
    "GAP": "NO_DATA_OR_TEMPORAL_GAP", "INITIAL_STATE": "INITIAL_CARE_STATE", "STATE_ESCALATION": "STATE_ESCALATION|INCREASED_CARE_ACTIVITY",
    "STATE_DEESCALATION": "STATE_DEESCALATION|DECREASED_CARE_ACTIVITY", "INCREASING_ACTIVITY": "INCREASING_ACTIVITY",
    "DECREASING_ACTIVITY": "DECREASING_ACTIVITY", "NO_CHANGE": "NO_MAJOR_STATE_CHANGE",
}
MOVE_STRATEGY = {"INITIAL_STATE": "ONBOARDING_SUPPORT", "GAP": "DATA_COLLECTION_SUPPORT", "STATE_ESCALATION": "ENHANCED_CONTEXT_SUPPORT", "STATE_DEESCALATION": "ADAPTIVE_DEESCALATION_SUPPORT", "INCREASING_ACTIVITY": "MONITORING_SUPPORT", "DECREASING_ACTIVITY": "FOLLOW_UP_SUPPORT"}
MODE_STRATEGY = {"LIGHT_SUPPORT": "LIGHT_SUPPORT", "CONTEXTUAL_SUPPORT": "CONTEXTUAL_SUPPORT", "ENHANCED_SUPPORT": "ENHANCED_SUPPORT"}
ACTIONS = {
    "DATA_COLLECTION_SUPPORT": ["REQUEST_CHECK_IN", "REQUEST_DATA_UPDATE", "AVOID_STRONG_PERSONALIZATION"],
    "ONBOARDING_SUPPORT": ["ESTABLISH_INITIAL_CONTEXT", "REQUEST_CHECK_IN", "PROVIDE_GENERAL_GUIDANCE"],
    "MONITORING_SUPPORT": ["CONTINUE_MONITORING", "REVIEW_RECENT_CARE_CONTEXT", "ENCOURAGE_FUTURE_CHECK_IN"],
    "FOLLOW_UP_SUPPORT": ["REVIEW_RECENT_CARE_CONTEXT", "ENCOURAGE_APPROPRIATE_FOLLOW_UP", "ENCOURAGE_FUTURE_CHECK_IN"],
    "ENHANCED_CONTEXT_SUPPORT": ["PROVIDE_TARGETED_INFORMATION", "REVIEW_RECENT_CARE_CONTEXT", "REQUEST_CHECK_IN", "ENCOURAGE_APPROPRIATE_FOLLOW_UP"],
    "ADAPTIVE_DEESCALATION_SUPPORT": ["REDUCE_INTERVENTION_INTENSITY", "PROVIDE_GENERAL_GUIDANCE", "CONTINUE_MONITORING"],
    "LIGHT_SUPPORT": ["PROVIDE_GENERAL_GUIDANCE", "ENCOURAGE_FUTURE_CHECK_IN"],
    "CONTEXTUAL_SUPPORT": ["PROVIDE_CONTEXTUAL_INFORMATION", "ENCOURAGE_FUTURE_CHECK_IN"],
    "ENHANCED_SUPPORT": ["PROVIDE_TARGETED_INFORMATION", "REVIEW_RECENT_CARE_CONTEXT", "CONTINUE_MONITORING"],
}
SAFETY = ["NO_DIAGNOSIS", "NO_MEDICAL_RISK_PREDICTION", "NO_DISEASE_PROGRESSION_INFERENCE", "DOCUMENTED_ACTIVITY_ONLY"]
GAP_SAFETY = "NO_DATA_IS_NOT_STABILITY"


def choose(key: Column, table: dict[str, str], other: Column | str | None = None) -> Column:
    """A rule table as an expression, so that no join is needed."""
    out = other if isinstance(other, Column) else F.lit(other)
    for name, value in reversed(table.items()):
        out = F.when(key == name, value).otherwise(out)
    return out


def assistance(moves: DataFrame) -> DataFrame:
    """Adds assistance_mode, priority and reason_codes (joined by |) to transitions."""
    kind, state = F.col("transition_type"), F.col("current_state")
    base_mode, base = choose(state, STATE_MODE, "WAIT_FOR_DATA"), choose(state, STATE_PRIORITY, "LOW")
    raised = F.when(base == "HIGH", "HIGH").otherwise("MODERATE")
    priority = F.when(kind == "GAP", "LOW").when(kind == "STATE_ESCALATION", "HIGH").when(kind == "STATE_DEESCALATION", "MODERATE").when(kind.isin("INCREASING_ACTIVITY", "DECREASING_ACTIVITY"), raised).otherwise(base)
    return moves.withColumns({"assistance_mode": choose(kind, MOVE_MODE, base_mode), "priority": priority, "reason_codes": choose(kind, REASONS, "DEFAULT_RULE")})


def strategies(helped: DataFrame) -> DataFrame:
    """Adds context_status and strategy: first window, then gap, then the move, then the mode's own."""
    kind, state = F.col("transition_type"), F.col("current_state")
    status = F.when(state == "NO_DATA", "DATA_GAP").when(kind == "INITIAL_STATE", "INITIAL").otherwise("ACTIVE")
    strategy = F.when(kind == "INITIAL_STATE", "ONBOARDING_SUPPORT").when(state == "NO_DATA", "DATA_COLLECTION_SUPPORT").otherwise(choose(kind, MOVE_STRATEGY, choose(F.col("assistance_mode"), MODE_STRATEGY, "CONTEXTUAL_SUPPORT")))
    return helped.withColumns({"context_status": status, "strategy": strategy})


def plans(chosen: DataFrame) -> DataFrame:
    """Adds the strategy's ordered actions and the safety flags, each joined by |."""
    actions = choose(F.col("strategy"), {k: "|".join(v) for k, v in ACTIONS.items()}, "PROVIDE_GENERAL_GUIDANCE")
    flags = F.array_union(F.array(*map(F.lit, SAFETY)), F.when(F.col("strategy") == "DATA_COLLECTION_SUPPORT", F.array(F.lit(GAP_SAFETY))).otherwise(F.array().cast("array<string>")))
    return chosen.withColumns({"actions": actions, "safety_flags": F.array_join(flags, "|")})


def observed_transitions(states: DataFrame) -> DataFrame:
    """Each window against the last one with data: a gap of more than one window blocks the comparison."""
    w = Window.partitionBy("entity").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("has_data"), F.struct("window_start", "care_state")), ignorenulls=True).over(w)
    rows = states.withColumn("seen", seen)
    prev, cur = F.col("seen.care_state"), F.col("care_state")
    adjacent = F.datediff("window_start", F.col("seen.window_start")) == 1
    move = F.when(~F.col("has_data"), "NO_DATA").when(F.col("seen").isNull(), "INITIAL_STATE").when(~adjacent, "GAP").when(prev == cur, "NO_CHANGE").otherwise(F.concat(prev, F.lit("_TO_"), cur))
    way = (
        F.when(~F.col("has_data"), "NO_DATA").when(F.col("seen").isNull(), "INITIAL").when(~adjacent, "UNKNOWN_DUE_TO_GAP").when(prev == cur, "NO_CHANGE")
        .when(_rank(cur) > _rank(prev), "INCREASING").otherwise("DECREASING")
    )
    return rows.select("entity", "window_start", "care_state", move.alias("transition"), way.alias("transition_direction"))


def run_lengths(states: DataFrame) -> DataFrame:
    """Consecutive windows of one state: (entity, care_state, start, windows)."""
    e, s = Window.partitionBy("entity").orderBy("window_start"), Window.partitionBy("entity", "care_state").orderBy("window_start")
    island = F.row_number().over(e) - F.row_number().over(s)
    return states.withColumn("island", island).groupBy("entity", "care_state", "island").agg(F.min("window_start").alias("start"), F.count("*").alias("windows")).drop("island")


def dominant_state(states: DataFrame) -> DataFrame:
    """Each entity's most frequent state; ties go to the one met first."""
    counts = states.groupBy("entity", "care_state").agg(F.count("*").alias("windows"), F.min("window_start").alias("first"))
    return counts.groupBy("entity").agg(F.max_by("care_state", F.struct("windows", -F.datediff("first", F.lit("1970-01-01").cast("date")))).alias("dominant"))


def entity_state(overall: Column, recent: Column, complexity: Column) -> Column:
    """The state of an entity as a whole: recent activity weighs most."""
    high, moderate = 0.67, 0.34
    return (
        F.when((recent >= high) & (overall >= high), "HIGH_ACTIVITY")
        .when((recent >= high) | (overall >= high), "HIGH_ACTIVITY")
        .when((recent >= moderate) | (overall >= moderate), "MODERATE_ACTIVITY")
        .when(complexity < moderate, "STABLE").otherwise("LOW_ACTIVITY")
    )


# fixed values: states of the real-time score, from little to much
REALTIME = ["STABLE", "LOW_ACTIVITY", "MODERATE_ACTIVITY", "HIGH_ACTIVITY"]


def realtime_move(previous: Column, current: Column, previous_score: Column, score: Column) -> dict[str, Column]:
    """Type, direction and size of the move between two real-time states; without an earlier state it is INITIAL.
    A missing score counts 0, and NO_DATA lies below all states."""
    level = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, REALTIME)), c), F.lit(0))
    up = F.when(previous.isNotNull() & (previous != "") & (previous != "NO_DATA"), level(current) - level(previous))
    delta = F.coalesce(score, F.lit(0.0)) - F.coalesce(previous_score, F.lit(0.0))
    pick = lambda none, same, more, less: F.when(up.isNull(), none).when(up == 0, same).when(up > 0, more).otherwise(less)
    return {
        "type": pick("INITIAL", "CONTINUATION", "ESCALATION", "DE_ESCALATION"), "direction": pick("NONE", "STABLE", "UP", "DOWN"),
        "magnitude": F.when(up != 0, F.round(F.abs(delta) * 10, 4)).otherwise(F.lit(0.0)), "score_delta": F.round(delta, 4),
    }
