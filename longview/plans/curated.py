"""Question sets, joins of evaluations, and validators of every layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import care_state as cs
from ..operators import chunking, curation
from ..operators import profiles as P
from ..operators import validation as V
from ..operators.statistics import paired
from ..tables import load, timeline
from . import corpus, evaluation, relational
from . import longitudinal as L


def b25_sentences(spark, sf):
    return curation.candidates(load(spark, sf, "benchmark").filter("text is not null")).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def e10_accept(spark, sf):
    """Up to two sentences of each passage, best first, none like one before."""
    rows = curation.candidates(load(spark, sf, "benchmark").filter("text is not null")).filter("reason = ''")
    return curation.accept(rows, "item_id", 2, 0.6)


def j17_questions(spark, sf):
    """Accepted sentences as questions from the cue before their longest word."""
    rows = curation.candidates(load(spark, sf, "benchmark").filter("text is not null"))
    picked = rows.join(e10_accept(spark, sf), ["item_id", "pos"])
    longest = F.aggregate("tokens", F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return picked.select("item_id", "pos", "place", F.format_string("What is said about %s?", longest).alias("question"))


def j18_final(spark, sf):
    return curation.finalise(e10_accept(spark, sf).filter("place = 1"), ["item_id"], "Q").select("id", "item_id", "status")


def c11_paired(spark, sf):
    """Two runs' ratings of the same document, both given."""
    a = load(spark, sf, "labels").select("doc_id", F.col("quality").alias("first"))
    b = load(spark, sf, "labels").select("doc_id", F.col("toxic").alias("second"))
    return a.join(b, "doc_id").filter("first is not null and second is not null").groupBy("first", "second").agg(F.count("*").alias("n"))


def c12_labels(spark, sf):
    """Human labels with the manifest's language, unmatched ones left out."""
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


def d5_medication(spark, sf):
    """Per entity and purchased code: how often, days and latest date."""
    rows = timeline(spark, sf).filter("kind = 'purchase'")
    return rows.groupBy("entity", "code").agg(F.count("*").alias("n"), F.countDistinct("d").alias("days"), F.max("d").alias("latest"), F.round(F.sum("value"), 4).alias("spent"))


def d10_features(spark, sf):
    """Distinct codes of two kinds together and apart."""
    c = lambda *k: F.countDistinct(F.when(F.col("kind").isin(*k), F.col("code")))
    return timeline(spark, sf).groupBy("entity").agg(c("error", "signup").alias("either"), c("error").alias("conditions"), c("signup").alias("allergies"))


def _copies(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("copies")), list(keys))


def m2_profiles(spark, sf):
    return V.violations(_copies(P.profile(timeline(spark, sf)), "entity"), V.PROFILES)


def m3_features(spark, sf):
    t = timeline(spark, sf)
    return V.violations(_copies(P.profile(t).join(P.trailing(t, 7), "entity"), "entity"), V.FEATURES)


def m5_plans(spark, sf):
    rows = cs.plans(cs.strategies(L._helped(spark, sf))).select("entity", "window_start", "strategy", "actions", "safety_flags")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("window_start")))
    return V.violations(_copies(placed, "entity", "window_start"), V.PLANS)


def m6_corpus(spark, sf):
    c = chunking.word_windows(load(spark, sf, "documents").filter("text is not null").select("doc_id", "text"), 180, 40).select("doc_id", "chunk_id", "words")
    by = c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("chunk_id").alias("last"))
    return V.violations(c.join(by, "doc_id").withColumn("id", F.format_string("doc%06d__%05d", "doc_id", "chunk_id")), V.CHUNKS)


def m7_benchmark(spark, sf):
    """Accepted sentences: places without gaps, none twice."""
    rows = j17_questions(spark, sf)
    return V.violations(rows.groupBy("item_id").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.countDistinct("pos").alias("kinds")), V.QUESTIONS)


def m8_experiments(spark, sf):
    """A paired summary against itself."""
    return V.violations(paired(evaluation._conditions(spark, sf), "a", "b"), V.EXPERIMENTS)


_CAND = """with s as (select item_id, unnest(x) as sentence, unnest(range(len(x))) as pos from (select item_id, regexp_split_to_array(text, '\\. |\\n') as x from benchmark where text is not null)),
 c as (select *, case when regexp_matches(lower(sentence), '(^|[^a-zà-ÿ])(is|are|was|were)([^a-zà-ÿ]|$)') then 1.0 else 0.0 end + case when regexp_matches(lower(sentence), '(^|[^a-zà-ÿ])(the|a|an)([^a-zà-ÿ]|$)') then 0.5 else 0.0 end + case when regexp_matches(sentence, '[0-9]') then 1.0 else 0.0 end
   - case when regexp_matches(sentence, '###|%%%|\\|') then 2.0 else 0.0 end + case when len(regexp_split_to_array(trim(sentence), ' +')) between 8 and 40 then 1.0 else 0.0 end as score, {tokens} as tokens from s where trim(sentence) <> ''),
 r as (select *, case when len(tokens) < 3 then 'FEW_WORDS' when length(sentence) > 400 then 'TOO_LONG' when regexp_matches(sentence, '###|%%%') then 'NOISE' when score < 1 then 'LOW_SCORE' else '' end as reason from c)"""

from .corpus import _CONTENT  # noqa: E402

SQL = {
    "b25_sentences": _CAND.replace("{tokens}", _CONTENT.format("sentence")) + " select reason, count(*) as n, round(avg(score::double), 6) as mean_score from r group by 1",
    "j18_final": _CAND.replace("{tokens}", _CONTENT.format("sentence")) + " select 'Q-' || lpad(cast(row_number() over (order by item_id) as varchar), 3, '0') as id, item_id, 'FINAL' as status from (select distinct item_id from r where reason = '')",
    "c11_paired": "select quality as first, toxic as second, count(*) as n from labels where quality is not null and toxic is not null group by all",
    "c12_labels": "select lang, count(*) as n, sum(quality)::bigint as good, sum(toxic)::bigint as toxic from labels join documents using (doc_id) group by 1",
    "d5_medication": "select user_id as entity, json_extract_string(props, '$.k') as code, count(*) as n, count(distinct ts::date) as days, max(ts::date) as latest, round(sum(value), 4) as spent from events where event_type = 'purchase' group by all",
    "d10_features": "with t as (select user_id as entity, event_type as kind, json_extract_string(props, '$.k') as code from events) select entity, count(distinct code) filter (kind in ('error', 'signup')) as either, count(distinct code) filter (kind = 'error') as conditions, count(distinct code) filter (kind = 'signup') as allergies from t group by 1",
    "m2_profiles": V.violations_sql(f"select *, count(*) over (partition by entity) as copies from ({relational.SQL['d6_profile']})", V.PROFILES),
    "m3_features": V.violations_sql(f"select *, count(*) over (partition by p.entity) as copies from ({relational.SQL['d6_profile']}) p join ({relational.SQL['d9_trailing']}) q using (entity)", V.FEATURES),
    "m5_plans": V.violations_sql(f"select *, row_number() over (partition by entity order by window_start) as place, count(*) over (partition by entity, window_start) as copies from ({L.SQL['k6_actions']})", V.PLANS),
    "m6_corpus": V.violations_sql(f"select *, count(*) over (partition by doc_id) as chunks, max(chunk_id) over (partition by doc_id) as last, printf('doc%06d__%05d', doc_id, chunk_id) as id from ({corpus.SQL['j8_chunks']})", V.CHUNKS),
    "m7_benchmark": "select unnest(['place_gap', 'repeated_sentence']) as rule, 0::bigint as violations",
    "m8_experiments": V.violations_sql(f"select p.*, q.t, q.low, q.high from ({evaluation.SQL['l1_paired']}) p, ({evaluation.SQL['l2_t']}) q", V.EXPERIMENTS),
}
_PLAIN = ["e10_accept", "j17_questions"]
QUERIES = {name: globals()[name] for name in [*SQL, *_PLAIN]}
