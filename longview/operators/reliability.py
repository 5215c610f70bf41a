"""How reliable a question's evidence is, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp
from ..functions.text import terms

# fixed values: weights, thresholds, and recommendations that oppose each other
WEIGHTS = {"authority": 0.3, "relevance": 0.3, "support": 0.2, "coverage": 0.1, "consistency": 0.1}
THRESHOLDS = [(0.8, "ACCEPT"), (0.65, "REFINE"), (0.45, "RE-RETRIEVE")]
OPPOSED = [("recommended", "not recommended"), ("should", "should not"), ("must", "must not"), ("always", "never")]
SHARED = 2


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if set(weights) != set(WEIGHTS):
        raise ValueError("weights must name every dimension")
    if any(not 0 <= w <= 1 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must lie in [0, 1] and sum to 1")
    return weights


def check_thresholds(accept: float, refine: float, re_retrieve: float) -> None:
    if not 0 <= re_retrieve < refine < accept <= 1:
        raise ValueError("thresholds must rise from re-retrieve over refine to accept within [0, 1]")


def adapt(evidence: DataFrame) -> DataFrame:
    """Evidence with the names the score expects; similarity within [-1, 1]."""
    return evidence.withColumns({"source_document": F.col("source"), "authority_score": F.col("authority"), "similarity_score": clamp(F.col("cosine"), -1.0, 1.0)})


def opposition(left: Column, right: Column) -> Column:
    """Whether one text recommends what the other advises against, by the words alone."""
    a, b = F.lower(left), F.lower(right)
    out = F.lit(False)
    for yes, no in OPPOSED:
        for x, y in ((a, b), (b, a)):
            out = out | (F.contains(x, F.lit(yes)) & ~F.contains(x, F.lit(f"not {yes}")) & F.contains(y, F.lit(no)))
    return out


def conflicts(evidence: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Each pair of a question's items (a few per question), and whether the two conflict."""
    rows = evidence.select(*by, F.struct("rank", "chunk", F.array_distinct(terms(F.col("chunk"))).alias("t")).alias("x"))
    items = rows.groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("items"))

    def pair(x: Column, y: Column) -> Column:
        both = opposition(x["chunk"], y["chunk"]) & (F.size(F.array_intersect(x["t"], y["t"])) >= 3)
        return F.struct(x["rank"].alias("left_rank"), y["rank"].alias("right_rank"), both.alias("conflict"))

    after = lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: pair(x, y))
    return items.select(*by, F.inline(F.flatten(F.transform("items", after))))


def reliability(evidence: DataFrame, weights: dict[str, float] = WEIGHTS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(query_id, five dimensions, overall) of evidence (query_id, rank, question, chunk, authority, cosine); by names more
    keys where one question has several sets."""
    check_weights(weights)
    pairs = conflicts(evidence, by).groupBy(*by).agg(F.count_if("conflict").alias("c"), F.count("*").alias("p"))
    rows = evidence.withColumn("qt", F.array_distinct(terms(F.col("question")))).withColumn("hit", F.array_intersect("qt", F.array_distinct(terms(F.col("chunk")))))
    out = rows.groupBy(*by).agg(
        F.avg(clamp(F.col("authority"))).alias("a"), F.avg(clamp((F.col("cosine") + 1) / 2)).alias("r"), F.avg((F.size("hit") >= SHARED).cast("double")).alias("s"),
        F.max(F.size("qt")).alias("nq"), F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("nh"),
    ).join(pairs, list(by), "left")
    asked = F.col("nq") > 0
    out = out.select(
        *by, F.round("a", 6).alias("authority"), F.round("r", 6).alias("relevance"), F.round(F.when(asked, F.col("s")).otherwise(F.col("r")), 6).alias("support"),
        F.round(F.when(asked, F.col("nh") / F.col("nq")).otherwise(F.col("r")), 6).alias("coverage"), F.round(1.0 - F.coalesce(F.col("c") / F.col("p"), F.lit(0.0)), 6).alias("consistency"),
    )
    total = None
    for name, w in weights.items():
        total = F.lit(w) * F.col(name) if total is None else total + F.lit(w) * F.col(name)
    return out.withColumn("overall", F.round(total, 6))


def decision(score: Column) -> Column:
    out = F.lit("REJECT")
    for cut, name in reversed(THRESHOLDS):
        out = F.when(score >= cut, name).otherwise(out)
    return F.when(score.isNull(), "REJECT").otherwise(out)


def shares(question: Column, chunk: Column) -> Column:
    """Whether a text shares SHARED terms or more with the question."""
    return F.size(F.array_intersect(F.array_distinct(terms(question)), F.array_distinct(terms(chunk)))) >= SHARED


def refine(evidence: DataFrame) -> DataFrame:
    """Items that share SHARED terms or more with the question."""
    return evidence.filter(shares(F.col("question"), F.col("chunk")))
