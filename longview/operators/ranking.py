"""Ranks, fusion of ranked lists and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group; the engine drops what can't rank before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def max_normalised(rows: DataFrame, group: str, score: str) -> DataFrame:
    most = F.max(score).over(Window.partitionBy(group))
    return rows.withColumn("norm", F.when(most > 0, F.col(score) / most).otherwise(F.lit(0.0)))


def fuse(dense: DataFrame, sparse: DataFrame, w_dense: float, w_sparse: float) -> DataFrame:
    """Both lists by (query_id, chunk_id) with normalised scores and their weighted sum, higher is better."""
    d = max_normalised(dense, "query_id", "score").select("query_id", "chunk_id", F.col("norm").alias("dense"))
    s = max_normalised(sparse, "query_id", "score").select("query_id", "chunk_id", F.col("norm").alias("sparse"))
    rows = d.join(s, ["query_id", "chunk_id"], "full_outer").fillna(0.0, ["dense", "sparse"])
    return rows.withColumn("hybrid", w_dense * F.col("dense") + w_sparse * F.col("sparse"))


def first_hits(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Each question with gold: how many gold rows, the first hit's rank (null if none) and its reciprocal."""
    hits = found.join(gold, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    rows = gold.groupBy("query_id").agg(F.count("*").alias("gold")).join(hits, "query_id", "left")
    return rows.withColumn("reciprocal", F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6))


def metrics(found: DataFrame, gold: DataFrame, ks: list[int], at: int = 5) -> DataFrame:
    """Hit rates and recall at ks, MRR, MAP, two forms of nDCG and precision, averaged over questions with gold."""
    hits = found.join(gold, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(
        F.min("rank").alias("r"), F.array_sort(F.collect_list("rank")).alias("ranks"), F.count_if(F.col("rank") <= at).alias("n_at"), F.sum(F.when(F.col("rank") <= at, 1.0 / (F.col("rank") + 1))).alias("gain"),
    )
    rows = gold.groupBy("query_id").agg(F.count("*").alias("gold")).join(hits, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.lit(at), F.col("gold"))), F.lit(0.0), lambda s, i: s + 1.0 / (i + 1))
    # the precision at each hit's rank; a question's found rows are few
    precision = F.aggregate(F.transform("ranks", lambda x, i: (i + 1) / x), F.lit(0.0), lambda s, x: s + x)
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return rows.agg(
        F.count("*").alias("questions"), *(mean((F.col("r") <= k).cast("double")).alias(f"recall_{k}") for k in ks), mean(1.0 / F.col("r")).alias("mrr"),
        mean(F.when(F.col("r") <= at, 1.0 / F.log2(F.col("r") + 1))).alias(f"ndcg_log2_{at}"), mean(F.col("gain") / ideal).alias(f"ndcg_harmonic_{at}"), mean(F.col("n_at") / float(at)).alias(f"precision_{at}"),
        *(mean(F.size(F.filter("ranks", lambda x: x <= k)) / F.col("gold")).alias(f"share_{k}") for k in ks), mean(precision / F.col("gold")).alias("map"),
    )


def source_accuracy(found: DataFrame, gold: DataFrame, sources: DataFrame) -> DataFrame:
    """The share of questions with gold whose first answer comes from a gold document's source, by trimmed
    lower-case name. sources: (chunk_id, source)."""
    names = sources.select("chunk_id", F.lower(F.trim("source")).alias("name"))
    right = gold.join(names, "chunk_id").select("query_id", "name").distinct()
    first = found.filter("rank = 1").join(names, "chunk_id").join(right, ["query_id", "name"], "left_semi").select("query_id", F.lit(1).alias("hit"))
    rows = gold.select("query_id").distinct().join(first, "query_id", "left")
    return rows.agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("source_accuracy"))
