"""The bounded gate: at most one refinement and one more retrieval, unrolled into columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reliability import decision, reliability, shares


def run(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each question's way through the gate.

    first and second are the evidence of two retrievals. Four scores are all it can need: of each set as it is and
    refined. REFINE keeps the items that share terms with the question (none left: refused) and judges again; a
    second REFINE generates. All four come from one pass over the evidence. RE-RETRIEVE goes to the second set once; REJECT, and RE-RETRIEVE for the second time,
    refuse.
    """
    names = {"first": ("s1", "r1"), "second": ("s2", "r2")}
    columns = ["query_id", "rank", "question", "chunk", "authority", "cosine"]
    sets = first.select(*columns, F.lit("first").alias("of")).unionByName(second.select(*columns, F.lit("second").alias("of")))
    whole, left = (F.when(F.col("of") == "first", names["first"][i]).otherwise(names["second"][i]) for i in (0, 1))
    sets = sets.withColumn("set", F.explode(F.when(shares(F.col("question"), F.col("chunk")), F.array(whole, left)).otherwise(F.array(whole))))
    scored = reliability(sets, by=("query_id", "set"))
    rows = scored.groupBy("query_id").agg(*(F.max(F.when(F.col("set") == c, F.col("overall"))).alias(c) for c in ("s1", "r1", "s2", "r2")))
    d = {c: decision(F.col(c)) for c in ("s1", "r1", "s2", "r2")}
    empty1, empty2 = F.col("r1").isNull(), F.col("r2").isNull()
    refined1 = d["s1"] == "REFINE"
    again = (d["s1"] == "RE-RETRIEVE") | (refined1 & ~empty1 & (d["r1"] == "RE-RETRIEVE"))
    after1 = F.when(refined1, F.when(empty1, F.lit("REFUSED")).otherwise(d["r1"])).otherwise(d["s1"])
    refined2 = again & ~refined1 & (d["s2"] == "REFINE")
    after2 = F.when(refined2, F.when(empty2, F.lit("REFUSED")).otherwise(d["r2"])).otherwise(d["s2"])
    final = F.when(again, after2).otherwise(after1)
    refused = final.isin("REFUSED", "REJECT", "RE-RETRIEVE")
    why = F.when(final == "REFUSED", "REFINE_EMPTY").when(final == "REJECT", "REJECTED").when(final == "RE-RETRIEVE", "RETRIEVAL_BUDGET")
    return rows.select(
        "query_id", d["s1"].alias("first_decision"), final.alias("final_decision"), F.when(again, 2).otherwise(1).alias("retrievals"),
        F.when(refined1 | refined2, 1).otherwise(0).alias("refinements"), refused.alias("refused"), F.coalesce(why, F.lit("")).alias("why"),
    )
