"""Per-entity summaries of a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import days_between, per_year


def ordered_distinct(value, order) -> object:
    """Distinct values in the order they first appear, without blanks."""
    kept = F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.struct(order.alias("o"), value.alias("v")))
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["v"]))


def distinct_list(events: DataFrame) -> DataFrame:
    """Each entity's kinds in order of first appearance; pairs are reduced before the lists are made."""
    first = events.groupBy("entity", "kind").agg(F.min("seq").alias("seq"))
    return first.groupBy("entity").agg(F.array_join(ordered_distinct(F.col("kind"), F.col("seq")), "|").alias("kinds"))


def code_summary(events: DataFrame) -> DataFrame:
    """Per entity and code: how often, and the latest event's date and value."""
    last = F.max_by(F.struct("d", "value"), F.struct(F.col("d").isNull(), "d", "seq"))
    return events.groupBy("entity", "code").agg(F.count("*").alias("n"), last.alias("l"), F.countDistinct("kind").alias("kinds")).select("entity", "code", "n", "kinds", F.col("l.d").alias("last_date"), F.col("l.value").alias("last_value"))


def profile(events: DataFrame) -> DataFrame:
    """First and last date, span, counts, rate and number of codes of each entity."""
    base = events.groupBy("entity").agg(
        F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count("*").alias("events"), F.count("d").alias("dated"),
        F.countDistinct("code").alias("codes"), F.count_if(F.col("kind") == "purchase").alias("purchases"), F.countDistinct("kind").alias("kinds"),
    )
    span = days_between(F.col("first_date"), F.col("last_date"))
    return base.withColumns({"span_days": span, "per_year": per_year(F.col("events"), span)})


def trailing(events: DataFrame, days: int) -> DataFrame:
    """Events by kind in the last days up to each entity's own last event, that day included."""
    last = F.max("d").over(Window.partitionBy("entity"))
    recent = events.select("entity", "kind", "d", last.alias("last")).filter(F.col("d") >= F.date_sub("last", days))
    return recent.groupBy("entity").agg(F.count("*").alias("recent"), *(F.count_if(F.col("kind") == k).alias(f"recent_{k}") for k in ("view", "click", "error", "purchase", "signup")))


def numeric_stats(events: DataFrame, by: str) -> DataFrame:
    return events.groupBy(by).agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"),
        F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"),
    )
