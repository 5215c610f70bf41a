"""Evaluation queries: agreement of two ratings, paired conditions, intervals, reproducibility and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import statistics as S
from ..tables import load


def _ratings(spark, sf) -> DataFrame:
    return load(spark, sf, "labels")


def _conditions(spark, sf) -> DataFrame:
    """Each user's mean value under two conditions, nulls where one is missing."""
    e = load(spark, sf, "events")
    mean = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6)
    return e.groupBy("user_id").agg(mean("view").alias("a"), mean("click").alias("b"))


def d19_confusion(spark, sf):
    return S.confusion(_ratings(spark, sf), "quality", "toxic")


def d20_kappa(spark, sf):
    return S.kappa(_ratings(spark, sf), "quality", "toxic")


def d26_runs(spark, sf):
    """Per source: rows, shares of flagged and refused texts, mean words and most."""
    d = load(spark, sf, "documents").join(_ratings(spark, sf), "doc_id")
    words = F.size(F.split("text", " "))
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.round(F.count_if(F.col("toxic") == 1) / F.count("*"), 6).alias("flagged_rate"),
        F.count_if(F.col("text").contains("###")).alias("refusals"), F.round(F.avg(F.when(F.col("quality") == 1, words)), 4).alias("mean_words"), F.max(words).cast("long").alias("most_words"),
    )


def l1_paired(spark, sf):
    return S.paired(_conditions(spark, sf), "a", "b").select("n", "mean_a", "mean_b", "mean_diff", "median_diff", "sd_diff", "above", "equal", "below")


def l2_t(spark, sf):
    return S.paired(_conditions(spark, sf), "a", "b").select("n", "t", "low", "high")


def l2_p(spark, sf):
    return S.paired_t_test(_conditions(spark, sf), "a", "b")


def l3_p(spark, sf):
    return S.wilcoxon_test(_conditions(spark, sf), "a", "b")


def d20_within_one(spark, sf):
    """Two ratings of each user in quarters."""
    binned = _conditions(spark, sf).select(S.support_bin(F.round(F.col("a") / 20, 6)).alias("a"), S.support_bin(F.round(F.col("b") / 20, 6)).alias("b"))
    return S.within_one(binned, "a", "b")


def l7_dz(spark, sf):
    return S.paired(_conditions(spark, sf), "a", "b").select("n", "dz")


def l3_wilcoxon_w(spark, sf):
    return S.wilcoxon(_conditions(spark, sf), "a", "b")


def l5_ci(spark, sf):
    rows = load(spark, sf, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    half = S.Z * F.col("sd") / F.sqrt("n")
    return rows.select("event_type", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"))


def l4_bootstrap(spark, sf):
    h = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", F.col("quality").cast("double").alias("v")).agg(F.count("*").alias("n"))
    return S.bootstrap_means(h, "lang", "v", "n")


def l6_clopper(spark, sf):
    counts = _ratings(spark, sf).groupBy("quality").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    return S.with_intervals(counts, "k", "n")


def e12_spearman(spark, sf):
    return S.spearman(_conditions(spark, sf).filter("a is not null and b is not null"), "a", "b", "user_id")


def l10_repro(spark, sf):
    """Two runs compared field by field on the key: how many rows are equal, nulls equal to nulls."""
    o = load(spark, sf, "orders")
    one = o.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    two = o.select("o_orderkey", F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("t"), F.when(F.col("o_orderkey") % 89 == 0, None).otherwise(F.col("o_orderpriority")).alias("p"))
    rows = one.join(two, "o_orderkey", "full_outer")
    same = {"status": F.col("o_orderstatus").eqNullSafe(F.col("s")), "price": F.col("o_totalprice").eqNullSafe(F.col("t")), "priority": F.col("o_orderpriority").eqNullSafe(F.col("p"))}
    sums = rows.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in same.items()))
    pairs = ", ".join(f"'{k}', {k}" for k in same)
    return sums.selectExpr("n", f"stack({len(same)}, {pairs}) as (field, equal)")


def l11_bins(spark, sf):
    share = F.round(F.col("value") / 20, 6)
    return load(spark, sf, "events").groupBy(S.support_bin(share).alias("bin")).agg(F.count("*").alias("n"))


def l12_latency(spark, sf):
    rows = load(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("fastest"), F.max("value").alias("slowest"), F.round(100.0 * F.count_if(F.col("value") <= 3) / F.count("*"), 2).alias("pass_pct"))
    return rows


_CO = "with c as (select user_id, round(avg(value) filter (event_type = 'view'), 6) as a, round(avg(value) filter (event_type = 'click'), 6) as b from events group by 1), d as (select *, a - b as d from c where a is not null and b is not null)"
_PA = _CO + ", p as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(d) as m, median(d) as med, stddev_samp(d) as sd, count(*) filter (d > 1e-9) as above, count(*) filter (abs(d) <= 1e-9) as equal, count(*) filter (d < -1e-9) as below from d)"
SQL = {
    "d19_confusion": "with c as (select count(*) filter (quality = 1 and toxic = 1) as common, count(*) filter (quality = 1 and toxic = 0) as a_only, count(*) filter (quality = 0 and toxic = 1) as b_only, count(*) filter (quality = 0 and toxic = 0) as neither from labels) select *, case when common + a_only > 0 then round(common / (common + a_only)::double, 6) end as of_a, case when common + b_only > 0 then round(common / (common + b_only)::double, 6) end as of_b from c",
    "d20_kappa": "with l as (select quality as a, toxic as b from labels where quality is not null and toxic is not null), n as (select count(*) as n, count(*) filter (a = b) / count(*)::double as po, (count(*) filter (a = 1) * count(*) filter (b = 1) + count(*) filter (a = 0) * count(*) filter (b = 0)) / (count(*) * count(*))::double as pe, greatest(count(*) filter (a = 1), count(*) filter (b = 1), count(*) filter (a = 0), count(*) filter (b = 0)) as top from l) select n, round(po, 6) as observed, round(pe, 6) as expected, round(case when pe = 1 then 1.0 else (po - pe) / (1 - pe) end, 6) as kappa, top / n::double >= 0.95 or pe >= 0.9 as degenerate from n",
    "d26_runs": "select source, count(*) as n, count(*) filter (toxic = 1) as flagged, round(count(*) filter (toxic = 1) / count(*)::double, 6) as flagged_rate, count(*) filter (contains(text, '###')) as refusals, round(avg(len(string_split(text, ' '))) filter (quality = 1), 4) as mean_words, max(len(string_split(text, ' '))) as most_words from documents join labels using (doc_id) group by 1",
    "l1_paired": _PA + " select n, round(ma, 6) as mean_a, round(mb, 6) as mean_b, round(m, 6) as mean_diff, round(med, 6) as median_diff, round(sd, 6) as sd_diff, above, equal, below from p",
    "l2_t": _PA + f" select n, round(m / (sd / sqrt(n)), 6) as t, round(m - {S.Z}::double * (sd / sqrt(n)), 6) as low, round(m + {S.Z}::double * (sd / sqrt(n)), 6) as high from p",
    "l7_dz": _PA + " select n, round(m / sd, 6) as dz from p",
    "l3_wilcoxon_w": _CO + ", r as (select round(d, 9) as d from d where round(d, 9) <> 0), k as (select d, avg(i) over (partition by abs(d)) as rank from (select d, row_number() over (order by abs(d)) as i from r)) select count(*) as n, sum(case when d > 0 then rank else 0 end) as w_plus, sum(case when d < 0 then rank else 0 end) as w_minus, least(sum(case when d > 0 then rank else 0 end), sum(case when d < 0 then rank else 0 end)) as w from k",
    "l5_ci": f"with s as (select event_type, count(value) as n, avg(value) as m, stddev_samp(value) as sd from events group by 1) select event_type, n, round(m, 6) as mean, round(m - {S.Z}::double * sd / sqrt(n), 6) as low, round(m + {S.Z}::double * sd / sqrt(n), 6) as high from s",
    "e12_spearman": _CO + ", r as (select row_number() over (order by a, user_id)::double as x, row_number() over (order by b, user_id)::double as y from d) select count(*) as n, case when count(*) >= 3 then round(corr(x, y), 6) end as r from r",
    "l10_repro": "with n as (select count(*) as n, count(*) filter (o_orderkey % 97 <> 0 or o_totalprice is null) as price, count(*) filter (o_orderkey % 89 <> 0 or o_orderpriority is null) as priority from orders) select n, unnest(['status', 'price', 'priority']) as field, unnest([n, price, priority]) as equal from n",
    "l11_bins": "select case when value is null then null when round(value / 20, 6) < 0.125 then 0.0::double when round(value / 20, 6) < 0.375 then 0.25 when round(value / 20, 6) < 0.625 then 0.5 when round(value / 20, 6) < 0.875 then 0.75 else 1.0 end as bin, count(*) as n from events group by 1",
    "l12_latency": "select event_type, round(avg(value), 6) as mean, min(value) as fastest, max(value) as slowest, round(100.0::double * count(*) filter (value <= 3) / count(*), 2) as pass_pct from events group by 1",
}
_BINNED = lambda x: f"case when round({x} / 20, 6) < 0.125 then 0.0::double when round({x} / 20, 6) < 0.375 then 0.25 when round({x} / 20, 6) < 0.625 then 0.5 when round({x} / 20, 6) < 0.875 then 0.75 else 1.0 end"
SQL["d20_within_one"] = _CO + f", q as (select abs(({_BINNED('a')}) - ({_BINNED('b')})) as far from d) select count(*) as n, count(*) filter (far = 0) as same, count(*) filter (far <= 0.25) as near, case when count(*) > 0 then round(count(*) filter (far <= 0.25) / count(*)::double, 6) end as near_share from q"
_PLAIN = ["l2_p", "l3_p", "l4_bootstrap", "l6_clopper"]
QUERIES = {name: globals()[name] for name in [*SQL, *_PLAIN]}
