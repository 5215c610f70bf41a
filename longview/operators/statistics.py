"""Agreement, paired comparisons and intervals. Moments are aggregates; probabilities are functions of a few numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .places import running

Z = 1.959964
#: Differences up to this count as none, and differences up to which the signed ranks' null is counted out.
SAME, EXACT = 1e-9, 50


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two binary columns and what share of each one's positives the other confirms; null without any."""
    x, y = F.col(a), F.col(b)
    one = rows.filter(x.isNotNull() & y.isNotNull()).agg(
        F.count_if((x == 1) & (y == 1)).alias("common"), F.count_if((x == 1) & (y == 0)).alias("a_only"), F.count_if((x == 0) & (y == 1)).alias("b_only"), F.count_if((x == 0) & (y == 0)).alias("neither"),
    )
    share = lambda n, d: F.when(d > 0, F.round(n / d, 6))
    return one.withColumns({"of_a": share(F.col("common"), F.col("common") + F.col("a_only")), "of_b": share(F.col("common"), F.col("common") + F.col("b_only"))})


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa with observed and expected agreement; 1 where nothing but agreement is possible, null without rows."""
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "v", "full_outer").agg(F.sum(F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0))).alias("c"), F.max(F.greatest("na", "nb")).alias("top"))
    one = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    k = F.when(F.col("n") > 0, F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)))
    return one.select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(k, 6).alias("kappa"), ((F.col("top") / F.col("n") >= 0.95) | (pe >= 0.9)).alias("degenerate"))


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, means, the differences' mean, median, deviation and signs, t, the effect size and a normal interval."""
    d = F.col(a) - F.col(b)
    one = rows.filter(d.isNotNull()).agg(
        F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(d).alias("m"), F.percentile(d, F.lit(0.5)).alias("med"), F.stddev_samp(d).alias("sd"),
        F.count_if(d > SAME).alias("above"), F.count_if(F.abs(d) <= SAME).alias("equal"), F.count_if(d < -SAME).alias("below"),
    )
    se = F.col("sd") / F.sqrt("n")
    r = lambda c: F.round(c, 6)
    return one.select(
        "n", r(F.col("ma")).alias("mean_a"), r(F.col("mb")).alias("mean_b"), r(F.col("m")).alias("mean_diff"), r(F.col("med")).alias("median_diff"), r(F.col("sd")).alias("sd_diff"), "above", "equal", "below",
        r(F.col("m") / se).alias("t"), r(F.col("m") / F.col("sd")).alias("dz"), r(F.col("m") - Z * se).alias("low"), r(F.col("m") + Z * se).alias("high"),
    )


def _signed_ranks(rows: DataFrame, a: str, b: str) -> tuple[DataFrame, int]:
    """(one row of n, w_plus, w_minus, w and ties, how many differences are zero). The differences' histogram, as long as the data where
    they are continuous, is written and ranked in bands; ties is the sum of t^3 - t over equal sizes."""
    d = F.round(F.col(a) - F.col(b), 9)
    hist = written(rows.select(d.alias("d")).filter("d is not null").groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up")), "differences")
    zeros = hist.filter("size = 0").agg(F.sum("n")).first()[0] or 0
    ranked = running(hist.filter("size > 0"), ["size"], "upto", "n").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    n = F.col("n").cast("double")
    one = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(n * n * n - n).alias("ties"))
    return one.withColumn("w", F.least("w_plus", "w_minus")), zeros


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The signed-rank statistic, zeros left out, ties by mean rank."""
    return _signed_ranks(rows, a, b)[0].select("n", "w_plus", "w_minus", "w")


def spearman(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Correlation of ordinal ranks, ties by key; null for fewer than three rows. The rows are written and ranked in bands."""
    stored = written(rows.select(a, b, key), "ratings")
    x = running(stored, [a, key], "x").select(key, F.col("x").cast("double"))
    y = running(stored, [b, key], "y").select(key, F.col("y").cast("double"))
    return x.join(y, key).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).select("n", F.when(F.col("n") >= 3, F.round("r", 6)).alias("r"))


def within_one(rows: DataFrame, a: str, b: str, step: float = 0.25) -> DataFrame:
    """Of two ratings in steps: how many rows hold both, how many agree, and how many differ by one step at most."""
    far = F.abs(F.col(a) - F.col(b))
    one = rows.filter(far.isNotNull()).agg(F.count("*").alias("n"), F.count_if(far == 0).alias("same"), F.count_if(far <= step).alias("near"))
    return one.withColumn("near_share", F.when(F.col("n") > 0, F.round(F.col("near") / F.col("n"), 6)))


def support_bin(x: Column) -> Column:
    """To the nearest of 0, .25, .5, .75 and 1, halves up."""
    out = F.lit(1.0)
    for cut, value in ((0.875, 0.75), (0.625, 0.5), (0.375, 0.25), (0.125, 0.0)):
        out = F.when(x < cut, value).otherwise(out)
    return F.when(x.isNotNull(), out)


# Functions of a few numbers


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The value that a t distribution falls below with probability p, one half or more."""
    lo, hi = 0.0, 1.0
    while 1 - t_p_value(hi, df) / 2 < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_p_value(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def paired_t_test(rows: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """(n, t, p, low, high) with the t interval of the mean difference; t and p are null without a spread, and all but n
    for fewer than two rows. Moments are one row, of which a Python function takes the rest."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for n, m, sd in zip(pdf["n"], pdf["m"], pdf["sd"], strict=True):
                se = sd / math.sqrt(n) if n > 1 else math.nan
                t = m / se if se > 0 else None
                half = t_quantile(1 - alpha / 2, n - 1) * se if n > 1 else None
                out.append((n, t, t_p_value(t, n - 1) if t is not None else None, m - half if half is not None else None, m + half if half is not None else None))
            yield pd.DataFrame([(r[0], *(None if x is None else round(float(x), 9) for x in r[1:])) for r in out], columns=["n", "t", "p", "low", "high"]).astype({c: "float64" for c in ("t", "p", "low", "high")})

    d = F.col(a) - F.col(b)
    one = rows.filter(d.isNotNull()).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"))
    return one.mapInPandas(run, "n long, t double, p double, low double, high double")


def wilcoxon_test(rows: DataFrame, a: str, b: str, least: int = 6) -> DataFrame:
    """(n, w, p) of the signed ranks; p is null for fewer than least differences other than zero."""
    one, zeros = _signed_ranks(rows, a, b)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p = [round(wilcoxon_p_value(float(w), int(n), float(t), zeros > 0), 9) if n >= least else None for w, n, t in zip(pdf["w"], pdf["n"], pdf["ties"], strict=True)]
            yield pdf[["n", "w"]].assign(p=p).astype({"p": "float64"})

    one = one.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).cast("double").alias("w"), F.coalesce("ties", F.lit(0.0)).alias("ties"))
    return one.mapInPandas(run, "n long, w double, p double")


def wilcoxon_p_value(w: float, n: int, ties: float = 0.0, zeros: bool = False) -> float:
    """Two-sided. Up to EXACT differences without ties or zeros the exact share of signs that give w or less, by counting the subsets of ranks
    with each sum; else the normal approximation, its variance less what ties take off."""
    if not n:
        return 1.0
    if n <= EXACT and not ties and not zeros:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for rank in range(1, n + 1):
            ways[rank:] += ways[:-rank].copy()
        return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2))) if sd > 0 else 1.0


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    def quantile(p: float, a: float, b: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if beta_cdf(a, b, mid) < p else (lo, mid)
        return (lo + hi) / 2

    return (quantile(alpha / 2, k, n - k + 1) if k else 0.0, quantile(1 - alpha / 2, k + 1, n - k) if k < n else 1.0)


def with_intervals(counts: DataFrame, k: str, n: str) -> DataFrame:
    """counts with an exact interval of each row's share."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [clopper_pearson(int(a), int(b)) for a, b in zip(pdf[k], pdf[n], strict=True)]
            yield pdf.assign(low=[round(x[0], 6) for x in found], high=[round(x[1], 6) for x in found])

    names = ", ".join(f"{c} {t}" for c, t in counts.dtypes)
    return counts.mapInPandas(run, f"{names}, low double, high double")


def bootstrap_means(histogram: DataFrame, group: str, value: str, n: str, rounds: int = 10000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """An interval of each group's mean from its histogram (group, value, n), which bounds what a task holds.

    A resample of all the group's rows is one multinomial draw over the histogram, so its cost doesn't follow the rows.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        rng, values, counts = np.random.default_rng(seed), pdf[value].to_numpy(float), pdf[n].to_numpy(np.int64)
        size, part = int(counts.sum()), max(1, (1 << 20) // len(values))
        means = np.sort(np.concatenate([rng.multinomial(size, counts / size, min(part, rounds - at)) @ values / size for at in range(0, rounds, part)]))
        low, high = means[int(alpha / 2 * rounds)], means[min(rounds - 1, int((1 - alpha / 2) * rounds))]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean": [round(float(values @ counts) / size, 6)], "low": [round(float(low), 6)], "high": [round(float(high), 6)]})

    kind = dict(histogram.dtypes)[group]
    return histogram.groupBy(group).applyInPandas(run, f"{group} {kind}, mean double, low double, high double")
