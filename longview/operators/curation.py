"""Building a question set from passages: scoring sentences, accepting greedily, final ids; and routing, reports, cohorts."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens
from ..storage import written

log = logging.getLogger(__name__)

# fixed values: what a sentence gains or loses
CUES = [(r"(^|[^a-zà-ÿ])(is|are|was|were)([^a-zà-ÿ]|$)", 1.0), (r"(^|[^a-zà-ÿ])(the|a|an)([^a-zà-ÿ]|$)", 0.5), (r"[0-9]", 1.0), (r"###|%%%|\|", -2.0)]


def sentence_score(text: Column) -> Column:
    """Cues in the text by their values, and one more for a length of 8 to 40 words."""
    total = F.lit(0.0)
    for pattern, value in CUES:
        total = total + F.when(F.regexp_like(F.lower(text), F.lit(pattern)), F.lit(value)).otherwise(F.lit(0.0))
    words = F.size(F.split(F.trim(text), " +"))
    return total + F.when(words.between(8, 40), F.lit(1.0)).otherwise(F.lit(0.0))


def candidates(passages: DataFrame) -> DataFrame:
    """passages (item_id, text) as scored sentences with the first reason to reject each, '' for none."""
    rows = passages.select("item_id", F.posexplode(F.split("text", r"\. |\n")).alias("pos", "sentence")).filter(F.trim("sentence") != "")
    rows = rows.withColumns({"score": sentence_score(F.col("sentence")), "tokens": content_tokens(F.col("sentence"))})
    reason = F.when(F.size("tokens") < 3, "FEW_WORDS").when(F.length("sentence") > 400, "TOO_LONG").when(F.col("sentence").rlike("###|%%%"), "NOISE").when(F.col("score") < 1, "LOW_SCORE").otherwise("")
    return rows.select("item_id", "pos", "sentence", "score", "tokens", reason.alias("reason"))


def accept(rows: DataFrame, group: str, cap: int, limit: float) -> DataFrame:
    """Rows (group, pos, score, tokens) taken best first, up to cap of a group, unless too similar to one taken before.

    What is taken decides what comes after, so each group (a document's sentences) is folded in one place.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[set] = []
        keep = []
        for row in pdf.sort_values(["score", "pos"], ascending=[False, True]).itertuples():
            tokens = set(row.tokens)
            if len(taken) < cap and all(len(tokens & t) < limit * len(tokens | t) for t in taken):
                taken.append(tokens)
                keep.append((getattr(row, group), row.pos, len(taken)))
        return pd.DataFrame(keep, columns=[group, "pos", "place"])

    kind = dict(rows.dtypes)[group]
    return rows.select(group, "pos", "score", "tokens").groupBy(group).applyInPandas(fold, f"{group} {kind}, pos int, place int")


def finalise(rows: DataFrame, order: list[str], prefix: str, expected: int | None = None) -> DataFrame:
    """Accepted rows (a set of bounded size) with ids prefix-001 on in order; raises where their number isn't the one expected."""
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return rows.withColumn("id", F.format_string(f"{prefix}-%03d", k)).withColumn("status", F.lit("FINAL"))


class Router:
    """Retrieval backends by name. What is asked wins over the environment's setting, that over the default; names are
    compared without case and blanks; an unknown one, and `both` where no such backend is given, is the default. A backend is
    made once, when it is first asked. Where one fails, in being made or in its jobs, the default takes its place, or, without
    fallback, there is no evidence: a frame without rows. The default's own failure is raised."""

    def __init__(self, backends: dict[str, Callable[[], Callable[..., DataFrame]]], default: str, schema: str, setting: str = "RETRIEVAL_BACKEND"):
        self.makers, self.default, self.schema, self.setting = backends, default, schema, setting
        self.made: dict[str, Callable[..., DataFrame]] = {}

    def chosen(self, backend: str | None = None) -> str:
        name = (os.environ.get(self.setting, self.default) if backend is None else str(backend)).strip().lower()
        return name if name in self.makers else self.default

    def reset(self) -> None:
        self.made.clear()

    def _run(self, name: str, *args) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name](*args)

    def retrieve(self, spark: SparkSession, *args, backend: str | None = None, fallback: bool = True) -> DataFrame:
        name = self.chosen(backend)
        if name == self.default:
            return self._run(name, *args)
        try:
            return written(self._run(name, *args), "evidence")  # so that a failure shows here, not in what reads the rows
        except Exception as e:
            log.warning("backend %s failed: %r", name, e)
            return self._run(self.default, *args) if fallback else spark.createDataFrame([], self.schema)


def cohort(patients: DataFrame, birth: str, as_of: str, least: int) -> DataFrame:
    """Patients of at least that age."""
    from ..functions.values import age

    return patients.filter(age(F.to_date(birth), F.lit(as_of).cast("date")) >= least)


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A small result as a table; raises where it is longer than limit."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, got)]) + "\n"


def rendered(rows: DataFrame, column: str, render: Callable[[str], str]) -> DataFrame:
    """Texts through a Python function, in Arrow batches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{column: [render(x) if x is not None else None for x in pdf[column]]})

    return rows.mapInPandas(run, rows.schema)
