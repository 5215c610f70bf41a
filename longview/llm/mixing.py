"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations.

A token budget goes down a tree of domain, language and source. At each node it is shared by the children's
weights; a child never gets more than its subtree can give (its tokens times max_epochs), and what it can't use
goes to its siblings by weight. A node gets less than its share only if its whole subtree is exhausted, so a
shortage is met by siblings before ancestors. Each leaf's budget is spent on seeded epochs: every full epoch is
all of its documents, the last one a prefix in tokens of that epoch's seeded order, whose last document may be
cut (take_tokens).

The prefix's end is found without sorting a leaf: sums by the leading digits of the order's hash give the one
slice that holds the end, and only that slice is ordered. Documents are then compared with the end, so texts
aren't shuffled and a leaf with a third of all rows is read by all tasks.

Defined results: a null language or source is a leaf named ''; documents without a token or an id aren't
selected; rows repeated under one id are selected alike; weights not given are 1, and those not above 0 take
nothing; an empty table gives no rows; extra columns are kept, whatever their names, but for epoch, domain, n_tokens and
take_tokens, which the result's take the place of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, read

LEVELS = ("_domain", "_language", "_source")
#: Rows of a slice of a leaf's order, at most about.
SLICE = 20_000
#: Leaves up to which their table is broadcast; beyond, it is joined by shuffle.
FEW_LEAVES = 50_000

# the query's parameters: fixed values
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"], "forum": ["src8", "src9", "src10", "src11", "src12", "src13"]}
OTHER_DOMAIN = "reference"
WEIGHTS = {"_domain": {"web": 5, "forum": 2, "reference": 3}, "_language": {"en": 4, "de": 2}, "_source": {"src0": 2}}
SEED, FRACTION, EPOCHS = 17, 0.9, 3


def domain_of(source: Column, domains: dict[str, list[str]], other: str) -> Column:
    out = F.lit(other)
    for name, sources in domains.items():
        out = F.when(source.isin(sources), name).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Words: runs of characters other than white space (0x20, 0x09-0x0D)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, float(w)).otherwise(out)
    return out


def budgets(leaves: DataFrame, total: Column, weights: dict, max_epochs: int) -> DataFrame:
    """leaves (_domain, _language, _source, _tokens) with _budget, the tokens that each may take."""
    everything = leaves.agg(F.sum("_tokens")).first()[0] or 0
    nodes = leaves.withColumn("_cap", F.col("_tokens") * max_epochs).withColumn("_budget", F.least(total, F.lit(everything * max_epochs).cast("long")))
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        parent = path[:-1] or [F.lit(0)]
        below = nodes.groupBy(*path).agg(F.sum("_cap").alias("_c"), F.first("_budget").alias("_b")).withColumn("_w", _weight(level, weights)).filter("_w > 0")
        order = Window.partitionBy(*parent).orderBy(F.col("_c").cast("double") / F.col("_w"), level)
        before = F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        onward = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
        full = (F.col("_b") - before).cast("double") * F.col("_w") >= F.col("_c").cast("double") * onward
        shared = below.withColumn("_full", full)
        all_ = Window.partitionBy(*parent)
        spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_c"))).over(all_), F.lit(0))
        left = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_)
        given = F.when(F.col("_full"), F.col("_c")).otherwise(F.floor((F.col("_b") - spent).cast("double") / left * F.col("_w")))
        nodes = nodes.drop("_budget").join(shared.select(*path, given.cast("long").alias("_budget")), path)
    return nodes.drop("_cap")


def _order(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("doc_id").cast("string")).cast("binary"))


def mix(docs: DataFrame, domain: Column, weights: dict, seed: int, fraction: float = 1.0, max_epochs: int = 1, tokens: Column | None = None) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) selected to the weights, with epoch, domain, n_tokens and
    take_tokens; the budget is the fraction of all tokens. tokens: each document's number of tokens, its words where
    none is given."""
    leaf = [domain.alias("_domain"), F.coalesce("lang", F.lit("")).alias("_language"), F.coalesce("source", F.lit("")).alias("_source")]
    count = (n_tokens(F.col("text")) if tokens is None else tokens).alias("_n")
    slim = materialize(docs.filter("doc_id is not null").select("doc_id", *leaf, count).filter("_n > 0"), "mix-docs")
    stats = materialize(slim.groupBy(*LEVELS).agg(F.sum("_n").alias("_tokens"), F.count("*").alias("_rows")), "mix-leaves")
    facts = stats.agg(F.sum("_tokens").alias("t"), F.max("_rows").alias("m"), F.count("*").alias("k")).first()
    total = int(fraction * (facts["t"] or 0))
    digits = 1
    while (facts["m"] or 0) > SLICE * 16**digits:
        digits += 1
    few = facts["k"] <= FEW_LEAVES

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    plan = budgets(stats.select(*LEVELS, "_tokens"), F.lit(total).cast("long"), weights, max_epochs)
    plan = materialize(plan.selectExpr(*LEVELS, "_budget div _tokens as _whole", "_budget % _tokens as _rest"), "mix-plan")
    keys = list(LEVELS)
    dealt = slim.join(small(plan.filter("_rest > 0")), keys).withColumn("_h", _order(F.col("_whole"), seed)).withColumn("_slice", F.substring("_h", 1, digits))
    sums = dealt.groupBy(*keys, "_slice", "_rest").agg(F.sum("_n").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_slice")
    at = sums.withColumn("_before", F.sum("_s").over(w) - F.col("_s")).filter("_before < _rest and _before + _s >= _rest").drop("_s", "_rest")
    inner = Window.partitionBy(*keys).orderBy("_h", "doc_id")
    last = dealt.join(small(at), [*keys, "_slice"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inner))
    ends = last.filter("_upto - _n < _rest and _upto >= _rest").selectExpr(*keys, "_h as _end", "doc_id as _end_id", "_n - (_upto - _rest) as _take")
    ends = ends.groupBy(*keys).agg(F.min(F.struct("_end", "_end_id", "_take")).alias("_e")).select(*keys, "_e.*")
    plan = materialize(plan.join(ends, keys, "left"), "mix-ends")

    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.filter("doc_id is not null").select("doc_id", every, *leaf, count).filter("_n > 0").join(small(plan), keys)
    rows = rows.withColumn("_h", _order(F.col("_whole"), seed))
    before = (F.col("_h") < F.col("_end")) | ((F.col("_h") == F.col("_end")) & (F.col("doc_id") < F.col("_end_id")))
    ends_it = (F.col("_h") == F.col("_end")) & (F.col("doc_id") == F.col("_end_id"))
    take = F.when(before, F.col("_n")).when(ends_it, F.col("_take"))
    full = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_whole")), lambda e: F.struct((e - 1).alias("epoch"), F.col("_n").alias("take_tokens")))
    full = F.when(F.col("_whole") > 0, full).otherwise(F.array().cast("array<struct<epoch:bigint,take_tokens:bigint>>"))
    part = F.when(take.isNotNull(), F.array(F.struct(F.col("_whole").alias("epoch"), take.alias("take_tokens")))).otherwise(F.array().cast("array<struct<epoch:bigint,take_tokens:bigint>>"))
    chosen = rows.withColumn("_x", F.explode(F.concat(full, part)))
    out = {"epoch": F.col("_x.epoch"), "domain": F.col("_domain"), "n_tokens": F.col("_n"), "take_tokens": F.col("_x.take_tokens")}
    return chosen.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in out), *(c.alias(k) for k, c in out.items()))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counted = materialize(docs.select("doc_id", "lang", "source", n_tokens(F.col("text")).alias("words")), "mix-words")  # each text is read once
    chosen = mix(counted, domain_of(F.col("source"), DOMAINS, OTHER_DOMAIN), WEIGHTS, SEED, FRACTION, EPOCHS, F.col("words"))
    return chosen.select("doc_id", "epoch", "domain", "lang", "source", "n_tokens", "take_tokens")


def _sql_list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _sql_weight(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{n}' then {float(w)}" for n, w in WEIGHTS[level].items()) + " else 1.0 end"


def _sql_level(name: str, depth: int, source: str) -> str:
    level, path = LEVELS[depth], ", ".join(LEVELS[: depth + 1])
    parent = ", ".join(LEVELS[:depth]) or "1"
    return f"""
{name}_c as (select {path}, sum(_cap) as c, any_value(_budget) as b, cast({_sql_weight(level)} as double) as w from {source} group by {path}),
{name}_f as (select *, (b - coalesce(sum(c) over (o rows between unbounded preceding and 1 preceding), 0))::double * w
    >= c::double * sum(w) over (o rows between current row and unbounded following) as is_full
  from {name}_c window o as (partition by {parent} order by c::double / w, {level})),
{name}_a as (select {path}, cast(case when is_full then c else floor((b - coalesce(sum(c) filter (is_full) over p, 0))::double
    / sum(w) filter (not is_full) over p * w) end as bigint) as _budget from {name}_f window p as (partition by {parent})),
{name} as (select s.* exclude (_budget), a._budget from {source} s join {name}_a a using ({path}))"""


OP5_SQL = f"""
with d as (
  select doc_id, lang, source, case when source in ({_sql_list(DOMAINS['web'])}) then 'web' when source in ({_sql_list(DOMAINS['forum'])}) then 'forum' else '{OTHER_DOMAIN}' end as _domain,
    coalesce(lang, '') as _language, coalesce(source, '') as _source, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) as n
  from documents where doc_id is not null
), t as (select * from d where n > 0),
l0 as (select _domain, _language, _source, sum(n)::bigint as _tokens, (sum(n) * {EPOCHS})::bigint as _cap from t group by all),
r as (select *, least((select cast(floor({FRACTION}::double * sum(_tokens)) as bigint) from l0), (select sum(_cap)::bigint from l0)) as _budget from l0),
{_sql_level('l1', 0, 'r')},
{_sql_level('l2', 1, 'l1')},
{_sql_level('l3', 2, 'l2')},
p as (select _domain, _language, _source, _budget // _tokens as whole, _budget % _tokens as rest from l3),
o as (select t.*, p.whole, p.rest, sum(n) over (partition by _domain, _language, _source order by md5('{SEED}:' || whole || ':' || doc_id), doc_id rows unbounded preceding) - n as before
  from t join p using (_domain, _language, _source)),
x as (
  select doc_id, unnest(range(whole)) as epoch, _domain, lang, source, n, n as take from o where whole > 0
  union all select doc_id, whole, _domain, lang, source, n, least(n, rest - before) from o where before < rest
)
select doc_id, cast(epoch as bigint) as epoch, _domain as domain, lang, source, cast(n as bigint) as n_tokens, cast(take as bigint) as take_tokens from x
"""
