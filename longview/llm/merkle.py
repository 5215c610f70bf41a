"""Merkle manifest of a dataset by parents' preimages.

Rows are leaves; the leaves of one group, in order, are the bottom of its tree, and the groups' subroots, in order, are the
bottom of the tree above. Every parent is the hash of its children's concatenated digests, and that concatenation,
its preimage, is what is stored: a block of 2^LEVELS consecutive nodes is one row with the preimages of all parents
above it, level by level. The tops of the blocks are the nodes of the next tier, so a tree of n leaves has
log(n) / LEVELS tiers. A leaf joins its block's row and takes out its ancestors' preimages; the tiers above are handed down from block
to block. In a preimage a node's own digest is a slot of 64 characters: without it the siblings are
left, and with another digest put there it is the preimage of the changed tree, so folding needs no other rows.

Positions come from a range sort by (group, id): counts of each written part and group, summed over the parts before it, so that a
group with most of the rows is numbered in many tasks. Texts are hashed where they are read; what is shuffled are ids and digests.

Defined results: nulls count as `-`; a row with a null id comes first in its group, is a leaf and isn't tampered with; rows repeated
under one id are leaves of their own, in order of their digests; a lone leaf is its group's subroot and a lone
subroot the root, whose proof is the hash of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, read

#: Levels of a tier: a block holds 2^LEVELS nodes.
LEVELS = 10
#: Characters of a digest.
SIZE = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Rows whose id's checksum is divisible by this are tampered with.
TAMPERED = 7


def _h(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count and itself, `-` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    return _h(F.concat(*(field(values[c]) for c in FIELDS)))


def group_key(group: Column) -> Column:
    """The group as text that sorts null first, then by bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows with pos, the place within key (from 0) by order, and n, the rows of the key."""
    spread = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = materialize(spread.withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("key", part).agg(F.count("*").alias("run"), F.min("at").alias("first"))
    before = F.sum("run").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("key", F.col("part").alias("own"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("run").over(Window.partitionBy("key")).alias("n"))
    runs = materialize(runs, "runs").withColumnRenamed("key", "run_key")
    met = placed.join(runs, (F.col("key") == F.col("run_key")) & (F.shiftright("at", 33) == F.col("own")))
    return met.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def _preimages(digests: Column, levels: Column) -> Column:
    """All parents' preimages over digests, a list for each level."""
    def joined(below: Column) -> Column:
        last = F.size(below) - 1
        return F.transform(F.sequence(F.lit(0), F.floor(last / 2).cast("int")), lambda j: F.concat(F.get(below, 2 * j), F.coalesce(F.get(below, 2 * j + 1), F.lit(""))))

    first = F.array(joined(digests))
    above = F.aggregate(F.sequence(F.lit(2), levels), first, lambda acc, _: F.concat(acc, F.array(joined(F.transform(F.element_at(acc, -1), _h)))))
    empty = F.slice(first, 1, 0)
    return F.when(levels == 0, empty).when(levels == 1, first).otherwise(above)


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """Of nodes (key, pos, n, digest), n of each key: the written blocks (key, block, n, levels, pre, top) of each tier, from below."""
    out = []
    while True:
        block = F.shiftright("pos", LEVELS).alias("block")
        lists = nodes.groupBy("key", "n", block).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own"))
        # levels until one node is left, whole numbers throughout
        levels = sum(((F.col("n") > (1 << i)).cast("int") for i in range(LEVELS)), F.lit(0))
        lists = lists.select("key", "block", "n", levels.alias("levels"), F.col("own.digest").alias("digests"))
        blocks = lists.withColumn("pre", _preimages(F.col("digests"), F.col("levels")))
        top = F.when(F.col("levels") == 0, F.get("digests", F.lit(0))).otherwise(_h(F.element_at(F.element_at("pre", -1), 1)))
        blocks = materialize(blocks.select("key", "block", "n", "levels", "pre", top.alias("top")), "blocks")
        out.append(blocks)
        nodes = blocks.filter(F.col("n") > (1 << LEVELS)).select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << LEVELS)).cast("long").alias("n"), F.col("top").alias("digest"))
        if nodes.isEmpty():
            return out


def _path(pos: Column) -> Column:
    """The ancestors' preimages within a block, each with whether the node comes second in it."""
    inside = F.pmod(pos, F.lit(1 << LEVELS)).cast("int")
    step = lambda i: F.struct(
        F.get(F.get(F.col("pre"), i - 1), F.call_function("shiftright", inside, i)).alias("p"), (F.call_function("shiftright", inside, i - 1) % 2 == 1).alias("second"),
    )
    none = F.slice(F.array(step(F.lit(1))), 1, 0)
    return F.when(F.col("levels") == 0, none).otherwise(F.transform(F.sequence(F.lit(1), F.col("levels")), step))


def handed_down(blocks: list[DataFrame], crown: DataFrame) -> DataFrame:
    """(key, block, path, subroot, root) for the lowest tier's blocks: their ancestors' preimages above the block, the crown's included.

    crown: (key, path, subroot, root) of each key."""
    own, above = ["key", "block", "path", "subroot", "root"], None
    for tier in reversed(blocks):
        # a key has one block in the tier where it ends, so this join meets one row a key
        ends = tier.filter(F.col("n") <= (1 << LEVELS)).select("key", "block").join(crown, "key").select(own)
        if above is not None:
            upper, whole = above
            under = tier.filter(F.col("n") > (1 << LEVELS)).select("key", F.col("block").alias("pos"), F.shiftright("block", LEVELS).alias("block"))
            met = under.join(whole.select("key", "block", "levels", "pre"), ["key", "block"]).join(upper, ["key", "block"])
            ends = ends.unionByName(met.select("key", F.col("pos").alias("block"), F.concat(_path(F.col("pos")), "path").alias("path"), "subroot", "root"))
        above = materialize(ends, "handed-down"), tier
    return above[0]


def with_paths(nodes: DataFrame, blocks: list[DataFrame], crown: DataFrame) -> DataFrame:
    """nodes with path, subroot and root: each joins its block's preimages and what is handed down to the block."""
    block = blocks[0].select("key", "block", "levels", "pre").join(handed_down(blocks, crown), ["key", "block"])
    block = materialize(block.withColumnRenamed("path", "upper"), "whole-blocks")
    rows = nodes.withColumn("block", F.shiftright("pos", LEVELS)).join(block, ["key", "block"])
    return rows.select(*nodes.columns, F.concat(_path(F.col("pos")), "upper").alias("path"), "subroot", "root")


def siblings(path: Column) -> Column:
    """What is left of the preimages without the own slots, from the leaf up."""
    return F.array_join(F.transform(path, lambda x: F.when(x["second"], F.substring(x["p"], 1, SIZE)).otherwise(F.substring(x["p"], SIZE + 1, SIZE))), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that digest leads to, put into its slot level by level."""
    put = lambda acc, x: F.when(x["second"], F.concat(F.substring(x["p"], 1, SIZE), acc)).otherwise(F.concat(acc, F.substring(x["p"], SIZE + 1, SIZE)))
    return F.aggregate(path, digest, lambda acc, x: _h(put(acc, x)))


def manifest(rows: DataFrame) -> DataFrame:
    """rows (doc_id, key, leaf, changed) with subroot, root, path: key is the group's text, changed the tampered leaf or null."""
    leaves = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    nodes = materialize(numbered(leaves, ["doc_id", "leaf", "row"], "sorted-leaves"), "numbered")
    below = tiers(nodes.select("key", "pos", "n", F.col("leaf").alias("digest")))
    tops = below[0].filter(F.col("n") <= (1 << LEVELS)).select("key", "top")
    for tier in below[1:]:
        tops = tops.unionByName(tier.filter(F.col("n") <= (1 << LEVELS)).select("key", "top"))
    subroots = numbered(tops.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("top").alias("digest")), ["group"], "sorted-subroots")
    subroots = materialize(subroots, "subroots")
    upper = tiers(subroots.select("key", "pos", "n", "digest"))
    # the path above the root is empty, and of the right type
    root = upper[-1].select("key", F.slice(F.array(F.struct(F.col("top").alias("p"), F.lit(False).alias("second"))), 1, 0).alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root"))
    crown = with_paths(subroots, upper, root).select(F.col("group").alias("key"), "path", F.col("digest").alias("subroot"), "root")
    return with_paths(nodes.select("doc_id", "key", "leaf", "changed", "pos", "n"), below, materialize(crown, "crown"))


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs."""
    values = {c: F.col(c) for c in FIELDS}
    number = F.col("n_chars").cast("decimal(38,0)") + 1
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, leaf(values | {"n_chars": number}))
    rows = manifest(docs.select(*FIELDS).select("doc_id", group_key(F.col("lang")).alias("key"), leaf(values).alias("leaf"), changed.alias("changed")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", _h(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(read(spark, sf_dir, "documents"))


#: crc32 by the bits of the decimal id's bytes; the engine has no such function.
_CRC = """xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
    lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, xor(c, x)), 4294967295), 4294967295)"""
_FIELD = lambda c: f"case when {c} is null then '-' else cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar) end"
OP13_SQL = f"""
with recursive d as (
  select doc_id, case when lang is null then '' else '=' || lang end as key, sha256({' || '.join(map(_FIELD, FIELDS))}) as leaf,
    case when doc_id is not null and {_CRC} % 7 = 0 and n_chars is not null then sha256({' || '.join(_FIELD('(n_chars + 1)' if c == 'n_chars' else c) for c in FIELDS)}) end as changed
  from documents
), l as (
  select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by key) as n from d
), lower_tree as (
  with recursive t(key, level, pos, h, n) as (
    select key, 0, pos, leaf, n from l
    union all
    select key, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from t where n > 1 group by key, level, pos // 2
  ) select * from t
), s as (
  select key, h as subroot, row_number() over (order by key) - 1 as place, count(*) over () as groups from lower_tree where n = 1
), upper_tree as (
  with recursive t(level, pos, h, n) as (
    select 0, place, subroot, groups from s
    union all
    select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from t where n > 1 group by level, pos // 2
  ) select * from t
), steps as (
  select l.key, l.pos, t.level, l.pos >> t.level as own, b.h as sibling from l join lower_tree t on t.key = l.key and t.pos = l.pos >> t.level and t.n > 1
    left join lower_tree b on b.key = t.key and b.level = t.level and b.pos = xor(t.pos, 1)
  union all
  select l.key, l.pos, 1000 + t.level, s.place >> t.level, b.h from l join s using (key) join upper_tree t on t.pos = s.place >> t.level and t.n > 1
    left join upper_tree b on b.level = t.level and b.pos = xor(t.pos, 1)
), paths as (
  select key, pos, sha256(coalesce(string_agg(sibling, '' order by level), '')) as proof, list(struct_pack(second := own % 2 = 1, sibling := coalesce(sibling, '')) order by level) as path from steps group by key, pos
), r as (
  select l.*, s.subroot, (select h from upper_tree where n = 1) as root, coalesce(p.proof, sha256('')) as proof_sha256, coalesce(p.path, []) as path
  from l join s using (key) left join paths p on p.key = l.key and p.pos = l.pos
), f(key, pos, step, h) as (
  select key, pos, 0, coalesce(changed, leaf) from r
  union all
  select f.key, f.pos, step + 1, sha256(case when r.path[step + 1].second then r.path[step + 1].sibling || h else h || r.path[step + 1].sibling end) from f join r on r.key = f.key and r.pos = f.pos where step < len(r.path)
)
select r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, f.h as folded_root, f.h = r.root as verified
from r join f on f.key = r.key and f.pos = r.pos and f.step = len(r.path)
"""
