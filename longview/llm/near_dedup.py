"""MinHash near-dedup by a multi-index Hamming join.

Each distinct shingle set gets a signature of CHUNKS * WIDTH symbols of 16 bits, one MinHash value each. The
signature is cut into CHUNKS chunks. If two signatures differ in at most CHUNKS * (ERRORS + 1) - 1 = 19
symbols, then by pigeonhole some chunk differs in at most ERRORS = 1 symbol, so the two share one of the
keys made by leaving out each symbol of each chunk in turn (the enumerated chunk errors). All such pairs are
found. A pair with a similarity of 0.8 differs in 12 of 60 symbols on average and is missed with a
probability of 2e-5 (at 0.85: 3e-7), as all ten chunks would have to differ in two symbols or more.

Candidates are confirmed on the full shingle sets. What is needed is each document's component, so not every
pair is made: every key first links its documents to one of them, its centre; those links are confirmed and joined
to components. Then every pair that shares a key and still lies in different components is compared, in tiles:
documents are dealt to blocks by the keys that they share, and a tile is two blocks of which several components
share a key. It gets only the documents that hold such a key, each text once, and each is compared on its
full set with all that are of like size. A group of n copies costs O(n) pairs, and no link that could join two components is left out.
Versions of one text that are not alike enough are still compared all with all, but within blocks as large as memory
allows: a key's rows are one a document, and a document is sent once for each block that its family fills.

Defined results: null and empty texts have no shingles and form components of their own; a row with a null id
is left out; each row repeated under one id and text gets the same result; rows of one id with different texts are documents
of their own, each with its text's component, so that a text's copies never drop another text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialize, read, tidy
from ._shingles import mix, shingle_sets

CHUNKS, WIDTH, ERRORS = 10, 6, 1
SYMBOLS = CHUNKS * WIDTH
#: Documents compared with one text by one task; more are split.
LEAVES = 256
#: Documents of a block.
GROUP = 2048
#: Rounds in which documents choose the key by whose blocks they go.
HOMES = 3
#: Bytes of texts of a block, about; a side of a tile has no more.
TILE = 1 << 22

_rng = np.random.default_rng(20240)
_A = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SYMBOLS 16-bit values for each set (none may be empty)."""
    flat = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for i in range(SYMBOLS):
        # the least of many values is small, and its top bits would be alike in any two large sets
        out[:, i] = mix(np.minimum.reduceat(flat * _A[i] + _B[i], first)) >> np.uint64(48)
    return out


def _rows(pdf: pd.DataFrame, budget: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The frame in parts of about budget characters, so that memory doesn't follow the row count."""
    sizes = pdf["text"].str.len().fillna(0).to_numpy().cumsum()
    part = (sizes // budget).astype(np.int64)
    for _, rows in pdf.groupby(part, sort=False):
        yield rows


def _sign(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pdf in _rows(frame):
                sets = shingle_sets(pdf["text"].tolist(), words)
                full = [s for s in sets if len(s)]
                n = np.array([len(s) for s in sets], np.int64)
                d1, d2, sig = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), [b""] * len(sets)
                if full:
                    flat = np.concatenate(full)
                    first = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
                    d1[n > 0] = np.add.reduceat(mix(flat), first).view(np.int64)
                    d2[n > 0] = np.add.reduceat(mix(flat * _A[0] + _B[1]), first).view(np.int64)
                    for i, s in zip(np.flatnonzero(n > 0), _signatures(full), strict=True):
                        sig[i] = s.tobytes()
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "t": pdf["t"].to_numpy(), "n": n, "d1": d1, "d2": d2, "sig": sig})

    return run


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each signature's keys: for each chunk, its symbols without one, in turn."""
    for frame in frames:
        for at in range(0, len(frame), 2000):
            pdf = frame.iloc[at : at + 2000]
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            keys = np.empty((len(pdf), SYMBOLS), np.uint64)
            for c in range(CHUNKS):
                for out in range(WIDTH):
                    acc = np.full(len(pdf), np.uint64(c * WIDTH + out + 1))
                    for j in range(WIDTH):
                        if j != out:
                            acc = mix(acc * _A[0] + sig[:, c * WIDTH + j])
                    keys[:, c * WIDTH + out] = acc
            slot = np.tile(np.arange(SYMBOLS, dtype=np.int8), len(pdf))
            yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "slot": slot, "doc_id": np.repeat(pdf["doc_id"].to_numpy(), SYMBOLS)})


def _linked(words: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, hub_set = None, None
        for frame in frames:
            for pdf in _rows(frame):
                a, b = [], []
                for h, salt, leaf, s in zip(pdf["hub"], pdf["salt"], pdf["doc_id"], shingle_sets(pdf["text"].tolist(), words), strict=True):
                    if leaf == h:
                        hub, hub_set = (h, salt), s
                    elif hub == (h, salt) and len(s) and len(hub_set):
                        small, large = sorted((len(s), len(hub_set)))
                        if 100 * small >= percent * large:
                            both = len(np.intersect1d(s, hub_set, assume_unique=True))
                            if 100 * both >= percent * (len(s) + len(hub_set) - both):
                                a.append(h)
                                b.append(leaf)
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (hub, doc_id) whose full shingle sets are similar enough, as (a, b).

    A hub's pairs are split into groups of about LEAVES, each of which gets the hub's text once.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / LEAVES).alias("parts"))
    salted = pairs.join(sizes, "hub").select("hub", F.expr("pmod(xxhash64(doc_id), parts)").alias("salt"), "doc_id")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.col("hub").alias("doc_id"))
    wanted = salted.unionByName(hubs)
    rows = wanted.join(texts, "doc_id").select("hub", "salt", "doc_id", "text")
    ordered = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc_id") != F.col("hub"), "doc_id")
    return ordered.mapInPandas(tidy(_linked(words, percent)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node reachable.

    Rounds of large-star and small-star; each is two aggregations and joins, and no neighbour list is
    ever held in one place. Rounds end when the edges no longer change.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e"))
        before, edges = edges, materialize(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "edges")
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(pmod(xxhash64(b, a), 1000003))").alias("s")).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.groupBy("b").agg(F.min("b").alias("component")).select(F.col("b").alias("node"), "component"))


def _tile_links(rows: list[tuple], words: int, percent: int) -> list[tuple[int, int]]:
    """Links between the left and the right documents of one tile, each row (doc_id, component, left, right, text). Every pair of
    two components is compared on full sets; components that a link joins count as one from there on, so that
    no more links come out than are needed."""
    sets = shingle_sets([r[4] for r in rows], words)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, rows = [sets[i] for i in order], [rows[i] for i in order]
    n = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(n)))
    doc, comp = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    left, right = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    names, sizes = np.unique(comp, return_counts=True)
    # of two documents to compare, one at least lies outside the largest component
    apart = comp != names[sizes.argmax()]
    mark, out = np.zeros(len(code) + 1, np.int32), []
    for few, many in ((left & apart, right), (right & ~left & apart, left & ~apart)):
        for x in np.flatnonzero(few):
            # in order of sizes, those that can be similar enough follow each other
            lo, hi = np.searchsorted(100 * n, percent * n[x]), np.searchsorted(percent * n, 100 * n[x], side="right")
            if not (many[lo:hi] & (comp[lo:hi] != comp[x])).any():
                continue
            own = code[at[x] : at[x + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[code[at[lo] : at[hi]]], at[lo:hi] - at[lo])
            mark[own] = 0
            for y in lo + np.flatnonzero(many[lo:hi] & (100 * both >= percent * (n[x] + n[lo:hi] - both))):
                if comp[y] != comp[x]:
                    comp[comp == comp[y]] = comp[x]
                    out.append((int(min(doc[x], doc[y])), int(max(doc[x], doc[y]))))
    return out


def _tiles(words: int, percent: int):
    """Rows sorted by tile; a tile's rows follow each other, over frames if need be."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, rows = None, []
        for frame in frames:
            found = []
            for row in frame[["i", "j", "doc_id", "component", "left", "right", "text"]].itertuples(index=False, name=None):
                if row[:2] != tile:
                    found += _tile_links(rows, words, percent) if rows else []
                    tile, rows = row[:2], []
                rows.append(row[2:])
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
        yield pd.DataFrame(_tile_links(rows, words, percent) if rows else [], columns=["a", "b"]).astype("int64")

    return run


def _blocks(held: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, component, keys, block) of held (doc_id, component, keys): blocks of about GROUP documents, fewer where they
    are long, that have keys in common.

    Documents joined by shared keys form a family. One that fits is a block. In larger ones a document goes by the most
    frequent of its keys. A component that would fill much of a block of such a key has blocks of its own, as it isn't
    compared with itself."""
    member = materialize(held.select("doc_id", F.explode("keys").alias("key")), "members")
    of_key = member.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("g"))
    keys = materialize(member.join(of_key, "key"), "keys")
    discard(member)
    family = components(keys.select("a", F.col("doc_id").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes"))
    docs = materialize(held.join(family, "doc_id").join(sizes, "doc_id"), "families")
    filled = F.greatest(F.count("*") / GROUP, F.sum("bytes") / TILE)
    large = docs.join(docs.groupBy("family").agg(filled.alias("all")).filter("all > 1").select("family"), "family")
    for i in range(HOMES):  # by the key that most have, then by the one to which most of those went, so that homes are few
        often = keys if i == 0 else keys.drop("g").join(home.groupBy(F.col("home").alias("key")).agg(F.count("*").alias("g")), "key")
        home = often.groupBy("doc_id").agg(F.max(F.struct("g", "key"))["key"].alias("home"))
    home = materialize(large.drop("keys").join(home, "doc_id"), "homes")
    parts = home.groupBy("home", "component").agg(filled.alias("own"))
    others = parts.filter("own <= 0.25").groupBy("home").agg(F.ceil(F.sum("own")).alias("others"))
    alone = F.xxhash64("home", "component", F.expr("pmod(xxhash64(doc_id, 7), ceil(own))"))
    mixed = F.xxhash64("home", F.expr("pmod(xxhash64(component, 8), others)"))
    dealt = home.join(parts.join(others, "home", "left"), ["home", "component"]).select("doc_id", F.when(F.col("own") > 0.25, alone).otherwise(mixed).alias("block"))
    return docs.join(dealt, "doc_id", "left").select("doc_id", "component", "keys", F.coalesce("block", "family").alias("block"))


def cross_links(held: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between documents of held (doc_id, component, keys) that share a key and lie in different components.

    Two blocks (or one) whose documents of a key lie in several components make a tile. A tile gets those of their documents
    that hold such a key, each text once, however many keys and pairs they share.
    """
    held = materialize(_blocks(held, texts), "held")
    member = materialize(held.select("doc_id", "component", "block", F.explode("keys").alias("key")), "members")
    spans = member.groupBy("key", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    # a key's blocks in one row, and each of them with those that it is to meet: a document's key stays one row, however many blocks have it
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("block", "lo", "hi")).alias("all")).select("key", "all", F.explode("all").alias("own"))
    meets = F.expr("transform(filter(all, y -> least(own.lo, y.lo) <> greatest(own.hi, y.hi)), y -> y.block)")
    met = spans.select("key", F.col("own.block").alias("block"), meets.alias("others")).filter("size(others) > 0")
    tiles = member.join(met, ["key", "block"]).groupBy("doc_id", "component", "block").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    placed = tiles.select("doc_id", "component", "block", F.explode("others").alias("other"))
    placed = materialize(placed.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "component", "block"), "placed")
    tiles = placed.join(texts, "doc_id").select("i", "j", "doc_id", "component", (F.col("block") == F.col("i")).alias("left"), (F.col("block") == F.col("j")).alias("right"), "text")
    return tiles.repartition("i", "j").sortWithinPartitions("i", "j", "doc_id").mapInPandas(tidy(_tiles(words, percent)), "a long, b long")


def _apart(paired: DataFrame, joined: DataFrame) -> DataFrame:
    """(doc_id, component, keys) of the documents that share a key with one of another component and haven't met it:
    those keys. All documents of a key have met its hub."""
    member = paired.filter("doc_id <> hub").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return member.join(split, "key").groupBy("doc_id", "component").agg(F.collect_list("key").alias("keys"))


def _grown(links: DataFrame | None, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written links with more, and their components."""
    more = materialize(more, "links")
    links = more if links is None else links.unionByName(more)
    return links, materialize(components(links), "components")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Linked are documents with 100 * |intersection| >= percent * |union| of their sets of word shingles;
    percent must be 80 or more.
    """
    if percent < 80:
        raise ValueError("the signature's guarantee holds for a similarity of 0.8 or more")
    # a row is known by its id and its text's hash, as one id may have several texts
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null").withColumn("t", F.xxhash64("text"))
    signed = materialize(texts.mapInPandas(tidy(_sign(words)), "doc_id long, t long, n long, d1 long, d2 long, sig binary"), "signed")
    full = signed.filter("n > 0")
    first = full.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    classes = materialize(first.select("n", "d1", "d2", F.col("first.doc_id").alias("rep"), F.col("first.t").alias("t"), F.monotonically_increasing_id().alias("node")), "classes")
    row_of = classes.select(F.col("rep").alias("doc_id"), "t", "node")
    # from here on doc_id is the number of a class of equal sets
    reps = full.select("doc_id", "t", "sig").join(row_of, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
    reps = materialize(reps.select(F.col("node").alias("doc_id"), "sig"), "reps")

    keys = reps.select("doc_id", "sig").mapInPandas(tidy(_keys), "key long, slot byte, doc_id long")
    several = keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("key")
    shared = materialize(keys.join(several, "key"), "shared")

    # the texts that later steps need, by the same plan at every size: one pass over the corpus's texts, in one shuffle
    near = row_of.join(shared.select(F.col("doc_id").alias("node")).distinct(), "node").hint("merge")
    texts = materialize(texts.join(near, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select(F.col("node").alias("doc_id"), "text"), "near-texts")

    # one centre per key: the smallest by a hash that the keys of a chunk have in common
    order = F.struct(F.xxhash64("doc_id", F.floor(F.col("slot") / WIDTH)).alias("h"), "doc_id")
    centre = shared.groupBy("key").agg(F.min(order)["doc_id"].alias("hub"))
    paired = materialize(shared.join(centre, "key").select("key", "doc_id", "hub"), "paired")
    discard(shared)
    pairs = paired.filter("doc_id <> hub").select("hub", "doc_id").distinct()
    links, joined = _grown(None, confirm(pairs, texts, words, percent))

    held = materialize(_apart(paired, joined), "held")
    if not held.isEmpty():
        links, joined = _grown(links, cross_links(held, texts, words, percent))

    named = materialize(joined.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id")), "named")
    labels = classes.join(joined, "node", "left").join(named, "component", "left").select("n", "d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    found = full.select("doc_id", "n", "d1", "d2").join(labels, ["n", "d1", "d2"]).select("doc_id", "n", "component_id")
    alone = signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of two words, a similarity of 0.8 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)
