"""Pairs of similar token sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage

#: Sets of one block at most, and blocks at least where there are enough sets.
BLOCK, BLOCKS = 32_768, 32
#: A block's largest size by its smallest, about, where it has enough sets.
SPAN = 1.2
#: Words of 64 bits of a set's parity bits at most; one for each 16 tokens and up to twice as many below that.
WORDS = 256
#: Meetings of tokens, and words of parity bits, that a task holds at once, about.
MET, HELD = 1_000_000, 2_000_000

_SIGNED = "node long, n int, prefix array<int>, bits binary"


def _signed(threshold: float):
    """(node, n, w) with tokens' hashes from rare to frequent as (node, n, prefix, bits): the prefix's lower halves, and all upper halves' parity."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int32())), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            w = batch.column("w").flatten().to_numpy()
            row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            at = np.arange(len(w)) - start[row]
            kept = at < (n - np.ceil(n * threshold - 1e-9) + 1)[row]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(n)))])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((w[kept] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)))
            words = np.minimum(WORDS, 2 ** np.ceil(np.log2(np.maximum(1, n / 16))).astype(np.int64))
            first = np.cumsum(words) - words
            bit = first[row] * 64 + ((w >> 32) & (words * 64 - 1)[row])
            odd = np.packbits((np.bincount(bit, minlength=int(words.sum()) * 64) & 1).astype(np.uint8), bitorder="little").tobytes()
            bits = [odd[8 * f : 8 * (f + k)] for f, k in zip(first.tolist(), words.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n, pa.int32()), prefix, pa.array(bits, pa.binary())], schema=schema)

    return run


def _blocks(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, number of blocks) of neighbouring sizes, from (size, number of sets); a size of too many sets has several blocks."""
    most = min(BLOCK, max(1024, sum(c for _, c in counts) // BLOCKS))
    out, held = [], 0
    for n, c in sorted(counts):
        if out and held + c <= most and (n <= out[-1][0] * SPAN or held < most // 8):
            out[-1], held = (out[-1][0], n, 1), held + c
        else:
            out.append((n, n, -(-c // most)))
            held = c
    return out


class _Side:
    """One block's sets in a tile."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.node, self.n = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int32)
        prefix = table.column("prefix").combine_chunks()
        lengths = prefix.value_lengths().to_numpy().astype(np.int64)
        self.w = prefix.flatten().to_numpy()
        self.row = np.repeat(np.arange(len(self.n), dtype=np.int32), lengths)
        # this token and those after it
        self.rest = (self.n[self.row] - (np.arange(len(self.w)) - (np.cumsum(lengths) - lengths)[self.row])).astype(np.int32)
        self.bits = table.column("bits").to_pylist()
        self.words = np.array([len(b) // 8 for b in self.bits])
        self.made: dict[int, np.ndarray] = {}

    def folded(self, words: int) -> np.ndarray:
        """Parity bits in that many words, for sets that have as many or more."""
        if words not in self.made:
            out = np.zeros((len(self.n), words), np.uint64)
            for k in np.unique(self.words[self.words >= words]).tolist():
                rows = np.nonzero(self.words == k)[0]
                of = np.frombuffer(b"".join(self.bits[r] for r in rows.tolist()), np.uint64).reshape(len(rows), k // words, words)
                out[rows] = np.bitwise_xor.reduce(of, axis=1)
            self.made[words] = out
        return self.made[words]


def _candidates(a: _Side, b: _Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b, each pair once, that share a token after which enough are left in both, and whose parity bits differ in few enough."""
    order = np.argsort(b.w, kind="stable")
    bw, brow, brest = b.w[order], b.row[order], b.rest[order]
    left = np.searchsorted(bw, a.w, "left")
    times = np.searchsorted(bw, a.w, "right") - left
    # parts of whole rows of a, so that a pair lies in one of them
    total = np.cumsum(times)
    ends = np.nonzero(np.diff(a.row, append=-1))[0] + 1
    low = 0
    while low < len(a.w):
        reach = (total[low - 1] if low else 0) + MET
        k = np.searchsorted(total[ends - 1], reach, "right")
        high = int(ends[k - 1]) if k and ends[k - 1] > low else int(ends[np.searchsorted(ends, low, "right")])
        t = times[low:high]
        at = np.repeat(np.arange(low, high), t)
        to = np.arange(len(at)) - np.repeat(np.cumsum(t) - t, t) + left[at]
        ra, rb = a.row[at], brow[to]
        na, nb = a.n[ra], b.n[rb]
        near = np.minimum(a.rest[at], brest[to]) >= (na + nb) * (threshold / (1 + threshold)) - 1e-6
        near &= np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9
        if a is b:
            near &= ra < rb
        code = np.unique(ra[near].astype(np.int64) * len(b.n) + rb[near])
        ra, rb = code // len(b.n), code % len(b.n)
        words = np.minimum(a.words[ra], b.words[rb])
        for w in np.unique(words).tolist():
            of = np.nonzero(words == w)[0]
            fa, fb = a.folded(w), b.folded(w)
            step = max(1, HELD // w)
            for i in range(0, len(of), step):
                x, y = ra[of[i : i + step]], rb[of[i : i + step]]
                apart = np.bitwise_count(fa[x] ^ fb[y]).sum(axis=1, dtype=np.int64)
                like = apart <= (a.n[x] + b.n[y]) * ((1 - threshold) / (1 + threshold)) + 1e-6
                yield x[like], y[like]
        low = high


def _met(threshold: float):
    """A tile's rows as (tile, a, b) of nodes that may be similar."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        a = _Side(table.filter(pa.array(~second)))
        b = _Side(table.filter(pa.array(second))) if not table.column("own")[0].as_py() else a
        found = [(a.node[x], b.node[y]) for x, y in _candidates(a, b, threshold)]
        x, y = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
        return pa.table({"tile": np.full(len(x), key[0].as_py(), np.int32), "a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _common(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """A tile's pairs (a, b) with both sizes and the number of tokens in common, from the tile's (node, tokens)."""
    node, lists = sets.column("node").to_numpy(), sets.column("tokens").combine_chunks()
    n = lists.value_lengths().to_numpy().astype(np.int64)
    start, code = np.cumsum(n) - n, lists.flatten().dictionary_encode().indices.to_numpy()
    by = np.argsort(node)
    a, b = (by[np.searchsorted(node, pairs.column(c).to_numpy(), sorter=by)] for c in "ab")
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    held, k = np.zeros(code.max(initial=0) + 1, bool), np.zeros(len(a), np.int64)
    for first, last in zip(*(np.nonzero(np.diff(a, **{side: -1}))[0] for side in ("prepend", "append")), strict=True):
        own = code[start[a[first]] : start[a[first]] + n[a[first]]]
        held[own] = True
        parts = np.cumsum(n[b[first : last + 1]]) // MET
        for i, j in zip(*(np.nonzero(np.diff(parts, **{side: -1}))[0] for side in ("prepend", "append")), strict=True):
            y = b[first + i : first + j + 1]
            ends = np.cumsum(n[y])
            at = np.arange(ends[-1]) + np.repeat(start[y] - (ends - n[y]), n[y])
            k[first + i : first + j + 1] = np.add.reduceat(held[code[at]].astype(np.int64), ends - n[y])
        held[own] = False
    return pa.table({"a": node[a], "b": node[b], "na": n[a].astype(np.int32), "nb": n[b].astype(np.int32), "k": k.astype(np.int32)})


def jaccard_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (id, tokens) as (a, b, jaccard) for pairs with a < b and a Jaccard similarity of threshold or more.

    Equal sets are compared once, as one class, and its rows are put in at the end.
    Sets lie in blocks of like sizes, and blocks whose sizes can be similar meet in tiles.
    Prefix filter: with tokens ordered from rare to frequent, the first token that two similar sets share leaves enough tokens in both: together
    with those after it, at least threshold / (1 + threshold) of both sizes. So of each set only the tokens go to a tile that leave
    enough for its smallest partner there, and pairs for which no shared token leaves enough are not compared.
    Parity filter: each token flips one bit of its set. Bits that two sets don't have in common are at most the tokens that
    they don't have in common, so pairs with more of them than similar sets can have go within the tile, before anything is
    shuffled. Tokens are known by hashes up to there; what is left is compared by the tokens themselves.
    """
    sets = rows.select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    members = storage.written(sets.select("id", F.md5(F.to_json("tokens").cast("binary")).alias("key"), "tokens"), "sets")
    classes = members.filter(F.size("tokens") > 0).groupBy("key").agg(F.first("tokens").alias("tokens")).withColumn("node", F.monotonically_increasing_id())
    classes = storage.written(classes, "classes")
    members = storage.written(members.select("id", "key").join(classes.select("key", "node"), "key").select("id", "node"), "members")
    sets = classes.select("node", "tokens")

    words = sets.select("node", F.explode(F.transform("tokens", lambda w: F.xxhash64(w))).alias("w"))
    frequency = words.groupBy("w").agg(F.count("*").cast("int").alias("df"))
    # dealt by set before they are gathered: half-made lists would be shuffled otherwise
    ordered = words.join(frequency, "w").repartition("node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
    signed = storage.written(ordered.select("node", F.size("s").alias("n"), F.col("s.w").alias("w")).mapInArrow(_signed(threshold), _SIGNED), "signed")
    pairs = storage.written(_tiles(signed, threshold).groupBy("tile").applyInArrow(_met(threshold), "tile int, a long, b long"), "pairs")

    # a set is sent once to a tile, however many pairs it has there
    needed = pairs.select(F.col("tile").alias("at"), F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node").select("at", "node", "tokens")
    found = pairs.groupBy("tile").cogroup(needed.groupBy("at")).applyInArrow(_common, "a long, b long, na int, nb int, k int")
    score = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    found = storage.written(found.filter(score >= threshold).select("a", "b", F.round(score, 6).alias("jaccard")), "similar")
    row = lambda x: members.select(F.col("node").alias(x), F.col("id").alias(f"id_{x}"))
    across = found.join(row("a"), "a").join(row("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard").filter("a < b")
    several = members.groupBy("node").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("node").alias("a"))
    copies = row("a").join(several, "a", "left_semi").join(row("b"), F.col("a") == F.col("b")).filter("id_a < id_b")
    return across.unionByName(copies.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(1.0).alias("jaccard")))


def _tiles(signed: DataFrame, threshold: float) -> DataFrame:
    """signed once for each tile of two blocks that its block is in: (tile, own, second, node, n, prefix, bits); own: both blocks are one."""
    spark = signed.sparkSession
    counts = [(r["n"], r["count"]) for r in signed.groupBy("n").count().collect()]  # no more than the largest set has tokens
    sizes, blocks = [], []
    for low, high, parts in _blocks(counts):
        sizes += [(n, len(blocks), parts) for n, _ in counts if low <= n <= high]
        blocks += [(low, high)] * parts
    tiles, k = [], 0
    for i, (low, high) in enumerate(blocks):
        for j in range(i, len(blocks)):
            if high >= blocks[j][0] * threshold - 1e-9:
                tiles.append((i, k, i == j, False, *blocks[j]))
                tiles += [(j, k, False, True, low, high)] if i < j else []
                k += 1
    sizes = spark.createDataFrame(sizes, "n int, first int, parts int")
    tiles = spark.createDataFrame(tiles, "block int, tile int, own boolean, second boolean, low int, high int")
    placed = signed.join(F.broadcast(sizes), "n").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("node"), "parts")).cast("int"))
    rows = placed.join(F.broadcast(tiles), "block").filter((F.col("high") >= F.col("n") * threshold - 1e-9) & (F.col("n") >= F.col("low") * threshold - 1e-9))
    least = F.greatest(F.col("low"), F.ceil(F.col("n") * threshold - 1e-9))
    kept = F.col("n") - F.ceil((F.col("n") + least) * (threshold / (1 + threshold)) - 1e-6) + 1
    rows = rows.withColumn("kept", kept.cast("int")).filter("kept > 0")
    return rows.select("tile", "own", "second", "node", "n", F.slice("prefix", F.lit(1), F.col("kept")).alias("prefix"), "bits")
