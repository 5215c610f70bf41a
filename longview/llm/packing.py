"""Packing documents into windows by minimum bin slack.

Documents are tokenised and cut at multiples of the window; what is left of each is a piece shorter than a
window. The pieces' lengths form a histogram of at most `window` entries, whatever the corpus's size, and the
plan is made on it: for the longest length left, a bitset subset-sum picks the multiset of remaining lengths
that fills the window closest to its capacity, backtracking yields the counts, and the filling is repeated as
often as the histogram allows. Lengths with no exact filling are laid end to end and cut at the windows'
ends; the last, incomplete window is cut into powers of two, which need no padding.

A piece's window follows from its length and its rank among the pieces of that length, so no piece is
compared with another and no length, however frequent, is gathered in one task: ranks are counted within
each task and shifted by the totals of the tasks before it.

Defined results: a null text is an empty one, which is the end token alone; a null id stays null; repeated
rows are separate documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ._common import materialize, read

WINDOW = 2048
END = 1
#: Cut pieces are joined to their texts by broadcast up to this many, by shuffle beyond.
FEW = 100_000


# fixed values: the normaliser and pre-tokenizer that the piece-wise path below reproduces
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
# fixed values: code points that are composed already and lower-case one by one: Latin, Cyrillic, general
# punctuation, currency, kana without marks, Han; a text with any other goes to the tokenizer
_PLAIN = [(0x01, 0x1B), (0x20, 0x84), (0x86, 0x9F), (0xA1, 0x12F), (0x131, 0x24F), (0x400, 0x482), (0x48A, 0x4FF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5)]
_BLANK = b" \t\n\r\x0b\x0c"
_WIDE = re.compile("[^\x00-\xff]")
_ODD, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)


def _byte_marks() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by stand-in."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _classes() -> np.ndarray:
    """The class of each code point: a letter, a number, white space, another, or odd (not plain)."""
    out = np.zeros(0x110000, np.uint8)
    for lo, hi in _PLAIN:
        for c in range(lo, hi + 1):
            kind = unicodedata.category(chr(c))
            if c in (9, 10, 11, 12, 13, 32):
                out[c] = _SPACE
            elif kind != "Cn" and kind[0] != "M" and unicodedata.is_normalized("NFC", chr(c)):
                out[c] = {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
    for c in np.flatnonzero(out).tolist():
        low = chr(c).lower()
        if len(low) != 1 or out[ord(low)] != out[c]:
            out[c] = _ODD
    return out


def ranks(path: str, check: bool = True) -> tuple[dict[bytes, int], np.ndarray] | None:
    """The merges of a word-end vocabulary as ranks of byte strings, where a zero byte marks a word's end, and the
    token id of each rank; None where the file is of another kind.

    Merging the adjacent parts whose joined bytes rank lowest gives what the list of merges gives, provided that
    each entry is made by one merge only and is reached from its own bytes, which `check` makes sure of.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split = pre[0].get("type") == "Split" and pre[0].get("pattern") == {"Regex": _SPLIT} and pre[0].get("behavior") == "Removed" and pre[0].get("invert")
    known = split and len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex") and (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZER
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not (known and plain):
        return None
    marks, vocabulary = _byte_marks(), model["vocab"]

    def raw(token: str) -> bytes:
        word = token.endswith("</w>")
        return bytes(marks[c] for c in (token[:-4] if word else token)) + b"\0" * word

    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    table, ids = {}, np.zeros(512 + len(merges), np.uint32)
    try:
        for c, b in marks.items():
            table[bytes([b])], ids[b] = b, vocabulary[c]
            if b:
                table[bytes([b, 0])], ids[256 + b] = 256 + b, vocabulary[c + "</w>"]
        for k, (x, y) in enumerate(merges):
            joined = raw(x) + raw(y)
            if joined in table or raw(x) not in table or raw(y) not in table:
                return None
            table[joined], ids[512 + k] = 512 + k, vocabulary[x + y]
    except KeyError:
        return None
    parts = {raw(x) + raw(y): (raw(x), raw(y)) for x, y in merges} if check else {}
    for token in parts:
        end = token[-1:] == b"\0"
        body = [bytes([b]) for b in (token[:-1] if end else token)]
        if end:
            body[-1] += b"\0"
        while len(body) > 1:
            low, at = min((table.get(x + y, len(ids)) if parts.get(x + y) == (x, y) else len(ids), i) for i, (x, y) in enumerate(zip(body, body[1:], strict=False)))
            if low == len(ids):
                return None
            body[at : at + 2] = [body[at] + body[at + 1]]
    return table, ids


class WordIds:
    """Token ids of whole texts.

    Where the file's kind is known (`ranks`), the texts of a batch are joined, cut into the pre-tokenizer's pieces by
    comparing the classes of neighbouring code points, and each distinct piece is merged once; a text that holds
    a code point outside the plain ones, or the beginning of a special token, goes to the tokenizer as it is.
    So does every text where the file is of another kind. Nothing is kept from one batch to the next.
    """

    #: Texts are tokenised in batches of about this many characters; a longer text is a batch by itself.
    BATCH = 1 << 22
    #: Pieces of more bytes than this go to the tokenizer, whose time follows their length.
    LONG = 400
    _workers: dict[str, dict] = {}

    def __init__(self, path: str, known: bool = True):
        self.__dict__ = self._workers.setdefault(f"{path} {known}", {})
        if not self.__dict__:
            self._start(path, known)

    def _start(self, path: str, known: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = None
        found = ranks(path, check=False) if known else None
        if found:
            import tiktoken

            self.merger = tiktoken.Encoding("ranks", pat_str=r"[^\x00]*\x00", mergeable_ranks=found[0], special_tokens={})
            self.of_rank = found[1]
            self.ends = np.zeros(len(found[1]), bool)
            self.ends[[r for b, r in found[0].items() if b[-1] == 0 and len(b) > 1]] = True
            self.classes = _classes()
            self.latin_class = self.classes[:256].tobytes()
            self.latin_lower = bytes(ord(chr(c).lower()) if self.classes[c] else c for c in range(256))
            edges = np.flatnonzero(np.diff((self.classes != _ODD).astype(np.int8))).tolist()  # plain from one after each first to each second
            self.odd = re.compile("[^" + "".join(f"{re.escape(chr(lo + 1))}-{re.escape(chr(hi))}" for lo, hi in zip(edges[::2], edges[1::2], strict=True)) + "]")

    def _tokenized(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, texts: list[str], latin: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of plain code points in a row, and the number of each text's; latin: all below 256."""
        joined = "\n".join([*texts, ""])
        if latin:
            low = joined.encode("latin-1").translate(self.latin_lower)
            points, kind = np.frombuffer(low, np.uint8), np.frombuffer(low.translate(self.latin_class), np.uint8)
            joined = low.decode("latin-1")
            width = points > 0x7F
        else:
            joined = joined.lower()
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            kind = self.classes[points]
            width = (points > 0x7F).astype(np.int8) + (points > 0x7FF)
        new = np.empty(len(kind), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == _NUMBER
        new[1:] |= points[:-1] == 10  # a text's end is a piece's
        for at in np.flatnonzero((points == 39) & new).tolist():
            tail = joined[at + 1 : at + 3]
            size = next((len(x) for x in _SUFFIXES if tail.startswith(x)), 0)
            if size:  # an apostrophe that begins a piece takes a suffix along, and what follows begins anew
                new[at + 1] = False
                new[at + 1 + size] = True
        starts = np.flatnonzero(new)
        bounds = np.append(starts, len(points))
        if not joined.isascii():
            bounds += np.concatenate(([0], np.cumsum(width, dtype=np.int32)))[bounds]  # places in UTF-8
        full = kind[starts] != _SPACE
        places = np.zeros(int(full.sum()) + 1, np.int32)
        np.cumsum(np.diff(bounds)[full], out=places[1:])
        rows = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(joined.encode().translate(None, _BLANK))]).dictionary_encode()
        ids, first, count = self._distinct(rows.dictionary)
        row = rows.indices.to_numpy()
        n = count[row]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        flat = ids[np.repeat(first[row] - total[:-1], n) + np.arange(total[-1])]
        before = np.concatenate(([0], np.cumsum(full)))
        ends = np.cumsum([len(t) + 1 for t in texts])  # lower-casing keeps a plain text's length
        return flat, np.diff(total[before[np.searchsorted(starts, ends)]], prepend=0)

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces in a row, and the place of each piece's first and their number."""
        long = pc.greater(pc.binary_length(pieces), self.LONG)
        some = pc.any(long).as_py()
        short = pieces.filter(pc.invert(long)) if some else pieces
        ids, count = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(short):
            got = self.merger.encode_to_numpy((pc.binary_join(pa.ListArray.from_arrays([0, len(short)], short), b"\0")[0].as_py() + b"\0").decode())
            ids, count = self.of_rank[got], np.diff(np.flatnonzero(self.ends[got]), prepend=-1)
        if some:
            at = long.to_numpy(zero_copy_only=False)
            extra = self._tokenized([x.as_py().decode() for x in pieces.filter(long)])
            all_ = np.zeros(len(pieces), np.int64)
            all_[~at], all_[at] = count, [len(x) for x in extra]
            first = np.zeros(len(pieces), np.int64)
            first[~at] = np.cumsum(count) - count
            first[at] = len(ids) + np.cumsum(all_[at]) - all_[at]
            return np.concatenate([ids, *extra]), first, all_
        return ids, np.cumsum(count) - count, count

    def batch(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids in a row, each with the end token, and the number of each text's."""
        texts = [t or "" for t in texts]
        groups: list[list[int]] = [[], [], []]
        for k, t in enumerate(texts):
            groups[2 if self.merger is None or self.odd.search(t) or any(x in t for x in self.special) else 0 if t.isascii() or not _WIDE.search(t) else 1].append(k)
        got = [(group, *self._plain([texts[k] for k in group], latin)) for group, latin in zip(groups, (True, False), strict=False) if group]
        if groups[2]:
            others = self._tokenized([texts[k] for k in groups[2]])
            got.append((groups[2], np.concatenate(others), np.array([len(x) for x in others])))
        n = np.zeros(len(texts), np.int64)
        for group, _, sizes in got:
            n[group] = sizes
        ends = np.cumsum(n + 1)
        out = np.full(int(ends[-1]) if len(n) else 0, END, np.uint32)
        for group, flat, sizes in got:
            out[np.repeat((ends - n - 1)[group] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
        return out, n + 1

    def ids(self, texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids in a row, number of each text's) by batches of about BATCH characters."""
        sizes = np.cumsum([len(t or "") + 1 for t in texts]) // self.BATCH
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield lo, *self.batch(texts[lo:hi])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache
def known_kind(path: str) -> bool:
    """Whether the file's merges can be read as ranks; checked once on the driver."""
    return ranks(path) is not None


def _within(sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's number among those of its size that the task has met, which seen counts."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    first = np.searchsorted(ordered, ordered)
    out = np.empty(len(sizes), np.int64)
    out[order] = np.arange(len(sizes)) - first
    out += seen[sizes]
    seen += np.bincount(sizes, minlength=len(seen))
    return out


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PIECES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("local", pa.int64())])


def _pieces(path: str, known: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = WordIds(path, known), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            doc, key = batch.column("doc_id"), batch.column("row_key")
            for lo, ids, n in words.ids(batch.column("text").to_pylist()):
                per = -(-n // window)
                row = np.repeat(np.arange(len(n)), per)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * window
                size = np.minimum(window, n[row] - start)
                at = ((np.cumsum(n) - n)[row] + start) * 4
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
                took = pa.array(row + lo)
                yield _batch(_PIECES, doc.take(took), key.take(took), start, size, crc, n[row], np.full(len(row), task), _within(size, seen))

    return run


def closest(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of counts' lengths with the largest sum up to target: a bitset of reachable sums, longest
    lengths first, and backtracking over the steps."""
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for size in sorted((s for s, n in counts.items() if n and s <= target), reverse=True):
        left, k = min(counts[size], target // size), 1
        while left:
            k = min(k, left)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & mask
            left -= k
            k *= 2
            if reach >> target & 1:
                break
        if reach >> target & 1:
            break
    at, taken = reach.bit_length() - 1, Counter()
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            at -= size * k
            taken[size] += k
    return dict(taken)


class Plan:
    """Where the rank-th piece of a length goes. Made from the histogram alone."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        self.window = window
        counts = {int(s): int(n) for s, n in histogram.items() if n}
        used: Counter = Counter()
        #: by length: rank from, per window, offset, first window
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        #: by length: rank from, first position in the row of loose pieces
        self.loose: dict[int, tuple[int, int]] = {}
        sequence = position = 0
        while counts:
            top = max(counts)
            counts[top] -= 1
            fill = Counter(closest(counts, window - top))
            counts[top] += 1
            fill[top] += 1
            if sum(s * k for s, k in fill.items()) == window:
                times = min(counts[s] // k for s, k in fill.items())
                offset = 0
                for s, k in fill.items():
                    self.runs.setdefault(s, []).append((used[s], k, offset, sequence))
                    offset += s * k
                    used[s] += k * times
                    counts[s] -= k * times
                    if not counts[s]:
                        del counts[s]
                sequence += times
            else:
                self.loose[top] = (used[top], position)
                position += top * counts.pop(top)
        self.full, self.rest, self.first = position // window, position % window, sequence
        ends, at = [], self.full * window
        for bit in range(window.bit_length(), -1, -1):
            if self.rest >> bit & 1:
                at += 1 << bit
                ends.append(at)
        self.tail = ends

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, sequence, offset, from, size) of the parts of pieces; more than one of a piece that is cut."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        loose = np.zeros(len(length), bool)
        position = np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        sizes, first = np.unique(length[order], return_index=True)
        for s, at in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
            if s in self.loose:
                base, begin = self.loose[s]
                loose[at] = rank[at] >= base
                position[at] = begin + (rank[at] - base) * s
            if s in self.runs:
                base, per, begin, window = np.array(self.runs[s], np.int64).T
                run = np.searchsorted(base, rank[at], "right") - 1
                i = rank[at] - base[run]
                sequence[at], offset[at] = window[run] + i // per[run], begin[run] + i % per[run] * s
        whole = np.flatnonzero(~loose)
        parts = [(whole, sequence[whole], offset[whole], np.zeros(len(whole), np.int64), length[whole])]
        at, end = position.copy(), position + length
        left = np.flatnonzero(loose)
        ends = np.array([self.full * self.window, *self.tail], np.int64)
        while len(left):  # a piece is no longer than a window, so the rounds are few
            in_full = at[left] < ends[0]
            k = np.maximum(0, np.searchsorted(ends, at[left], "right") - 1)
            begin = np.where(in_full, at[left] // self.window * self.window, ends[k])
            stop = np.minimum(end[left], np.where(in_full, begin + self.window, ends[np.minimum(k + 1, len(ends) - 1)]))
            parts.append((left, self.first + np.where(in_full, at[left] // self.window, self.full + k), at[left] - begin, at[left] - position[left], stop - at[left]))
            at[left] = stop
            left = left[stop < end[left]]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_PLACED = pa.schema([(n, pa.int64()) for n in ("doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _place(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = {c: batch.column(c).to_numpy() for c in ("start", "length", "rank")}
            piece, sequence, offset, begin, size = plan.place(number["length"].astype(np.int64), number["rank"])
            took = pa.array(piece)
            cut = pa.array(size != number["length"][piece])
            crc = pc.if_else(cut, None, batch.column("ids_crc32").take(took))
            yield _batch(_PLACED, batch.column("doc_id").take(took), batch.column("row_key").take(took), number["start"][piece] + begin, size, crc, batch.column("doc_tokens").take(took), sequence, offset)

    return run


def _cut_crc(path: str, known: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path, known)
        for batch in batches:
            start, size, crc = batch.column("start").to_numpy(), batch.column("length").to_numpy(), []
            for lo, ids, n in words.ids(batch.column("text").to_pylist()):
                at = (np.cumsum(n) - n + start[lo : lo + len(n)]) * 4
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc += [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + 4 * size[lo : lo + len(n)]).tolist(), strict=True)]
            yield batch.drop_columns(["text"]).append_column("ids_crc32", pa.array(crc, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    known = known_kind(path)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    pieces = materialize(texts.mapInArrow(_pieces(path, known, window), from_arrow_schema(_PIECES)), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    plan = Plan(histogram, window)

    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    base = by_task.selectExpr("length", "task", "coalesce(sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding), 0) as base")
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("local"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = materialize(ranked.select("doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_place(plan), from_arrow_schema(_PLACED)), "placed")

    whole = placed.filter("ids_crc32 is not null").select(columns)
    cut = placed.filter("ids_crc32 is null").drop("ids_crc32")
    few = cut.limit(FEW + 1).count() <= FEW
    wanted = cut.select("row_key").distinct()
    source = texts.select("row_key", "text").join(F.broadcast(wanted) if few else wanted, "row_key").dropDuplicates(["row_key"])
    schema = T.StructType([*cut.schema.fields, T.StructField("ids_crc32", T.LongType())])
    return whole.union(cut.join(source, "row_key").select(*cut.columns, "text").mapInArrow(_cut_crc(path, known), schema).select(columns))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
