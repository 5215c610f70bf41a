"""Word shingles of whole texts as 64-bit hashes, in numpy over many texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Texts are hashed as UTF-8
bytes; white space is ASCII, so words never split a code point.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# one random 64-bit value per byte value keeps short words apart in every bit
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)[_LOWER]


def _slices(data: bytes):
    """Cut points at white space, about every _SLICE bytes."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + _SLICE)
        while end < n and not _SPACE[data[end]]:
            end += 1
        yield at, end
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, byte offset) of each word."""
    hashes, offsets = [], []
    power = np.ones(64, np.uint64)
    power[1:] = _P
    power = np.multiply.accumulate(power)
    for at, end in _slices(data):
        b = np.frombuffer(data, np.uint8, end - at, at)
        word = ~_SPACE[b]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        sizes = ends - starts
        longest = int(sizes.max())
        if longest > len(power):
            power = np.full(longest, _P, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
        inside = np.flatnonzero(word)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        rank = np.arange(len(inside)) - np.repeat(first, sizes)
        values = _BYTE[b[inside]] * power[rank]
        hashes.append(mix(np.add.reduceat(values, first) + sizes.astype(np.uint64)))
        offsets.append(starts + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(offsets)


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, the whole sequence as one;
    without words, empty."""
    encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    h, at = word_hashes(b"\n".join(encoded))
    bounds = np.searchsorted(at, starts)
    out = []
    for i in range(len(encoded)):
        w = h[bounds[i] : bounds[i + 1]]
        n = len(w) - words + 1
        if not len(w):
            out.append(w)
            continue
        k, m = (words, n) if n > 0 else (len(w), 1)
        acc = np.full(m, np.uint64(k))
        for j in range(k):
            acc = mix(acc * _P + w[j : j + m])
        out.append(np.unique(acc))
    return out
