"""64-bit hashes of the words and word shingles of whole texts, vectorised over Arrow batches.

A word's hash is a polynomial over its bytes, read off one running sum over
the buffer of many texts, so no Python object is made per word.  Words are
runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``, which are never part of a
longer UTF-8 character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 22          # texts are taken together up to so many bytes
PIECE = 1 << 20          # bytes hashed at once; a longer word makes a longer piece
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_BYTES = _constants(256, 1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_PLACES = _constants(64, 2) | np.uint64(1)
_SIZES = _constants(2, 3) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i below ``n``, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of at most ``CHUNK`` bytes, or one text (null: empty)."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every word, in order; ``lower`` takes A-Z as a-z."""
    table = _LOWER if lower else _BYTES
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    out, starts, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        while hi < len(data):
            upto = min(hi + PIECE, len(data))
            cut = blank[hi:upto] | edge[hi:upto]
            k = int(np.argmax(cut))
            if cut[k]:
                hi += k
                break
            hi = upto
        word = ~blank[lo:hi]
        first, last = word.copy(), word.copy()
        first[1:] &= blank[lo:hi - 1] | edge[lo + 1:hi]
        last[:-1] &= blank[lo + 1:hi] | edge[lo + 1:hi]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        out.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _SIZES[0]))
        starts.append(s + lo)
        lo = hi
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.searchsorted(offsets, np.concatenate(starts), side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): lower-cased shingles of ``size`` words of every text, repeats included; text i has
    hashes[bounds[i]:bounds[i + 1]].  A text of fewer words has its whole sequence as one."""
    word, text = words(data, offsets, lower=True)
    n = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    short = np.flatnonzero((n > 0) & (n < size))
    bounds = np.concatenate([[0], np.cumsum(np.where(n >= size, n - size + 1, np.minimum(n, 1)))])
    out = np.empty(bounds[-1], np.uint64)
    whole = np.ones(len(out), bool)
    whole[bounds[short]] = False
    windows = len(word) - size + 1
    if windows > 0:
        total = np.repeat(np.array([size], np.uint64) * _SIZES[1], windows)
        for k in range(size):
            total += word[k:windows + k] * _PLACES[k]
        out[whole] = mix(total[text[:windows] == text[size - 1:]])
    if len(short):
        total = n[short].astype(np.uint64) * _SIZES[1]
        for k in range(size - 1):
            has = n[short] > k
            total[has] += word[first[short[has]] + k] * _PLACES[k]
        out[bounds[short]] = mix(total)
    return out, bounds
