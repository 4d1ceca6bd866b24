"""Vectorised word and shingle hashes of whole Arrow string columns.

Words are the runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. All delimiters are ASCII, so bytes and code
points cut alike. A word's hash is a difference of prefix sums of a polynomial hash, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._common import slices, string_buffer

WIDTH = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_MULT = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_DELIM = np.zeros(256, bool)
_DELIM[[0x20, *range(0x09, 0x0E)]] = True
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers from 0 on, at least n of them, modulo 2^64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.cumprod(got, dtype=np.uint64)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_DELIM[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:]))
    p = _power(_P, n)
    total = np.cumsum(_BYTE[data] * p[:n], dtype=np.uint64)
    low = total[start] - _BYTE[data[start]] * p[start]
    return mix((total[end] - low) * _power(_P_INVERSE, n)[start]), np.searchsorted(start, offsets)


def windows(words: np.ndarray, at: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of `width` words from each word on; near the end of a text it reaches into the next and does not count."""
    n = max(0, len(words) - width + 1)
    rolled = words[:n] * _MULT[0]
    for k in range(1, width):
        rolled = rolled + words[k : n + k] * _MULT[k]
    return mix(rolled)


def short_hash(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The one shingle of a text of fewer words than `width`."""
    n = len(words)
    return mix((words * _MULT[width : width + n]).sum(keepdims=True, dtype=np.uint64) + _MULT[2 * width + n : 2 * width + n + 1])


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles of `width` words.

    A text of fewer words has its whole sequence as one shingle; a null, empty or blank text has none.
    """
    words, at = word_hashes(*string_buffer(texts))
    rolled = windows(words, at, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield short_hash(words[a:b], width)
        else:
            yield words[:0]


def sets_of(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batch cut in steps of bounded bytes, with the shingle set of each row."""
    for part in slices(batch, text):
        yield part, list(shingle_sets(part.column(text)))
