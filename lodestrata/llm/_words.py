"""Words of whole Arrow string columns as byte spans with 64-bit hashes; the delimiters are a table of ASCII bytes."""

from __future__ import annotations

import numpy as np

from ._shingles import _BYTE, _P, _P_INVERSE, _power, mix


def byte_set(*bytes_: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


#: Values of bytes in a hash: letters keep their case, or A-Z count as a-z.
CASED = _BYTE.copy()
CASED[65:91] = mix(np.arange(65, 91, dtype=np.uint64)) | np.uint64(1)
LOWERED = _BYTE


def spans(data: np.ndarray, offsets: np.ndarray, delim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every maximal run of bytes that are no delimiters, within the texts that offsets cut."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~delim[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    start = np.flatnonzero(inside & (change | edge[:n]))
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = change[1:]
    return start, np.flatnonzero(inside & (last | edge[1:])) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = CASED) -> np.ndarray:
    """A hash of the bytes of every span (none may be empty), by differences of running sums of a polynomial."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    p = _power(_P, n)
    total = np.cumsum(value[data] * p[:n], dtype=np.uint64)
    low = total[start] - value[data[start]] * p[start]
    return mix((total[end - 1] - low) * _power(_P_INVERSE, n)[start])
