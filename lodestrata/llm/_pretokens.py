"""The byte-level pre-tokeniser as array operations on UTF-8 buffers.

It cuts as the public pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` does: runs of one
character class, a space that joins the run after it, and the seven contractions where a piece starts with the apostrophe.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

_OTHER, _LETTER, _DIGIT, _SPACE = 0, 1, 2, 3


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    at = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[at[m.start()] : at[m.end() - 1] + 1] = kind
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, runs: list | None = None) -> np.ndarray:
    """Ascending byte positions at which pieces start, and the end of data.

    runs: gets the byte positions of each run of two or more white-space characters before other text, first and end.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    head = data[lead]
    kinds = classes()
    kind = kinds[:256][np.where(head < 0x80, head, 0)]
    wide = np.flatnonzero(head >= 0xC0)
    if len(wide):
        at = lead[wide]
        more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
        b = head[wide].astype(np.uint32)
        two, three = (b & 0x1F) << 6 | more[at + 1], (b & 0x0F) << 12 | more[at + 1] << 6 | more[at + 2]
        four = (b & 0x07) << 18 | more[at + 1] << 12 | more[at + 2] << 6 | more[at + 3]
        kind[wide] = kinds[np.where(b < 0xE0, two, np.where(b < 0xF0, three, four)) % 0x110000]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offsets)] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # a run of white space before other text: its last character stands alone, and a space joins what follows
    e = np.flatnonzero(start[1:n] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]) + 1
    if runs is not None and len(e):
        began = np.flatnonzero(start)
        s = began[np.searchsorted(began, e) - 1]
        runs += zip(lead[s[e - s > 1]].tolist(), lead[e[e - s > 1]].tolist())
    start[e - 1] = True
    start[e[head[e - 1] == 0x20]] = False
    # contractions
    q = np.flatnonzero((head == 0x27) & start[:n])
    q = q[~first[q + 1]]
    if len(q):
        ends = np.concatenate([head, np.zeros(2, np.uint8)])
        one, two = ends[q + 1], np.where(first[np.minimum(q + 2, n)], 0, ends[q + 2])
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
        for found, size in ((q[short], 2), (q[long & ~short], 3)):
            start[found + 1] = False
            start[found + size] = True
    return np.append(lead[np.flatnonzero(start[:n])], len(data))


def pieces(data: np.ndarray, offsets: np.ndarray, runs: list | None = None) -> tuple[list[bytes], list[int]]:
    """All pieces of all texts in order, and for each text the index of its first piece (one more at the end)."""
    at = cuts(data, offsets, runs)
    raw, ends = data.tobytes(), at.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])], np.searchsorted(at, offsets).tolist()
