"""Byte-level BPE vocabularies, and which two tokens may stand side by side."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

from ._common import worker_table


#: Pairs of tokens that a vocabulary remembers; more of them are found anew.
MAX_PAIRS = 400_000


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letter by which vocabulary files write each byte: itself if printable, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes by rank. A token's rank is also its id, and the merge of lowest rank goes first, from the left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.longest = max(map(len, ranks))
        self._spines: dict[int, tuple[list[int], list[int]]] = {}
        self._pairs: dict[int, bool] = {}
        self.max_pairs = MAX_PAIRS

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A .tiktoken file of ranks, or a tokenizers .json of a byte-level BPE model."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                vocab = json.load(f)["model"]["vocab"]
            letters = byte_letters()
            return cls({bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)})
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})

    def merges(self, text: bytes, below: int) -> list[int]:
        """The tokens of text once all merges of rank under `below` are done."""
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def spines(self, token: int) -> tuple[list[int], list[int]]:
        """What stands at the left and at the right edge while the token is put together, from a byte to the token itself."""
        got = self._spines.get(token)
        if got is None:
            if len(self.tokens[token]) == 1:
                got = [token], [token]
            else:
                parts = self.merges(self.tokens[token], token)
                got = [*self.spines(parts[0])[0], token], [*self.spines(parts[-1])[1], token]
            self._spines[token] = got
        return got

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the text of a and then b is encoded as just these two.

        At any time one part touches the border from each side. A merge across it happens if its rank comes before the
        rank that uses up the part on the left, and not after the one that uses up the part on the right.
        """
        key = a << 32 | b
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > self.max_pairs:
                self._pairs.clear()
            left, right = self.spines(a)[1], self.spines(b)[0]
            i = j = 0
            got = True
            never = len(self.tokens)
            while True:
                next_i = left[i + 1] if i + 1 < len(left) else never
                next_j = right[j + 1] if j + 1 < len(right) else never
                across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]])
                if across is not None and across < next_i and across <= next_j:
                    got = False
                    break
                if next_i == next_j == never:
                    break
                if next_i <= next_j:
                    i += 1
                else:
                    j += 1
            self._pairs[key] = got
        return got


@worker_table
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)
