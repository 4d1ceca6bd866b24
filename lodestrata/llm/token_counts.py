"""Exact token counts at every prefix, by dynamic programming over prefixes.

Of the encodings of a byte string under byte-level BPE exactly one has only neighbours that may stand side by side. So the
last token of the prefix of i bytes is the one token t that ends there and may follow the last token of the prefix without
t; its count is that prefix's count plus one. One pass gives the count at every prefix; truncation and budget questions are
then look-ups. The table of a text is the running sum of the tables of its pieces, which are cached.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _pretokens
from ._bpe import Vocabulary, vocabulary
from ._common import Remembered, lean, slices, string_buffer, table, worker_table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of piece tables that a worker remembers.
MAX_BYTES = 128 << 20
#: The one string that the tokenizer file marks as a token of its own.
SPECIAL = b"<|endoftext|>"


class PieceTables(Remembered):
    """For a piece, by how much the count changes with each code point, as 16-bit integers. A bounded cache."""

    def __init__(self, vocab: Vocabulary, most: int = MAX_BYTES):
        super().__init__(most)
        self.vocab = vocab

    def prefix_counts(self, piece: bytes) -> list[int]:
        """The count at each byte prefix, the empty one first."""
        ranks, adjacent, longest = self.vocab.ranks.get, self.vocab.adjacent, self.vocab.longest
        last, count = [-1], [0]
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - longest), i):
                t = ranks(piece[j:i])
                if t is not None and (not j or adjacent(last[j], t)):
                    break
            last.append(t)
            count.append(count[j] + 1)
        return count

    def __missing__(self, piece: bytes) -> bytes:
        count = self.prefix_counts(piece)
        if piece in (b"'re", b"'ve", b"'ll"):  # its first two characters are two pieces
            count[2] = 2
        ends = [i for i in range(1, len(piece) + 1) if i == len(piece) or piece[i] & 0xC0 != 0x80]
        got = np.diff([count[i] for i in [0, *ends]]).astype("<i2").tobytes()
        return self.keep(piece, got, len(piece) + len(got))

    def total(self, piece: bytes) -> int:
        return int(np.frombuffer(self[piece], "<i2").sum(dtype=np.int64))


class Counter:
    def __init__(self, path: str):
        self.tables = PieceTables(vocabulary(path))

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each text the counts of all its non-empty prefixes of code points, special strings being ordinary text."""
        runs: list[tuple[int, int]] = []
        found, at = _pretokens.pieces(data, offsets, runs)
        steps = list(map(self.tables.__getitem__, found))
        out = [np.frombuffer(b"".join(steps[a:b]), "<i2").cumsum(dtype=np.int32) for a, b in zip(at, at[1:])]
        if runs:  # where a prefix ends with a run of white space, the run is one piece
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            texts = np.searchsorted(offsets, [s for s, _ in runs], "right") - 1
            for k, (s, e) in zip(texts.tolist(), runs):
                first = np.searchsorted(lead, offsets[k])
                a, b = np.searchsorted(lead, [s, e]) - first
                out[k][b - 1] = (out[k][a - 1] if a else 0) + self.tables.total(data[s:e].tobytes())
        return out

    def one(self, text: bytes) -> np.ndarray:
        return self.plain(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]

    def with_special(self, text: bytes) -> np.ndarray:
        """As plain for one text, but the special string is one token."""
        *parts, rest = text.split(SPECIAL)
        base, out = 0, []
        for part in parts:
            counts = self.one(part + SPECIAL[:-1]) + base
            whole = len(counts) - len(SPECIAL) + 1
            base = (int(counts[whole - 1]) if whole else base) + 1
            out += [counts, np.array([base], np.int32)]
        return np.concatenate([*out, self.one(rest) + base])

    def many(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = string_buffer(column)
        out = self.plain(data, offsets)
        raw = data.tobytes()
        if SPECIAL in raw:
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if SPECIAL in raw[a:b]:
                    out[k] = self.with_special(raw[a:b])
        return out


@worker_table
def counter(path: str) -> Counter:
    return Counter(path)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and prefix_tokens (array<int>): element i is the token count of the first i code points, from i = 1.

    A null or empty text has an empty array. Rows are independent: repeated rows, repeated or null ids pass through, other
    columns are not read, and an empty table gives an empty table.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        c = counter(path)
        for batch in batches:
            for part in slices(batch, 1):
                counts = c.many(part.column(1))
                ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*counts, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([part.column(0), arrays], names=["doc_id", "prefix_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(run, "counter"), "doc_id long, prefix_tokens array<int>")


def tokens_of_prefix(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """The token count of the first n_chars code points, from the stored counts."""
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(prefix_tokens))
    return F.when(n <= 0, 0).otherwise(F.element_at(prefix_tokens, F.greatest(n, F.lit(1))))


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """The most code points that fit a budget of tokens. Counts may fall as text grows, so it is the last that fits."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def totals(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and chars_in_limit: the most code points whose tokens fit the limit.

    Read off the prefix counts, which are not kept; rules as for `prefix_counts`.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        c = counter(path)
        for batch in batches:
            for part in slices(batch, 1):
                counts = c.many(part.column(1))
                n_bytes = np.diff(string_buffer(part.column(1))[1])
                n_tokens = np.array([int(x[-1]) if len(x) else 0 for x in counts], np.int64)
                fit = [len(x) if n <= limit else int(np.flatnonzero(x <= limit)[-1:].sum() + (x <= limit).any()) for x, n in zip(counts, n_tokens.tolist())]
                cols = [part.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(fit, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(run, "counter"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return totals(table(spark, sf_dir, "documents"))
