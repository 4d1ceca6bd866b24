"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

The encoder reads one byte at a time. A state is the last token that is certain and the bytes after it whose cut is still
open; a transition appends a byte, finds the one token that can end there, and emits the tokens that every possible
continuation shares. A continuation can reach back only over bytes that are a proper prefix of a token, so at most
`longest token` bytes stay open: bounded lookahead. States and transitions are made when first met and then reused.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _pretokens
from ._bpe import MAX_PAIRS, Vocabulary, vocabulary
from ._common import Remembered, bounded_batches, lean, slices, string_buffer, table, worker_table

RANKS = "byte_bpe_50k.tiktoken"
MAX_STATES = 400_000
#: Bytes of encoded pieces that a worker remembers.
MAX_BYTES = 128 << 20
#: Bytes of text taken at once.
STEP = 1 << 20


class Transducer:
    """Encodes pieces of bytes to token ids, little-endian unsigned 32-bit."""

    def __init__(self, vocab: Vocabulary, max_states: int = MAX_STATES):
        self.vocab, self.max_states = vocab, max_states
        self.prefixes = {t[:k] for t in vocab.ranks for k in range(1, len(t))}
        self.word = [i.to_bytes(4, "little") for i in range(len(vocab.tokens))]
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.steps: list[dict[int, tuple[int, bytes]]] = []
        self.words: dict[bytes, bytes] = {}
        self.rest: list[bytes | None] = []
        self.open: list[tuple] = []
        self.state(-1, b"", (-1,), b"\0", b"\0")

    def matters(self, last: int, text: bytes) -> list[int]:
        """The parts of `last` that could still merge with the bytes after it, each with the rank that uses it up.

        Two tokens that agree in this go with the same tokens, so their states are one.
        """
        if last < 0 or not text:
            return [last]
        vocab, found = self.vocab, []
        spine = vocab.spines(last)[1]
        for i, r in enumerate(spine):
            part = vocab.tokens[r]
            if part + text in self.prefixes or any(part + text[:k] in vocab.ranks for k in range(1, len(text) + 1)):
                found += (r, spine[i + 1] if i + 1 < len(spine) else -1)
        return found

    def state(self, last: int, text: bytes, tokens: tuple, starts: bytes, live: bytes) -> int:
        """last: the token before the open bytes; tokens[k], starts[k]: the token that ends k bytes into them, and where it starts; live: where a token may start that is not complete."""
        key = array("i", [*self.matters(last, text), -2]).tobytes() + text
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.steps)
            self.steps.append({})
            self.rest.append(None)
            self.open.append((last, text, tokens, starts, live))
        return got

    def step(self, s: int, byte: int) -> tuple[int, bytes]:
        last, text, tokens, starts, live = self.open[s]
        text += bytes((byte,))
        n, ranks, adjacent, prefixes = len(text), self.vocab.ranks, self.vocab.adjacent, self.prefixes
        for k in live:
            t = ranks.get(text[k:])
            if t is not None:
                before = tokens[k] if k else last
                if before < 0 or adjacent(before, t):
                    break
        tokens, starts = [*tokens, t], [*starts, k]
        live = [k for k in live if text[k:] in prefixes]
        root = n
        for k in live:  # the last cut that all live ones share
            while k != root:
                if k > root:
                    k = starts[k]
                else:
                    root = starts[root]
        live.append(n)
        emitted, k = [], root
        while k > 0:
            emitted.append(self.word[tokens[k]])
            k = starts[k]
        if root:
            last, text = tokens[root], text[root:]
            tokens, starts, live = tokens[root:], [max(0, k - root) for k in starts[root:]], [k - root for k in live]
        word = b"".join(emitted[::-1])
        got = self.steps[s][byte] = self.state(last, text, tuple(tokens), bytes(starts), bytes(live)), self.words.setdefault(word, word)
        return got

    def encode(self, piece: bytes) -> bytes:
        if len(self.steps) > self.max_states:
            self.clear()
        s, out, steps = 0, [], self.steps
        for a in range(0, len(piece), 4096):
            if len(steps) > self.max_states:  # within a very long piece: only the state it is in goes on
                now = self.open[s]
                self.clear()
                s, steps = self.state(*now), self.steps
            for c in piece[a : a + 4096]:
                s, emitted = steps[s].get(c) or self.step(s, c)
                if emitted:
                    out.append(emitted)
        if (rest := self.rest[s]) is None:
            _, text, tokens, starts, _ = self.open[s]
            back, k = [], len(text)
            while k > 0:
                back.append(self.word[tokens[k]])
                k = starts[k]
            rest = self.rest[s] = b"".join(back[::-1])
        out.append(rest)
        return b"".join(out)


class Pieces(Remembered):
    """Encoded pieces met so far."""

    def __init__(self, transducer: Transducer, most: int = MAX_BYTES):
        super().__init__(most)
        self.transducer = transducer

    def __missing__(self, piece: bytes) -> bytes:
        got = self.transducer.encode(piece)
        return self.keep(piece, got, len(piece) + len(got))


class Utf8Stream:
    """Incremental UTF-8: a state machine over (bytes still expected, allowed range of the next byte).

    `feed` returns the text that is complete so far. A sequence that is not UTF-8 becomes one U+FFFD per longest wrong prefix.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def incomplete(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
                if back >= need:
                    return 0
                if back > 1:
                    low = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
                    high = 0x9F if b == 0xED else 0x8F if b == 0xF4 else 0xBF
                    if not low <= data[-back + 1] <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes, end: bool = False) -> str:
        data = self.held + data
        cut = len(data) if end else len(data) - self.incomplete(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class Codec:
    """Text to token ids and back, by one vocabulary of ranks; special tokens are ordinary text."""

    def __init__(self, path: str, max_states: int = MAX_STATES, max_bytes: int = MAX_BYTES):
        self.vocab = vocabulary(path)
        self.vocab.max_pairs = min(MAX_PAIRS, 3 * max_states // 2)
        self.transducer = Transducer(self.vocab, max_states)
        self.pieces = Pieces(self.transducer, max_bytes)

    def encode_many(self, column: pa.Array) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        found, at = _pretokens.pieces(*string_buffer(column))
        ids = list(map(self.pieces.__getitem__, found))
        for a, b in zip(at, at[1:]):
            yield b"".join(ids[a:b])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_many(pa.array([text]))), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text as it becomes complete, however the ids fall into chunks."""
        state, held = Utf8Stream(), []
        for i in ids:
            held.append(self.vocab.tokens[i])
            if len(held) == chunk:
                yield state.feed(b"".join(held))
                held.clear()
        yield state.feed(b"".join(held), end=True)

    def decoded_many(self, encoded: list[bytes]) -> Iterator[bytes]:
        """The UTF-8 bytes of each text, decoded by the stream."""
        tokens = self.vocab.tokens
        for ids in encoded:
            state, values, out = Utf8Stream(), np.frombuffer(ids, "<u4").tolist(), []
            for a in range(0, len(values), 1 << 16):
                out.append(state.feed(b"".join(map(tokens.__getitem__, values[a : a + (1 << 16)]))))
            out.append(state.feed(b"", end=True))
            yield "".join(out).encode()


@worker_table
def codec(path: str, max_states: int = MAX_STATES, max_bytes: int = MAX_BYTES) -> Codec:
    return Codec(path, max_states, max_bytes)


def encoded(docs: DataFrame, path: str | None = None, max_states: int = 70_000, max_bytes: int = 48 << 20) -> DataFrame:
    """doc_id, token_ids (array<int>), text (decoded back) of every document.

    max_states (of bounded size) and max_bytes bound what a worker remembers, and so its memory; they change no result.

    Null and empty texts have no tokens. Rows are independent: repeated rows and ids give repeated rows, a null id stays
    null, and other columns are not read. An empty table gives an empty table.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        c = codec(path, max_states, max_bytes)
        for batch in batches:
            for part in slices(batch, 1, STEP):
                ids = list(c.encode_many(part.column(1)))
                lengths = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                texts = pa.array([b.decode() for b in c.decoded_many(ids)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), tokens, texts], names=["doc_id", "token_ids", "text"])

    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(run, "codec"), "doc_id long, token_ids array<int>, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the sha256 of the ids and of the decoded bytes; rules as for `encoded`, which holds the values."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        c, sha = codec(path), hashlib.sha256
        for batch in batches:
            for part in slices(batch, 1, STEP):
                ids = list(c.encode_many(part.column(1)))
                cols = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                    pa.array([sha(x).hexdigest() for x in c.decoded_many(ids)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean(run, "codec"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
