"""Token-id output: one Huffman-shaped wavelet matrix a shard.

A shard is one file. Each distinct id has a code of as many bits as its frequency deserves, and the ids are held as bit-planes:
plane k has the k-th code bits of the ids whose codes are longer than k; after each plane the ids are dealt stably, those with
a 0 first, and codes are dealt out so that ids whose code ends there come last and leave. So a file takes about the order-0
entropy of its ids, and with a directory of ones before each block any plane answers rank and select; from these the file
gives any token, the count of a token before a position, and the place of its k-th occurrence, without unpacking.

Layout, little-endian: magic, then ten unsigned 64-bit fields (documents, tokens, symbols, partition, shard, tokens of the
partition before this shard, 4 reserved); document ids (int64) and a byte each that is 1 where the id is null; the end of
each document in tokens (uint64); the symbols by falling code length, ties by id (uint32), and the number of symbols of each
length from 1 to 64 (uint32); for each plane its packed bits, then its directory (uint32). All else follows from these.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from codecs import charmap_decode

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _pretokens
from ._bpe import byte_letters
from ._common import Remembered, lean, scratch_path, slices, string_buffer, table, worker_table, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"LWMX0002"
#: Lengths of codes that a file can tell; 2^44 tokens have none longer.
MAX_LENGTH = 64
BLOCK = 512
#: A shard is closed at this many tokens; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 21
#: Bytes of encoded pieces that a worker remembers.
MAX_BYTES = 160 << 20
SPECIAL = b"<|endoftext|>"
#: Pieces that the library's model gets at once, where they have no more bytes than this together.
TOGETHER = 96
TOGETHER_BYTES = 1 << 13
#: Bytes that no UTF-8 text holds.
NEVER = (0xFF, 0xFE, 0xFD, 0xFC, 0xFB, 0xFA, 0xF9, 0xF8, 0xF7, 0xF6, 0xF5, 0xC1, 0xC0)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Length of each symbol's Huffman code; a lone symbol has one bit. Ties go to the earlier symbol, so equal counts give equal
    lengths whatever the machine."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaf, weight, parent = counts[order].tolist(), [], [0] * (2 * n - 1)
    # two queues, both ascending: leaves, and the nodes that are made of them
    a = b = 0
    for k in range(n - 1):
        total = 0
        for _ in range(2):
            if a < n and (b >= len(weight) or leaf[a] <= weight[b]):
                total, parent[a], a = total + leaf[a], n + k, a + 1
            else:
                total, parent[n + b], b = total + weight[b], n + k, b + 1
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


class Codes:
    """Codes of given lengths for which the ids that end at a plane come last there. symbols: by falling length, ties by id."""

    def __init__(self, symbols: np.ndarray, of_length: np.ndarray):
        self.symbols, self.of_length = symbols, of_length
        self.depth = int(np.flatnonzero(of_length)[-1]) + 1 if of_length.any() else 0
        self.length = np.repeat(np.arange(len(of_length), 0, -1), of_length[::-1])  # of each symbol
        self.code = np.zeros(len(symbols), np.uint64)  # first bit highest of `length`
        nodes = np.zeros(1, np.uint64)  # the prefixes that go on, in the order of the matrix
        end = len(symbols)
        self.leaves: list[np.ndarray] = []  # places in symbols of the codes that end after each plane, in order
        for k in range(self.depth):
            nodes = np.concatenate([nodes << np.uint64(1), nodes << np.uint64(1) | np.uint64(1)])
            n = int(of_length[k])
            at = np.arange(end - n, end)
            self.code[at] = nodes[len(nodes) - n :] if n else 0
            nodes, end = nodes[: len(nodes) - n], end - n
            self.leaves.append(at)
        order = np.argsort(symbols, kind="stable")
        self.sorted, self.order = symbols[order], order

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray) -> Codes:
        length = code_lengths(counts)
        order = np.lexsort((symbols, -length))
        return cls(symbols[order], np.bincount(length, minlength=MAX_LENGTH + 1)[1:])

    def find(self, token: int) -> int | None:
        """The place of a token among the symbols."""
        k = int(np.searchsorted(self.sorted, token))
        return int(self.order[k]) if k < len(self.sorted) and self.sorted[k] == token else None


class WaveletMatrix:
    def __init__(self, n: int, codes: Codes, planes: list[np.ndarray], ones: list[np.ndarray], sizes: list[int]):
        """planes: packed bits; ones[p][b]: ones of plane p before block b; sizes[p]: bits of plane p."""
        self.n, self.codes, self.planes, self.ones, self.sizes = n, codes, planes, ones, [*sizes, 0]
        self.zeros = [size - int(o[-1]) for size, o in zip(sizes, ones)]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 32) -> WaveletMatrix:
        """bits: what every id must fit."""
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id takes more than {bits} bits")
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        symbols = np.flatnonzero(counts)
        codes = Codes.of(symbols.astype(np.uint32), counts[symbols])
        # each id's code with its first bit highest, and how many ids have codes as long as those of the first symbols
        kind = np.uint32 if codes.depth <= 32 else np.uint64
        width = np.dtype(kind).itemsize * 8
        own = np.zeros(len(counts), kind)
        own[codes.symbols] = (codes.code << (np.uint64(width) - codes.length.astype(np.uint64))).astype(kind)
        a, top = own[ids], kind(1 << (width - 1))
        left = np.bincount(codes.length, minlength=codes.depth + 1)
        stay = np.concatenate([[0], np.cumsum(counts[codes.symbols])]).astype(np.int64)
        planes, ones, sizes, end = [], [], [], len(symbols)
        for k in range(codes.depth):
            bit = a >= top
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            planes.append(packed)
            sizes.append(len(a))
            each = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
            ones.append(np.concatenate([[0], np.cumsum(each)]).astype("<u4"))
            end -= int(left[k + 1])
            np.add(a, a, out=a)  # the next bit goes up
            low, more = np.compress(~bit, a), int(stay[end])
            a = np.concatenate([low, np.compress(bit, a)[: more - len(low)]]) if more > len(low) else low[:more].copy()
        return cls(len(ids), codes, planes, ones, sizes)

    def bit(self, p: int, i: np.ndarray) -> np.ndarray:
        return self.planes[p][i >> 3] >> (i & 7).astype(np.uint8) & 1 == 1

    def rank1(self, p: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane p before each position i."""
        i = np.asarray(i, np.int64)
        block = i // BLOCK
        out = self.ones[p][block].astype(np.int64)
        words = np.concatenate([self.planes[p].view("<u8"), np.zeros(BLOCK // 64, "<u8")])
        for k in range(BLOCK // 64):
            left = i - block * BLOCK - 64 * k
            w = words[block * (BLOCK // 64) + k]
            mask = np.where(left >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.clip(left, 0, 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(np.where(left > 0, w & mask, np.uint64(0)))
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The tokens at positions i."""
        i = np.array(i, np.int64)
        out, code, going = np.zeros(len(i), np.uint32), np.zeros(len(i), np.uint64), np.arange(len(i))
        for p in range(len(self.planes)):
            b, r = self.bit(p, i), self.rank1(p, i)
            i = np.where(b, self.zeros[p] + r, i - r)
            code = code << np.uint64(1) | b.astype(np.uint64)
            ends = i >= self.sizes[p + 1]
            if ends.any():
                at = self.codes.leaves[p]
                order = np.argsort(self.codes.code[at])
                out[going[ends]] = self.codes.symbols[at[order][np.searchsorted(self.codes.code[at][order], code[ends])]]
                i, code, going = i[~ends], code[~ends], going[~ends]
        return out

    def _down(self, at: int, i: int) -> tuple[int, list[tuple[int, bool]]]:
        """Where position i falls among the ids of the code at this place of the symbols, and the bits on the way."""
        way, code, length = [], int(self.codes.code[at]), int(self.codes.length[at])
        for p in range(length):
            b = bool(code >> (length - 1 - p) & 1)
            r = int(self.rank1(p, np.array([i]))[0])
            i = self.zeros[p] + r if b else i - r
            way.append((p, b))
        return i, way

    def rank(self, token: int, i: int) -> int:
        """How often token occurs before position i."""
        at = self.codes.find(token)
        return 0 if at is None else self._down(at, i)[0] - self._down(at, 0)[0]

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, p: int, one: bool, k: int) -> int:
        """The position of the k-th (from 0) one or zero of plane p."""
        low, high = 0, self.sizes[p]
        while low < high:
            mid = (low + high) // 2
            r = int(self.rank1(p, np.array([mid + 1]))[0])
            if (r if one else mid + 1 - r) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at, way = self._down(self.codes.find(token), 0)
        at += k
        for p, b in reversed(way):
            at = self._select(p, b, at - self.zeros[p] if b else at)
        return at

    def leaf_counts(self) -> list[np.ndarray]:
        """How often each code that ends after a plane occurs, from the ones between the borders of the planes' nodes."""
        borders, out = np.array([0, self.n], np.int64), []
        for p in range(len(self.planes)):
            r = self.rank1(p, borders)
            both = np.concatenate([borders - r, self.zeros[p] + r[1:]])
            go_on = len(both) - 1 - len(self.codes.leaves[p])
            out.append(np.diff(both[go_on:]))
            borders = both[: go_on + 1]
        return out

    def values(self) -> np.ndarray:
        """All tokens in order, undoing the planes from the last up."""
        kind = np.uint16 if len(self.codes.symbols) == 0 or int(self.codes.symbols.max()) < 1 << 16 else np.uint32
        symbols, out = self.codes.symbols.astype(kind), np.zeros(0, kind)
        counts = self.leaf_counts()
        for p in range(len(self.planes) - 1, -1, -1):
            out = np.concatenate([out, np.repeat(symbols[self.codes.leaves[p]], counts[p])])
            bit = np.unpackbits(self.planes[p], count=self.sizes[p], bitorder="little").astype(bool)
            z, up = self.zeros[p], np.empty(self.sizes[p], kind)
            up[np.flatnonzero(~bit)] = out[:z]
            up[np.flatnonzero(bit)] = out[z:]
            out = up
        return out


class Shard:
    def __init__(self, doc_ids: list[int | None], ends: np.ndarray, matrix: WaveletMatrix, partition: int = 0, number: int = 0, before: int = 0):
        self.doc_ids, self.ends, self.matrix = doc_ids, ends, matrix
        self.partition, self.number, self.before = partition, number, before

    def to_bytes(self) -> bytes:
        m, c = self.matrix, self.matrix.codes
        head = np.array([len(self.doc_ids), m.n, len(c.symbols), self.partition, self.number, self.before, 0, 0, 0, 0], "<u8")
        parts = [head, np.array([d or 0 for d in self.doc_ids], "<i8"), np.array([d is None for d in self.doc_ids], np.uint8), self.ends.astype("<u8")]
        parts += [c.symbols.astype("<u4"), c.of_length.astype("<u4")]
        for plane, ones in zip(m.planes, m.ones):
            parts += [plane, ones]
        return MAGIC + b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        docs, n, symbols, partition, number, before = map(int, take("<u8", 10)[:6])
        ids, null, ends = take("<i8", docs), take("u1", docs), take("<u8", docs)
        codes = Codes(take("<u4", symbols), take("<u4", MAX_LENGTH).astype(np.int64))
        planes, ones, sizes, size, nodes = [], [], [], n, np.array([0, n], np.int64)
        matrix = WaveletMatrix(n, codes, [], [], [])
        for p in range(codes.depth):
            blocks = -(-(-(-size // 8)) // (BLOCK // 8))
            planes.append(take("u1", blocks * (BLOCK // 8)))
            ones.append(take("<u4", blocks + 1))
            sizes.append(size)
            # the next plane has the ids whose nodes go on: those before the border of the first code that ends here
            matrix = WaveletMatrix(n, codes, planes, ones, sizes)
            r = matrix.rank1(p, nodes)
            both = np.concatenate([nodes - r, matrix.zeros[p] + r[1:]])
            nodes = both[: len(both) - len(codes.leaves[p])]
            size = int(nodes[-1])
        return cls([None if x else int(d) for d, x in zip(ids, null)], ends.astype(np.int64), matrix, partition, number, before)


def full_path(spark, path: str) -> str:
    """The path with its scheme, as Spark reads it: tasks must not take one without a scheme for a folder of their own disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def put(path: str, content: bytes) -> None:
    """Write a file whole: under another name first, so a lost or repeated task leaves no half file."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        path = path.removeprefix("file:")
        path = "/" + path.lstrip("/") if path.startswith("//") else path
        store = fs.LocalFileSystem()
    else:
        store, path = fs.FileSystem.from_uri(path)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(own) as f:
        f.write(content)
    store.move(own, path)


class Encoder:
    """Ids of whole texts by the tokenizers library. Pieces repeat, and each is given to the library once while cached.

    New pieces go to the library's model many at once, parted by a byte that no text holds and no merge knows: so each gets the
    ids that it has alone. A vocabulary without such a byte gets them one by one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = "".join(letters[b] for b in range(256))
        self.pieces = Remembered(MAX_BYTES)
        self.bits = (self.library.get_vocab_size() - 1).bit_length()
        self.kind, self.code = ("<u2", "H") if self.bits <= 16 else ("<u4", "I")
        self.parting, self.parting_id = self.parting_byte()

    def parting_byte(self) -> tuple[bytes, int]:
        """A byte that no text holds, that has an id of its own and is part of no other token, and this id; else nothing and -1."""
        m, vocabulary = self.model, self.library.get_vocab(with_added_tokens=False)
        if type(m).__name__ == "BPE" and not (m.dropout or m.ignore_merges or m.continuing_subword_prefix or m.end_of_word_suffix):
            used = set("".join(t for t in vocabulary if len(t) > 1))
            for b in NEVER:
                if (letter := self.letters[b]) in vocabulary and letter not in used:
                    return bytes([b]), vocabulary[letter]
        return b"", -1

    def library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_ids(self, piece: bytes) -> bytes:
        """The ids of one piece by the library's model, which reads bytes as letters."""
        return array(self.code, [t.id for t in self.model.tokenize(charmap_decode(piece, "strict", self.letters)[0])]).tobytes()

    def pieces_ids(self, pieces: list[bytes]) -> list[bytes]:
        """piece_ids of many."""
        out: list[bytes] = []
        for k in range(0, len(pieces), TOGETHER):
            some = pieces[k : k + TOGETHER]
            joined = self.parting.join(some)
            if self.parting and len(joined) <= TOGETHER_BYTES and joined.count(self.parting) == len(some) - 1:
                ids = np.array([t.id for t in self.model.tokenize(charmap_decode(joined, "strict", self.letters)[0])], self.kind)
                ends = np.flatnonzero(ids == self.parting_id).tolist()
                raw, size = ids.tobytes(), ids.itemsize
                out += [raw[size * (a + 1) : size * b] for a, b in zip([-1, *ends], [*ends, len(ids)])]
            else:
                out += map(self.piece_ids, some)
        return out

    def remembered(self, data: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """The ids of each piece between two cuts. Of equal pieces of up to seven bytes, all but one are told by number."""
        first, size = cut[:-1], np.diff(cut)
        short, long = np.flatnonzero(size <= 7), np.flatnonzero(size > 7)
        own = size[short].astype(np.uint64)
        # the eight bytes from each place on, as one number; of these the piece's own, and its length above them
        ahead = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))[first[short]]
        key = ahead & ((np.uint64(1) << own * np.uint64(8)) - np.uint64(1)) | own << np.uint64(56)
        kinds, which = np.unique(key, return_inverse=True)
        one = np.empty(len(kinds), np.int64)
        one[which] = short
        at, raw = np.concatenate([one, long]), data.tobytes()
        found = [raw[a:b] for a, b in zip(first[at].tolist(), cut[at + 1].tolist())]
        ids = list(map(self.pieces.get, found))
        if None in ids:
            missing = [i for i, x in enumerate(ids) if x is None]
            new = list({found[i] for i in missing})
            got = dict(zip(new, self.pieces_ids(new)))
            self.pieces.keep_all(got)
            for i in missing:
                ids[i] = got[found[i]]
        out, kept = np.empty(len(first), object), np.array(ids, object)
        out[short], out[long] = kept[: len(kinds)][which], kept[len(kinds) :]
        return out.tolist()

    def many(self, column: pa.Array, end: int) -> list[bytes]:
        """Each text's ids and the end id."""
        data, offsets = string_buffer(column)
        cut = _pretokens.cuts(data, offsets)
        ids, at = self.remembered(data, cut), np.searchsorted(cut, offsets).tolist()
        last = np.array([end], self.kind).tobytes()
        out = [b"".join([*ids[a:b], last]) for a, b in zip(at, at[1:])]
        if SPECIAL in (raw := data.tobytes()):
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if SPECIAL in raw[a:b]:
                    out[k] = self.library_ids([raw[a:b].decode()])[0] + last
        return out


@worker_table
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, where: str, path: str | None = None, end: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents in ascending doc_id order into shard files under `where`; returns what was written, by file.

    The table is dealt by ranges of doc_id, so files follow in order of (partition, shard); rows of one id lie by the hash
    of their text, and null ids come first. Null and empty texts have the end id only. An empty table writes no file.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    where = full_path(docs.sparkSession, where)

    def run(batches):
        e, partition = encoder(path), TaskContext.get().partitionId()
        number = before = held = 0
        doc_ids, ids = [], []

        def close():
            nonlocal number, before, held
            ends = np.cumsum([len(x) for x in ids]) // np.dtype(e.kind).itemsize
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), e.kind), e.bits)
            file = f"{where}/part-{partition:07d}-{number:06d}.lwm"
            put(file, Shard(list(doc_ids), ends, matrix, partition, number, before).to_bytes())
            row = pa.RecordBatch.from_pylist([{"partition": partition, "shard": number, "file": file, "n_docs": len(doc_ids), "n_tokens": matrix.n}], schema=schema)
            number, before, held = number + 1, before + matrix.n, 0
            doc_ids.clear()
            ids.clear()
            return row

        schema = pa.schema([("partition", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            for part in slices(batch, 1):
                for d, x in zip(part.column(0).to_pylist(), e.many(part.column(1), end)):
                    doc_ids.append(d)
                    ids.append(x)
                    held += len(x) // np.dtype(e.kind).itemsize
                    if held >= shard_tokens:
                        yield close()
        if ids:
            yield close()

    own = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    order = (F.col("doc_id"), F.xxhash64("text"))
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(lean(run, "encoder"), "partition long, shard long, file string, n_docs long, n_tokens long"), "manifest")


def read_shards(spark, where: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and token_ids of each document in the files under `where`."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                s = Shard.from_bytes(raw.as_buffer().to_pybytes())
                values = s.matrix.values().astype("<u4")
                starts = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(values[a:b]) for a, b in zip(starts.tolist(), s.ends.tolist())]
                cols = [pa.array(s.doc_ids, pa.int64()), pa.array(np.full(len(sums), s.partition, np.int64)), pa.array(np.full(len(sums), s.number, np.int64)), pa.array(starts + s.before), pa.array(s.ends - starts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "partition", "shard", "start", "n_tokens", "ids_crc32"])

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lwm").load(where).select("content")
    rows = files.mapInArrow(lean(run), "doc_id long, partition long, shard long, start long, n_tokens long, ids_crc32 long")
    # one row a partition of the write, so the running sum in one task stays small
    sums = manifest.groupBy("partition").agg(F.sum("n_tokens").alias("own"))
    base = sums.select("partition", (F.sum("own").over(Window.orderBy("partition")) - F.col("own")).alias("base"))
    # by shard, so a file that only a failed attempt has written is left out
    return rows.join(manifest.join(base, "partition").select("partition", "shard", "base"), ["partition", "shard"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    where = scratch_path(spark, "tokens")
    return read_shards(spark, where, write_shards(table(spark, sf_dir, "documents"), where))
