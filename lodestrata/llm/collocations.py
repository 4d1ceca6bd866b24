"""Phrase collocation mining with depth-limited count tries.

1. A scan of all texts counts words by language, and in saturating counters of fixed size how often pairs of neighbours fall
   into each of 2^24 hash buckets. A pair whose bucket stays under the bar is in no frequent phrase; no frequent one is lost.
2. A second scan gives each shard's count trie of at most `depth` words: from every word on, the run of words whose pairs all
   reach the bar. A trie is kept as its sorted paths with counts, cut in two: its pairs, by ranges of the hash of both words,
   and its longer paths, by ranges of the hash of the first three, so that what follows one very common pair is spread. Each
   range is serialised on its own (words that a path shares with the one before it are not repeated).
3. The tries of a range are merged, shard by shard, into one sorted trie; the sums at its nodes are the counts of phrases, and
   only frequent ones leave the task.
4. For each cut of a frequent phrase the left part is an ancestor of its node, the right part the node that suffix links lead
   to; both are found by joins on the words of the node.

Words are compared by 64-bit hashes (n * n / 2^64 for n distinct words of a language); the words' texts are joined back.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import lean, slices, string_buffer, table, written
from ._shingles import mix
from ._words import LOWERED, byte_set, span_hashes, spans

LEAST = 100
DEPTH = 5
TOP = 2000
NO_LANG = "und"

_BREAK = byte_set(*b".,;:!?", *range(0x0A, 0x0E))
_DELIM = _BREAK | byte_set(0x20, 0x09)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

#: Buckets of pairs, and segments in which their counters travel.
BUCKET_BITS, SEGMENT_BITS = 24, 8
#: Words, and paths, that a task holds before they leave it.
HELD_WORDS = 1 << 19
HELD_PATHS = 1 << 18
#: Words of the corpus for each range of tries.
RANGE_WORDS = 1 << 22


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes; start, end and hash (never 0) of every word; whether the next word follows it in the same piece of the same text."""
    data, offsets = string_buffer(texts)
    start, end = spans(data, offsets, _DELIM)
    h = span_hashes(data, start, end, LOWERED)
    h[h == 0] = 1
    linked = np.zeros(len(start), bool)
    if len(start) > 1:
        cuts = np.concatenate([[0], np.cumsum(_BREAK[data], dtype=np.int64)])
        text = np.searchsorted(offsets, start, side="right")
        linked[:-1] = (cuts[start[1:]] == cuts[end[:-1]]) & (text[1:] == text[:-1])
    return data, start, end, h, linked


def buckets(lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    seed = np.uint64(zlib.crc32(lang.encode()) << 32)
    return mix(a * _MULT[0] + b * _MULT[1] + seed) >> np.uint64(64 - BUCKET_BITS)


def by_lang(batches):
    """(lang, texts) of steps of bounded bytes."""
    for batch in batches:
        for part in slices(batch, 1):
            langs = part.column(0).dictionary_encode()
            codes = np.asarray(langs.indices)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, part.column(1).filter(pa.array(codes == k)) if len(langs.dictionary) > 1 else part.column(1)


def counter_kind(least: int):
    return np.uint8 if least <= 255 else np.uint32


def raise_counters(counters: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Add to distinct places; counters stop at their largest value, which is not under any bar."""
    counters[at] = np.minimum(counters[at].astype(np.int64) + by, np.iinfo(counters.dtype).max).astype(counters.dtype)


def pack_segment(counters: np.ndarray) -> bytes:
    at = np.flatnonzero(counters)
    return zlib.compress(np.uint32(len(at)).tobytes() + np.diff(at, prepend=0).astype("<u4").tobytes() + counters[at].tobytes(), 1)


def unpack_segment(raw: bytes, kind) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64), np.frombuffer(raw, kind, n, 4 + 4 * n)


def counted(texts: DataFrame, least: int) -> DataFrame:
    """lang, word, h, n: words with partial counts; and segment, counters: buckets of pairs. One of the two kinds a row."""
    kind = counter_kind(least)
    names, types = ["lang", "word", "h", "n", "segment", "counters"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        held, text, counters = {}, {}, np.zeros(1 << BUCKET_BITS, kind)

        def words():
            for lang, of in held.items():
                known, rows = text[lang], list(of.items())
                for a in range(0, len(rows), 1 << 16):
                    h, n = map(list, zip(*rows[a : a + (1 << 16)]))
                    columns = [[lang] * len(h), [known[x].decode() for x in h], np.array(h, np.uint64).view(np.int64), n, [None] * len(h), [None] * len(h)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            held.clear()
            text.clear()

        for lang, column in by_lang(batches):
            data, start, end, h, linked = words_of(column)
            own, known = held.setdefault(lang, {}), text.setdefault(lang, {})
            distinct, first, n = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            for x, a, b, c in zip(distinct.tolist(), start[first].tolist(), end[first].tolist(), n.tolist()):
                if x in own:
                    own[x] += c
                else:
                    own[x] = c
                    known[x] = raw[a:b].lower()
            i = np.flatnonzero(linked)
            raise_counters(counters, *np.unique(buckets(lang, h[i], h[i + 1]).astype(np.int64), return_counts=True))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from words()
        yield from words()
        for k, part in enumerate(np.split(counters, 1 << SEGMENT_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, None, None, k, pack_segment(part)], types)], names=names)

    return written(texts.mapInArrow(lean(run), "lang string, word string, h long, n long, segment int, counters binary"), "phrase-words")


def frequent_buckets(partial: DataFrame, least: int) -> np.ndarray:
    """A bit for each bucket: at most 2^24 bits (2 MB) reach the driver, whatever the table. Sums are made in two steps, so that
    no task meets the counters of all shards."""
    kind = counter_kind(least)

    def summed(bits: bool):
        def run(batches):
            now, held = None, None

            def out():
                blob = np.packbits(held >= least).tobytes() if bits else pack_segment(held)
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([blob], pa.binary())], names=["segment", "counters"])

            for batch in batches:
                for segment, raw in zip(batch.column("segment").to_pylist(), batch.column("counters").to_pylist()):
                    if segment != now:
                        if now is not None:
                            yield out()
                        now, held = segment, np.zeros(1 << (BUCKET_BITS - SEGMENT_BITS), kind)
                    raise_counters(held, *unpack_segment(raw, kind))
            if now is not None:
                yield out()

        return lean(run)

    rows = partial.where(F.col("counters").isNotNull()).select("segment", "counters")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("counters"), F.lit(64)))
    once = salted.repartition("segment", "salt").sortWithinPartitions("segment").select("segment", "counters").mapInArrow(summed(False), "segment int, counters binary")
    twice = once.repartition("segment").sortWithinPartitions("segment").mapInArrow(summed(True), "segment int, counters binary")
    out = np.zeros((1 << SEGMENT_BITS, 1 << (BUCKET_BITS - SEGMENT_BITS - 3)), np.uint8)
    for r in twice.collect():
        out[r.segment] = np.frombuffer(bytes(r.counters), np.uint8)
    return out.ravel()


class Trie:
    """Sorted paths of words (0 beyond the end of a path) and how often each was seen."""

    def __init__(self, paths: np.ndarray, n: np.ndarray):
        """Sorts by the hash of the first words (three, or two in a trie of pairs), then by words, and adds equal paths up."""
        key = self.key(paths)
        order = np.lexsort([*paths.T[::-1], key])
        p, k = paths[order], key[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]).any(1)]) if len(p) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.paths, self.keys = p[at], k[at]
        self.n = np.add.reduceat(n[order], at) if len(at) else n[:0]

    @staticmethod
    def key(paths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(paths), np.uint64)
        for k in range(min(3, paths.shape[1])):
            out = out + paths[:, k] * _MULT[k]
        return mix(out)

    def ranges(self, n: int):
        """(range, paths, counts) of the parts of the key space that have paths."""
        which = ((self.keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else []
        for a, b in zip(cut, np.append(cut, len(which))[1:]):
            yield int(which[a]), self.paths[a:b], self.n[a:b]

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and counts of all nodes at this depth."""
        own = self.paths[:, depth - 1] > 0
        p, n = self.paths[own][:, :depth], self.n[own]
        at = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(1)])) if len(p) else np.zeros(0, np.int64)
        return p[at], np.add.reduceat(n, at) if len(at) else n[:0]


def pack_trie(paths: np.ndarray, n: np.ndarray) -> bytes:
    """Dictionary of words, then for each path how many words it shares with the one before, its length, its count and the
    numbers of its other words."""
    known, ids = np.unique(paths, return_inverse=True)
    ids = ids.reshape(paths.shape)
    length = (paths > 0).sum(1)
    same = np.zeros(len(paths), np.int64)
    same[1:] = np.cumprod(paths[1:] == paths[:-1], axis=1).sum(1)
    same = np.minimum(same, length)
    k = np.arange(paths.shape[1])
    own = (k >= same[:, None]) & (k < length[:, None])
    head = np.array([len(paths), len(known), paths.shape[1]], "<u4")
    parts = [head, known.astype("<u8"), same.astype(np.uint8), length.astype(np.uint8), n.astype("<u8"), ids[own].astype("<u4")]
    return zlib.compress(b"".join(x.tobytes() for x in parts), 1)


def unpack_trie(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    n, words, depth = map(int, take("<u4", 3))
    known, same, length, count = take("<u8", words), take("u1", n), take("u1", n), take("<u8", n)
    k = np.arange(depth)
    own = (k >= same[:, None]) & (k < length[:, None])
    paths = np.zeros((n, depth), np.uint64)
    paths[own] = known[take("<u4", int(own.sum()))]
    # a shared word is that of the last path that had one of its own at this depth
    for d in range(depth):
        last = np.maximum.accumulate(np.where(own[:, d], np.arange(n), 0))
        paths[:, d] = np.where(d < length, paths[last, d], 0)
    return paths, count.astype(np.int64)


def shard_tries(texts: DataFrame, bits: np.ndarray, depth: int, ranges: int) -> DataFrame:
    """lang, first (words that the key hashes: 2 for pairs, 3 for longer paths), part (range of keys), trie."""
    names, types = ["lang", "first", "part", "trie"], [pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        held: dict[str, list] = {}

        def out():
            for lang, parts in held.items():
                whole = Trie(*(np.concatenate(c) for c in zip(*parts)))
                longer = whole.paths[:, 2] > 0 if depth > 2 else np.zeros(len(whole.n), bool)
                for first, trie in ((2, Trie(whole.paths[:, :2], whole.n)), (3, Trie(whole.paths[longer], whole.n[longer]))):
                    for k, paths, n in trie.ranges(ranges):
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([lang, first, k, pack_trie(paths, n)], types)], names=names)
            held.clear()

        for lang, column in by_lang(batches):
            _, _, _, h, linked = words_of(column)
            if len(h) < 2:
                continue
            b = buckets(lang, h[:-1], h[1:])
            ok = np.zeros(len(h) + depth, bool)
            ok[: len(h) - 1] = linked[:-1] & (bits[b >> np.uint64(3)] >> (7 - (b & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            further = ok[: len(h)].astype(np.int64)
            for k in range(1, depth - 1):
                further += (further == k) & ok[k : len(h) + k]
            i = np.flatnonzero(further)
            paths = np.zeros((len(i), depth), np.uint64)
            for k in range(depth):
                within = further[i] >= k
                paths[within, k] = h[i[within] + k]
            held.setdefault(lang, []).append((paths, np.ones(len(i), np.int64)))
            if sum(len(n) for x in held.values() for _, n in x) > HELD_PATHS:
                for x in held:
                    t = Trie(*(np.concatenate(c) for c in zip(*held[x])))
                    held[x] = [(t.paths, t.n)]
                if sum(len(x[0][1]) for x in held.values()) > HELD_PATHS // 2:
                    yield from out()
        yield from out()

    return texts.mapInArrow(lean(run), "lang string, first int, part long, trie binary")


def merged_nodes(tries: DataFrame, depth: int, least: int) -> DataFrame:
    """lang, w (array of word hashes), n: the nodes of two words or more that reach the bar."""

    def run(batches):
        now, held, size = None, [], 0

        def merge():
            t = Trie(*(np.concatenate(c) for c in zip(*held)))
            return t, [(t.paths, t.n)], len(t.n)

        def out():
            t, _, _ = merge()
            for d in [2] if now[1] == 2 else range(3, depth + 1):
                paths, n = t.nodes(d)
                paths, n = paths[n >= least], n[n >= least]
                if len(n):
                    flat = pa.array(np.ascontiguousarray(paths).view(np.int64).ravel())
                    w = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d, dtype=np.int32)), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(n)), w, pa.array(n)], names=["lang", "w", "n"])

        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns)):
                if key[:3] != now:
                    if held:
                        yield from out()
                    now, held, size = key[:3], [], 0
                held.append(unpack_trie(key[3]))
                size += len(held[-1][1])
                if size > 4 * HELD_PATHS:
                    _, held, size = merge()
        if held:
            yield from out()

    dealt = tries.repartition("lang", "first", "part").sortWithinPartitions("lang", "first", "part")
    return dealt.mapInArrow(lean(run), "lang string, w array<bigint>, n long")


def phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    docs: text, lang; a null language is `und`, a null text empty. Words do not reach over `.,;:!?` or line ends. Phrases of 2
    to `depth` words seen `least` times or more are candidates; score floor(1000 a n / (l r)) at the lowest cut, ties to the
    shortest left part; phrases inside a longer candidate that is seen as often are dropped. Repeated texts each count. Ties of
    score fall to a, then to the phrase. Other columns are not read; an empty table gives an empty table. Arithmetic is decimal,
    exact up to 10^38.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    partial = counted(texts, least)
    words = partial.where(F.col("word").isNotNull()).groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    words = written(words, "phrase-counts")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    common = words.where(F.col("n") >= least)
    seen = words.agg(F.sum("n")).first()[0] or 0
    bits = frequent_buckets(partial, least)
    tries = shard_tries(texts, bits, depth, 1 + seen // RANGE_WORDS)
    longer = merged_nodes(tries, depth, least)
    single = common.groupBy("lang", "h").agg(F.sum("n").alias("n")).select("lang", F.array("h").alias("w"), "n")
    nodes = written(single.unionByName(longer), "phrase-nodes")

    candidates = nodes.where(F.size("w") >= 2).withColumnRenamed("n", "a")
    inside = candidates.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
    inside = inside.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.slice(F.col("w"), i, F.col("k")))).alias("w"))
    covered = inside.groupBy("lang", "w").agg(F.max("a").alias("longest"))
    kept = candidates.join(covered, ["lang", "w"], "left").where(F.col("longest").isNull() | (F.col("longest") < F.col("a"))).drop("longest")

    cuts = kept.select("lang", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("*", F.slice("w", F.lit(1), F.col("cut")).alias("lw"), F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")).alias("rw"))
    side = lambda name: nodes.select("lang", F.col("w").alias(f"{name}w"), F.col("n").alias(name))
    cuts = cuts.join(side("l"), ["lang", "lw"]).join(side("r"), ["lang", "rw"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(total as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "w").agg(F.min(F.struct("score", "cut", "a", "l", "r", "total")).alias("x"))

    spelt = common.groupBy("lang", "h").agg(F.min("word").alias("word"))
    spoken = kept.select("lang", "w", F.posexplode("w").alias("at", "h")).join(spelt, ["lang", "h"]).groupBy("lang", "w").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("said"))
    rows = best.join(spoken, ["lang", "w"]).select("lang", F.array_join(F.col("said.word"), " ").alias("phrase"), "x.a", "x.l", "x.r", F.col("x.total").alias("n"), F.col("x.score").cast("long").alias("score"))
    # cut in parts of each language first, so that no task sorts all of its phrases
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


SQL = f"""
WITH p AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (
  SELECT lang, k, w[i : i + k - 1] AS ph, count(*) AS f FROM starts, (SELECT unnest(range(1, {DEPTH} + 1)) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1),
inner_of AS (SELECT c.lang, c.f, ph[i : i + s - 1] AS sub FROM c, (SELECT unnest(range(2, {DEPTH})) AS s), (SELECT unnest(range(1, {DEPTH})) AS i) WHERE s < k AND i + s - 1 <= k),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, sub, max(f) AS most FROM inner_of GROUP BY ALL) x ON x.lang = c.lang AND x.sub = c.ph WHERE most IS NULL OR most < f),
cut AS (
  SELECT c.lang, c.ph, c.f AS a, l.f AS l, r.f AS r, n, j, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM kept c, (SELECT unnest(range(1, {DEPTH})) AS j), f l, f r, total t
  WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang AND t.lang = c.lang AND l.ph = c.ph[1 : j] AND r.ph = c.ph[j + 1 : c.k]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
named AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named QUALIFY rank <= {TOP}
"""
