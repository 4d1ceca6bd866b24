"""Toxicity by a noisy channel: disguised words are decoded, then the restored text is scored.

The channel writes letters as look-alikes (leetspeak), puts separators between letters and repeats letters. A disguised
span becomes a lattice of letters, which the Viterbi algorithm decodes under a trigram model of letters counted over all
documents; repeated letters are read both once and twice, and signs of two
letters as either. Spans without such signs have one path only and need no decoding.

The score is that of a short list of words and word beginnings, learned from labelled rows: at each turn the feature that
explains most toxic rows not yet explained is taken, while its precision is surely over one half. A text's score joins the
precisions of the features it holds; without any it is the rate among texts without any.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Remembered, bounded_batches, drop_tables, lean, release, slices, string_buffer, table, written

#: At most about so many labelled rows are used for training, taken by hash (documented bound).
MAX_TRAIN = 20_000
CUT = 0.3
MIN_TOXIC = 3
TURNS = 3
#: Bytes of decoded spans, and of tokens and their forms, that a worker remembers.
MAX_BYTES = 16 << 20
MAX_SEEN = 48 << 20
PREFIXES = range(4, 9)
CHANNEL = {"look-alike": -1.0, "single": -0.4, "double": -1.1}

#: Letters that each look-alike may stand for.
LOOK_ALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "*": "aeiou"}

_ENDS = "".join(LOOK_ALIKE)
_SIGNS = "".join(re.escape(c) for c in LOOK_ALIKE)
_UNIT = rf"(?:[^\W\d_]|[{_SIGNS}])"
_APART = re.compile(rf"(?<![^\W_]){_UNIT}(?:[ ._\-*][^\W\d_]|[ ._\-][{_SIGNS}]){{3,}}(?![^\W_])")  # letters or look-alikes set apart
_PIECE = re.compile(rf"(?:[^\W_]|[{_SIGNS}])+")
#: A look-alike beside a letter, or a letter twice.
_ODD = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]|([^\W\d_])\1")
#: A sign, or a letter three times: more than a word with double letters.
_DISGUISED = re.compile(rf"[{_SIGNS}]|([^\W\d_])\1\1|[ ._\-*]")
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = 28
#: Ways to read a disguised span that are all tried.
MOST = 8

#: By the first byte of a code point: what may be one of the letters set apart (all beyond ASCII may), and what may part them.
_MAYBE = np.zeros(256, bool)
_MAYBE[[*range(65, 91), *range(97, 123), *range(128, 256), *(ord(c) for c in LOOK_ALIKE if ord(c) < 128)]] = True
_GAP = np.zeros(256, bool)
_GAP[[*map(ord, " ._-*")]] = True
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
#: By byte: what lower case makes of ASCII, what ends a token, and which may be signs or letters.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOK_ALIKE if ord(c) < 128]] = True
_PARTED = re.compile(r".(?:[ ._\-*].)+")
#: Signs that stand for one letter only, as that letter; and what shares one reading: a run of one character, or letters that are
#: no run (the second group).
_READING = str.maketrans({c: x for c, x in LOOK_ALIKE.items() if len(x) == 1})
_RUN = re.compile(r"(.)\1+|(?:([^\W\d_])(?!\2))+|.", re.S)


@lru_cache(1 << 16)
def code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


def odd_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Of all texts, in order, the tokens between ASCII white space that may be disguised (see _ODD), and for each text the index
    of its first (one more at the end).

    None is left out: code points beyond ASCII that stand beside another, or that may be a sign or turn into ASCII (the first
    bytes of the euro and Kelvin signs, a capital I with a dot), always count."""
    n = len(data)
    if n < 2:
        return [], [0] * len(offsets)
    low, letter, sign = _FOLD[data], _LETTER[data], _SIGN[data]
    odd = low[1:] == low[:-1]
    odd &= letter[1:]
    odd |= sign[1:] & letter[:-1]
    odd |= letter[1:] & sign[:-1]
    odd |= (data[1:] >= 0xC0) & (data[:-1] >= 0x80)
    odd |= data[:-1] == 0xE2
    odd |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    begins = np.zeros(n + 1, bool)
    begins[1:] = blank = _BLANK[data]
    begins[offsets] = True
    begins = np.flatnonzero(begins)
    at = np.unique(np.searchsorted(begins, np.flatnonzero(odd), "right"))
    first, end = begins[at - 1], begins[at]
    raw, end = data.tobytes(), end - blank[end - 1]
    return [raw[a:b] for a, b in zip(first.tolist(), end.tolist())], np.searchsorted(first, offsets).tolist()


@lru_cache(1 << 16)
def ways_of(reading: str, disguised: bool, many: bool) -> list[list[tuple[str, float, tuple[int, ...]]]]:
    """The ways to read a run of signs that have one reading, each some letters with the channel's log probability and their
    codes. disguised: a look-alike is among them; many: there are two or more."""
    letters = LOOK_ALIKE.get(reading) or (reading if reading.isalpha() else "")
    base = CHANNEL["look-alike"] if disguised else 0.0
    if not letters:
        return [[(reading, 0.0, (code(reading),))]]
    each = [[x] for x in letters] if len(letters) == 2 else [list(letters)]
    times = [(1, base + CHANNEL["single"]), (2, base + CHANNEL["double"])] if many else [(1, base)]
    return [[(x * n, p, (code(x),) * n) for x in some] for n, p in times for some in each]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's digits leaves 2 on division by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (a-z, other letters as one, all else as a border) over all documents."""

    def run(batches):
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                c = _CODE[string_buffer(part.column(0))[0]]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SYMBOLS**3, np.int64)  # at most 28^3 rows
    for r in rows:
        out[r.gram] = r.n
    return out


class Decoder:
    def __init__(self, counts: np.ndarray):
        c = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(float)
        back = (c.sum(0) + 0.5) / (c.sum((0, 1))[None, :] * 0 + c.sum((0, 2))[:, None] + 0.5 * _SYMBOLS)
        self.log = np.log((c + 2.0 * back[None]) / (c.sum(2, keepdims=True) + 2.0)).tolist()
        self.known, self.seen = Remembered(MAX_BYTES), Remembered(MAX_SEEN)

    def lattice(self, span: str) -> list[list[list[tuple[str, float, tuple[int, ...]]]]]:
        """The ways to read each place, each some letters with the channel's log probability and their codes: a repeated letter
        once or twice, a sign that may be two letters as either of them.

        A place is a run of one sign, or of signs that can only be the same letter (`$s5`)."""
        if _PARTED.fullmatch(span) is not None:
            span = span[::2]
        out: list = []
        for m in _RUN.finditer(span.translate(_READING)):
            read, signs = m[0], span[m.start() : m.end()]
            if m[2] is None:
                out.append(ways_of(read[0], read[0] in LOOK_ALIKE or signs != read, len(read) > 1))
            elif signs == read:  # letters with one way each: after two of them one path is left, so the rest make one place
                own = 2 if out else 0
                out += [ways_of(x, False, False) for x in read[:own]]
                if rest := read[own:]:
                    out.append([[(rest, 0.0, tuple(map(code, rest)))]])
            else:
                out += [ways_of(x, x != sign, False) for x, sign in zip(read, signs)]
        return out

    def likeliest(self, places: list[list[tuple[str, float, tuple[int, ...]]]]) -> str:
        """Viterbi over pairs of letters."""
        log, best = self.log, {(0, 0): (0.0, "")}
        for choices in [*places, [("", 0.0, (0,))]]:
            after: dict = {}
            for (a, b), (score, text) in best.items():
                for letters, channel, codes in choices:
                    x, y, s = a, b, score + channel
                    for c in codes:
                        s += log[x][y][c]
                        x, y = y, c
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, text + letters)
            best = after
        return max(best.values())[1]

    def decode(self, span: str) -> tuple[str, ...]:
        """The likeliest letters behind a span (lower case), and, where signs or long runs show that it is disguised, the likeliest
        with its open places read in other ways: letter statistics do not tell a real double from a drawn-out letter. Up to MOST
        ways are all tried, of more each way of a place with the other places left open."""
        got = self.known.get(span)
        if got is None:
            lattice = self.lattice(span)
            free = [[x for way in ways for x in way] for ways in lattice]
            found = {self.likeliest(free)}
            unsure = [i for i, ways in enumerate(lattice) if len(ways) > 1]
            if unsure and _DISGUISED.search(span):
                if math.prod(len(lattice[i]) for i in unsure) <= MOST:
                    picks = (dict(zip(unsure, pick)) for pick in itertools.product(*(range(len(lattice[i])) for i in unsure)))
                else:
                    picks = ({i: k} for i in unsure for k in range(len(lattice[i])))
                for pick in picks:
                    found.add(self.likeliest([lattice[i][pick[i]] if i in pick else free[i] for i in range(len(free))]))
            got = tuple(sorted(found))
            self.known.keep(span, got, len(span) + sum(map(len, got)) + 60 * len(got))
        return got

    def forms(self, token: str) -> tuple[str, ...]:
        """What a token (lower case, no white space) may say: its parts with look-alikes or repeated letters decoded, each
        also without the signs at its ends, which may be punctuation."""
        parts = set()
        for m in _PIECE.finditer(token):
            if _ODD.search(m[0]):
                heads = {m[0], m[0].lstrip("!|+*"), m[0].lstrip(_ENDS)} if m[0][0] in LOOK_ALIKE else {m[0]}
                parts |= {x for h in heads for x in (h, h.rstrip("!|+*"), h.rstrip(_ENDS)) if _ODD.search(x)} if m[0][-1] in LOOK_ALIKE else {h for h in heads if _ODD.search(h)}
        return tuple({y for x in parts for y in self.decode(x)} - parts)

    def forms_of(self, raw: bytes) -> tuple[str, ...]:
        """What the tokens of some UTF-8 bytes may say; remembered."""
        got = tuple({y for token in raw.decode().lower().split() for y in self.forms(token)})
        return self.seen.keep(raw, got, len(raw) + sum(map(len, got)) + 60 * len(got))

    def apart(self, span: str) -> set[str]:
        """What letters set apart may say; up to two at each end may be words of their own ("a", "I") or numbers."""
        n = (len(span) + 1) // 2
        parts = {span[2 * i : 2 * (n - j) - 1] for i in range(3) for j in range(3) if n - i - j >= 4 or not i + j}
        return {y for x in parts if any(c.isalpha() for c in x) for y in self.decode(x)}

    def restored_many(self, column: pa.Array) -> list[str]:
        """Each text in lower case, and after it the decoded forms of its disguised spans."""
        data, offsets = string_buffer(column)
        first = (data & 0xC0) != 0x80
        points, spaced = data[first], np.zeros(len(column), bool)
        if len(points) > 6:
            unit, gap = _MAYBE[points], _GAP[points]
            pair = unit[:-1] & gap[1:]
            at = np.flatnonzero(pair[:-5] & pair[2:-3] & pair[4:-1] & unit[6:])
            spaced[np.searchsorted(offsets, np.flatnonzero(first)[at], "right") - 1] = True
        tokens, at = odd_tokens(data, offsets)
        get, out = self.seen.get, []
        for text, check, a, b in zip(column.to_pylist(), spaced.tolist(), at, at[1:]):
            text = (text or "").lower()
            got: set[str] = set()
            for token in set(tokens[a:b]):
                if (more := get(token)) is None:
                    more = self.forms_of(token)
                got.update(more)
            if check:
                for span in {m[0] for m in _APART.finditer(text)}:
                    got |= self.apart(span)
            out.append("\n".join([text, *sorted(got)]) if got else text)
        return out


def features(text: str) -> set[str]:
    """Whole words of four letters or more as `=word`, and their beginnings as `word`."""
    out = set()
    for w in set(_WORD.findall(text)):
        if len(w) >= 4:
            out.add("=" + w)
            out.update(w[:k] for k in PREFIXES if k <= len(w))
    return out


def related(a: str, b: str) -> bool:
    """Whether one feature is the beginning of the other."""
    a, b = a.lstrip("="), b.lstrip("=")
    return a.startswith(b) or b.startswith(a)


def surely(hits, total, z: float = 1.64, root=math.sqrt):
    """Lower end of the Wilson interval of a rate of some rows; numbers, or columns with their square root."""
    p = hits / total
    return (p + z * z / (2 * total) - z * root(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)


class Scorer:
    """weights: feature to its precision; base: the rate among texts without any."""

    def __init__(self, weights: dict[str, float], base: float):
        self.weights, self.base = weights, base
        self.needles = [(f.lstrip("="), re.compile(rf"(?<![^\W\d_]){re.escape(f.lstrip('='))}" + (r"(?![^\W\d_])" if f[0] == "=" else "")), p) for f, p in weights.items()]

    def score(self, restored: str) -> float:
        miss = 1.0
        for plain, pattern, p in self.needles:
            if plain in restored and pattern.search(restored):
                miss *= 1 - p
        return self.base if miss == 1.0 else max(self.base, 1 - miss)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of labelled documents that are not held out, at most about MAX_TRAIN, each text once."""
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    known = written(known, "labels")
    n = known.count()
    if n > MAX_TRAIN:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (MAX_TRAIN * (1 << 40)) // n)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.join(F.broadcast(known), "doc_id").where("text is not null")  # about MAX_TRAIN rows of 12 bytes
    return written(rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("digest").withColumn("row", F.xxhash64("text")), "training")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Decoder, Scorer]:
    decoder = Decoder(letter_counts(docs))
    rows = training_rows(docs, labels)
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return decoder, Scorer({}, 0.0)

    def of_toxic(batches):
        for batch in batches:
            for part in slices(batch, 0):
                for text, row in zip(decoder.restored_many(part.column(0)), part.column(1).to_pylist()):
                    f = sorted(features(text))
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(f), pa.int64()), pa.array(f, pa.string())], names=["row", "feature"])

    met = written(rows.where("toxic = 1").select("text", "row").mapInArrow(lean(of_toxic), "row long, feature string"), "features")
    support = met.groupBy("feature").agg(F.count("*").alias("hits")).where(F.col("hits") >= MIN_TOXIC)

    def of_clean(batches):
        for batch in batches:
            for part in slices(batch, 0):
                total = Counter()
                for text in decoder.restored_many(part.column(0)):
                    total.update(features(text))
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])

    met_too = rows.where("toxic = 0").select("text").mapInArrow(lean(of_clean), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    both = support.join(met_too, "feature", "left").select("feature", "hits", F.coalesce("n", F.lit(0)).alias("false"))
    good = written(both.where(surely(F.col("hits"), F.col("hits") + F.col("false"), root=F.sqrt) >= 0.5), "good")
    hits, false = {}, {}
    for r in good.toLocalIterator():
        hits[r.feature], false[r.feature] = r.hits, r.false
    # greedy cover of the toxic rows; all of it is bounded by the training rows
    holders = defaultdict(set)
    for r in met.join(good.select("feature"), "feature").toLocalIterator():
        holders[r.feature].add(r.row)
    weights: dict[str, float] = {}
    sure = {f: surely(hits[f], hits[f] + false[f], 2.6) for f in holders}
    some = max(MIN_TOXIC, toxic // 500)
    for turn in range(TURNS):
        # at first a feature of strong evidence need explain few rows more, one of weak evidence several; later turns
        # explain all rows again, by other features of strong evidence: words that came with others before may stand alone
        least = {f: max(1, toxic // 1000) if not turn and sure[f] >= 0.5 else some for f in holders if not turn or sure[f] >= 0.65}
        left = {f: set(holders[f]) for f in least}
        while left := {f: h for f, h in left.items() if len(h) >= least[f] and not any(related(f, w) for w in weights)}:
            f = max(left, key=lambda x: (len(left[x]) - 2 * false[x], len(x), x))
            done = left.pop(f)
            weights[f] = (hits[f] + 0.5) / (hits[f] + false[f] + 1)
            left = {x: h - done for x, h in left.items()}
    covered = set().union(*[holders[f] for f in weights]) if weights else set()
    rest = toxic - len(covered)
    return decoder, Scorer(weights, min(CUT / 2, rest / max(1, rest + clean)))


def scores(docs: DataFrame, decoder: Decoder, scorer: Scorer):
    """A column function from text to its score."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast((decoder, scorer))

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_tables()
        d, s = shared.value
        for column in columns:
            out = []
            for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
                out += [s.score(x) for x in d.restored_many(part.column(0))]
            yield pa.array(out, pa.float64())
        release()

    return score


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts hold no feature and get the base rate. A null id is not held out and never learned from; an id
    whose labels differ, or are null, is not learned from. Repeated rows stay; other columns are not read; without toxic
    training rows all scores are 0. An empty table gives an empty table.
    """
    score = scores(docs, *fit(docs, labels))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic; rules as for `judge`."""
    score = scores(docs, *fit(docs, labels))
    return docs.where(score(F.col("text").cast("string")) < CUT)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
