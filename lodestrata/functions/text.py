"""Text and array functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def lower_strip(text: Column) -> Column:
    """Lower case without white space at the ends; null is ''."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), F.lit(""))


def canonical_text(text: Column) -> Column:
    """The default canonical key of a text: lower case, white space collapsed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def canonical_url(url: Column) -> Column:
    """The canonical key of an address: scheme and host in lower case, without user, default port, fragment or a slash at the end;
    null where it has no scheme or no host."""
    part = lambda k: F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]*)?([^#]*)", k)
    scheme, port = F.lower(part(1)), part(3)
    default = (port == ":") | (scheme == "http") & (port == ":80") | (scheme == "https") & (port == ":443")
    rest = F.regexp_replace(F.regexp_replace(part(4), r"\s+$", ""), "/$", "")
    return F.when(part(2) != "", F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when(default, "").otherwise(port), rest))


def connectivity(key: Column) -> Column:
    """The part of a structured key before its first hyphen."""
    return F.substring_index(key, "-", 1)


def to_number(text: Column) -> Column:
    """A double, or null where the text is none."""
    return text.try_cast("double")


def log10_offset(value: Column, offset: float = 0.001) -> Column:
    """log10(value + offset), null where that is not over 0."""
    v = value + F.lit(offset)
    return F.when(v > 0, F.log10(v))


def sigmoid(x: Column, clip: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))


def softmax(values: Column) -> Column:
    """Of an array, shifted by its maximum."""
    e = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def normalise_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation dropped, the articles a, an, the dropped, white space collapsed."""
    parts = F.split(F.regexp_replace(F.lower(text), _PUNCTUATION, ""), r"\s+")
    return F.array_join(F.filter(parts, lambda w: ~w.isin("", "a", "an", "the")), " ")


def clean_controls(text: Column) -> Column:
    """Control and format characters go, except that tab and line ends become spaces, as do all other kinds of space."""
    return F.regexp_replace(F.regexp_replace(text, r"[\t\r\n\p{Zs}]", " "), r"[\p{Cc}\p{Cf}]", "")


def split_punctuation(text: Column) -> Column:
    """Words and, each on its own, punctuation marks and CJK characters."""
    return F.regexp_extract_all(text, F.lit(r"([\p{IsHan}]|[\p{P}\p{S}]|[^\s\p{P}\p{S}\p{IsHan}]+)"), 1)


def pretokens(text: Column) -> Column:
    """The pieces of the byte-level pre-tokeniser."""
    return F.regexp_extract_all(text, F.lit(r"('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"), 1)


def byte_table() -> tuple[str, str]:
    """The bytes (as characters 0 to 255) that the byte-level alphabet renames, and their letters: printable ones stand for
    themselves, the others for the characters from 256 on, in order."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(map(chr, hidden)), "".join(chr(256 + k) for k in range(len(hidden)))


def byte_letters(text: Column) -> Column:
    """One letter for each UTF-8 byte of the text."""
    hidden, letters = byte_table()
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), hidden, letters)


def letters_text(letters: Column) -> Column:
    """The text whose bytes the letters are; bytes that are no UTF-8 become U+FFFD."""
    hidden, shown = byte_table()
    out = F.translate(letters, shown[1:], hidden[1:])
    # translate takes the character 0 for "drop"
    return F.decode(F.encode(F.replace(out, F.lit(shown[0]), F.lit(hidden[0])), "ISO-8859-1"), "UTF-8")


#: Marks around a token and between pieces; no letters of the byte alphabet.
_OPEN, _CLOSE, _NEXT = "\u25C0", "\u25B6", "\u25A0"


def byte_pieces(text: Column, merges: Sequence[tuple[str, str]]) -> Column:
    """The byte-level tokens of a text by a short list of merges, in order of rank.

    Each merge joins its pair wherever it stands, from the left, within the pieces of the pre-tokeniser. Applied in order of
    rank this equals the loop that always joins the lowest pair there is, as long as the parts of a pair come before it in the
    list. For lists of up to some hundred merges: each is one pass over the text. A null text is null.
    """
    marked = F.transform(pretokens(text), lambda p: F.regexp_replace(byte_letters(p), "(?s)(.)", f"{_OPEN}$1{_CLOSE}"))
    out = F.array_join(marked, _NEXT)
    for a, b in merges:
        out = F.replace(out, F.lit(f"{_OPEN}{a}{_CLOSE}{_OPEN}{b}{_CLOSE}"), F.lit(f"{_OPEN}{a}{b}{_CLOSE}"))
    return F.regexp_extract_all(out, F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


def scan_patterns(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns found in a text, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def letters_only_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def windows(tokens: Column, size: int, stride: int) -> Column:
    """Overlapping slices of at most `size` tokens that start every `size - stride`; the last one reaches the end."""
    n, step = F.size(tokens), size - stride
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int") * step, F.lit(step)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, size).alias("tokens")))


def covering_windows(n: Column, size: int, overlap: int) -> Column:
    """(start, end) of the windows over n tokens: one if they fit, else one every `size - overlap` tokens while any is left to
    start at; ends may lie beyond the last token only by being cut to it."""
    n = n.cast("int")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + F.lit(size), n).alias("end")))


def runs(flags: Column) -> Column:
    """(start, end) of the maximal runs of true flags, end exclusive; null is false. In one pass: no look-ups by position."""
    n, none = F.size(flags), F.array(F.lit(False))
    ahead = F.zip_with(F.concat(F.slice(flags, 2, n), none), F.slice(F.concat(none, flags), 1, n), lambda a, b: F.struct(a.alias("after"), b.alias("before")))
    beside = F.zip_with(flags, F.slice(ahead, 1, n), lambda x, y: F.struct(x.alias("own"), y["before"].alias("before"), y["after"].alias("after")))
    on = lambda x: F.coalesce(x, F.lit(False))
    marks = F.transform(beside, lambda x, i: F.struct(i.alias("i"), (on(x["own"]) & ~on(x["before"])).alias("first"), (on(x["own"]) & ~on(x["after"])).alias("last")))
    return F.zip_with(F.filter(marks, lambda m: m["first"]), F.filter(marks, lambda m: m["last"]), lambda a, b: F.struct(a["i"].alias("start"), (b["i"] + 1).alias("end")))


def token_ends(tokens: Column) -> Column:
    """The running total of token lengths: where each token ends in the text that they make up."""
    start = F.struct(F.lit(0).alias("total"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, t):
        total = acc["total"] + F.length(t)
        return F.struct(total.alias("total"), F.array_append(acc["out"], total).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def token_span(ends: Column, start: Column, end: Column) -> Column:
    """(start, end) of the tokens that hold the characters from start to end (exclusive; an empty span counts as one
    character), given where each token ends."""
    last = F.greatest(end, start + 1)
    return F.struct(F.size(F.filter(ends, lambda e: e <= start)).alias("start"), (F.size(F.filter(ends, lambda e: e < last)) + 1).alias("end"))


def packed(sizes: Column, limit: int) -> Column:
    """Greedy packing: the pack number of each item, a new pack where the next item would overflow."""
    first = F.struct(F.lit(0).cast("long").alias("pack"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(acc, n):
        new = (acc.used > 0) & (acc.used + n > limit)
        pack = acc.pack + F.when(new, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(pack.alias("pack"), (F.when(new, F.lit(0).cast("long")).otherwise(acc.used) + n).alias("used"), F.array_append(acc.out, pack).alias("out"))

    return F.aggregate(sizes, first, step, lambda acc: acc.out)


def islands(df: DataFrame, groups: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Rows numbered by the runs that begin where `starts` holds, in order within each group."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*groups).orderBy(*order)))


def with_start_token(tokens: Column, start: int) -> Column:
    return F.array_prepend(tokens, F.lit(start))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from md5 of seed and parts; alike on every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def masked_positions(key: Column, n: Column, rate: float, seed: int) -> Column:
    """The positions from 1 to n - 1 whose draw is under the rate; position 0, the start token, is never masked."""
    at = F.when(n > 1, F.sequence(F.lit(1), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: uniform(seed, key, i) < rate)


def span_masks(n: Column, key: Column, rate: float, longest: int, seed: int) -> Column:
    """(start, end) of the spans to mask among n tokens: one in each context, which is as many times 1 / rate tokens as the span
    has. Lengths 1 to `longest` are drawn with odds 1 / length, places evenly; a fold over the contexts of the row."""
    window = int(1 / rate)
    n = n.cast("int")
    odds = [1 / k for k in range(1, longest + 1)]
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("out"))

    def step(acc, _):
        at = acc["at"]
        u = uniform(seed, key, F.lit("n"), at)
        length = F.lit(longest)
        for k in range(longest - 1, 0, -1):
            length = F.when(u < sum(odds[:k]) / sum(odds), k).otherwise(length)
        context = F.least(length * window, n - at)
        first = at + F.floor(uniform(seed, key, F.lit("m"), at) * context).cast("int")
        last = F.least(first + length, n)
        new = F.struct(F.greatest(at + context, last).alias("at"), F.array_append(acc["out"], F.struct(first.alias("start"), last.alias("end"))).alias("out"))
        return F.when(at < n, new).otherwise(acc)

    rounds = F.when(n > 0, F.sequence(F.lit(1), F.ceil(n / F.lit(float(window))).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(rounds, start, step, lambda acc: acc["out"])


def masked_tokens(n: Column, key: Column, rate: float, longest: int, seed: int, mask: float = 0.8, keep: float = 0.1) -> Column:
    """(position, kind) of the masked tokens, in order, until round(n * rate) (one at least): kind is mask, keep or random."""
    spans = span_masks(n, key, rate, longest, seed)
    places = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
    u = lambda i: uniform(seed, key, F.lit("k"), i)
    kind = lambda i: F.when(u(i) < mask, "mask").when(u(i) < mask + keep, "keep").otherwise("random")
    most = F.greatest(F.lit(1), F.bround(n * F.lit(rate), 0).cast("int"))
    return F.transform(F.slice(places, F.lit(1), most), lambda i: F.struct(i.alias("position"), kind(i).alias("kind")))


def padded(values: Column, size: int, fill) -> Column:
    """Cut or filled up to `size`."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(size) - F.size(values)))), 1, size)


def truncate_pair(a: Column, b: Column, limit: int, key: Column | None = None, seed: int = 0) -> Column:
    """Both arrays cut, the longer one first (on ties the first), until they have `limit` together.

    They are cut at their ends; with a key, each cut falls to the front or the end by a seeded draw."""
    n, m = F.size(a), F.size(b)
    over = F.greatest(n + m - limit, F.lit(0))
    first = F.least(over, F.abs(n - m))  # until both are equally long, only the longer one gives
    most, least = first + F.ceil((over - first) / F.lit(2.0)).cast("int"), F.floor((over - first) / F.lit(2.0)).cast("int")
    from_a, from_b = F.when(n >= m, most).otherwise(least), F.when(n >= m, least).otherwise(most)

    def front(side: str, cuts: Column) -> Column:
        if key is None:
            return F.lit(0)
        draws = F.when(cuts > 0, F.sequence(F.lit(1), cuts)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.size(F.filter(draws, lambda k: uniform(seed, key, F.lit(side), k) < 0.5))

    left = lambda x, size, cuts, side: F.slice(x, front(side, cuts) + 1, F.greatest(size - cuts, F.lit(0)))
    return F.struct(left(a, n, from_a, "a").alias("a"), left(b, m, from_b, "b").alias("b"))


def log_bucket(relative: Column, buckets: int, farthest: int) -> Column:
    """Sign-aware relative position: itself up to half the buckets, then by logarithm; from `farthest` on all are alike."""
    import math

    mid = buckets // 2
    relative = F.greatest(F.least(relative, F.lit(farthest - 1)), F.lit(1 - farthest))
    far = F.ceil(F.ln(F.abs(relative) / F.lit(float(mid))) / F.lit(math.log((farthest - 1) / mid)) * (mid - 1)) + mid
    return F.when(F.abs(relative) <= mid, relative.cast("double")).otherwise(far.cast("double") * F.signum(relative)).cast("int")


def weighted_sum(vectors: Column, weights: Column) -> Column:
    """Of an array of equally long vectors, by the softmax of the weights."""
    w = softmax(weights)
    scaled = F.zip_with(vectors, w, lambda v, k: F.transform(v, lambda x: x * k))
    return F.aggregate(F.slice(scaled, 2, F.greatest(F.size(scaled) - 1, F.lit(0))), F.element_at(scaled, 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def mean_vector(df: DataFrame, groups: list[str], vector: str, mask: Column | None = None) -> DataFrame:
    """Element-wise mean of the vectors of each group whose mask holds, as an array; sums are combined before the shuffle."""
    own = df if mask is None else df.where(mask)
    parts = own.select(*groups, F.posexplode(vector).alias("__i", "__x")).groupBy(*groups, "__i").agg(F.avg("__x").alias("__m"))
    return parts.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(vector))


def learning_rate(step: Column, warmup: int | Column, total: int | Column, kind: str, base: float = 1.0) -> Column:
    """Warm-up, then constant, linear or cosine decay, or (cyclic) four cosine waves down a falling line."""
    import math

    warmup, total = (x if isinstance(x, Column) else F.lit(x) for x in (warmup, total))
    some = lambda x: F.greatest(F.lit(1), x).cast("double")
    up = F.least(F.lit(1.0), (step + 1) / some(warmup))
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / some(total - warmup)))
    if kind == "cyclic":
        waves, length = 4, some(F.floor((total - warmup) / F.lit(4)))
        at = step - warmup
        k = F.floor(at / length)
        wave = F.when(F.pmod(k, F.lit(2)) == 0, 1.0).otherwise(-1.0) * F.cos(F.lit(math.pi) * at / length)
        down = F.greatest(F.lit(0.0), 1 - k / F.lit(float(waves)) + (wave - 1) / F.lit(2.0 * waves))
        return F.lit(base) * F.when(step < warmup, step / some(warmup)).otherwise(down)
    decay = {"constant": F.lit(1.0), "linear": 1 - done, "cosine": 0.5 * (1 + F.cos(F.lit(math.pi) * done))}[kind]
    return F.lit(base) * F.when(step < warmup, up).otherwise(decay)


def exposure_plan(rows: Column, prior: Column, batch: Column, passes: Column) -> dict[str, Column]:
    """How training goes on until all rows have been presented `passes` times, `prior` presentations having been made."""
    target = F.ceil(rows * passes)
    steps = F.ceil(F.greatest(F.lit(0).cast("long"), target - prior) / batch)
    final = prior + steps * batch
    return {"target_examples": target, "additional_steps": steps, "additional_examples": steps * batch, "final_examples": final, "prior_passes": prior / rows, "final_passes": final / rows}
