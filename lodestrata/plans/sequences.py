"""Queries over token sequences: spans in windows, padding, truncation, masks and byte-level pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import spans as P
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


WORD = r"[^\x20\x09-\x0D]+"
#: Windows of 32 words that overlap by 8.
SIZE, OVERLAP = 32, 8

_SPANS = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
u AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM t),
c AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM u WHERE regexp_matches(x, '^[A-Z]')),
s AS (SELECT doc_id, min(i) AS s, max(i) + 1 AS e FROM c GROUP BY doc_id, run),
win AS (SELECT doc_id, o AS ws, least(o + {SIZE}, n) AS we FROM (SELECT doc_id, len(w) AS n, unnest(CASE WHEN len(w) <= {SIZE} THEN [0] ELSE range(0, len(w), {SIZE - OVERLAP}) END) AS o FROM t))"""


def entity_parts(spark, d):
    """Spans (runs of capitalised words) and windows of all whole texts."""
    own = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), 1).alias("w"))
    # the flags stand in a column of their own, since `runs` looks at them more than once
    own = own.select("doc_id", F.size("w").alias("n"), F.transform("w", lambda x: x.rlike("^[A-Z]")).alias("capital"))
    spans = own.select("doc_id", F.inline(X.runs(F.col("capital"))))
    windows = own.select("doc_id", F.explode(X.covering_windows(F.col("n"), SIZE, OVERLAP)).alias("x")).select("doc_id", F.col("x.start").alias("w_start"), F.col("x.end").alias("w_end"))
    return spans, windows, P.contained(spans, windows, ["doc_id"], SIZE)


@query("entity_windows", _SPANS + " SELECT win.doc_id, CAST(ws AS INTEGER) AS w_start, CAST(we AS INTEGER) AS w_end, coalesce(string_agg((s - ws) || '-' || (e - ws), ',' ORDER BY s) FILTER (s IS NOT NULL), '') AS spans FROM win LEFT JOIN s ON s.doc_id = win.doc_id AND s >= ws AND e <= we GROUP BY ALL")
def entity_windows(spark, d):
    """Windows of whole texts with the spans that lie fully inside."""
    _, windows, inside = entity_parts(spark, d)
    text = lambda x: F.concat(x.start.cast("string"), F.lit("-"), x.end.cast("string"))
    return P.windows_with_spans(windows, inside, ["doc_id"]).withColumn("spans", F.array_join(F.transform("spans", text), ","))


@query("entity_spans_dropped", _SPANS + " SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\" FROM s WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.doc_id = s.doc_id AND s.s >= ws AND s.e <= we)")
def entity_spans_dropped(spark, d):
    """A row for each span that no window holds."""
    spans, _, inside = entity_parts(spark, d)
    return P.left_out(spans, inside, ["doc_id"])


@query("entity_token_spans", r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '[^ ]+ ?| +') AS w FROM benchmark), u AS (SELECT item_id, w, unnest(range(len(w))) AS i FROM t WHERE len(w) > 2)
SELECT item_id, CAST(i AS INTEGER) AS start, CAST(least(i + 2, len(w)) AS INTEGER) AS "end" FROM u WHERE i % 3 = 0""")
def entity_token_spans(spark, d):
    """Character spans of every third token and the one after it, mapped back to tokens."""
    own = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"([^ ]+ ?| +)"), 1).alias("w")).where(F.size("w") > 2)
    own = own.withColumn("ends", X.token_ends(F.col("w")))
    end = lambda i: F.coalesce(F.get("ends", F.least(i, F.size("w") - 1)), F.lit(0))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: i % 3 == 0)
    chars = F.transform(at, lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(end(i - 1)).alias("s"), (end(i + 1) - 1).alias("e")))
    own = own.select("item_id", "ends", F.explode(chars).alias("c"))
    return own.select("item_id", X.token_span(F.col("ends"), F.col("c.s"), F.col("c.e")).alias("t")).select("item_id", "t.start", "t.end")


_DRAW = "CAST('0x' || substr(md5('{seed}|' || {key} || '|{side}|' || k), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.5"
_CONV_KEY = "(conv_id || ':' || turn)"


@query("truncated_pairs_random", rf"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM conversations),
w AS (SELECT conv_id, turn, {_CONV_KEY} AS key, regexp_extract_all(coalesce(text, ''), '{WORD}') AS a, regexp_extract_all(after, '{WORD}') AS b FROM t WHERE after IS NOT NULL),
o AS (SELECT *, len(a) AS n, len(b) AS m, greatest(len(a) + len(b) - 24, 0) AS over, least(greatest(len(a) + len(b) - 24, 0), abs(len(a) - len(b))) AS f FROM w),
c AS (SELECT *, CAST(CASE WHEN n >= m THEN f + ceil((over - f) / 2.0) ELSE floor((over - f) / 2.0) END AS BIGINT) AS ca, CAST(CASE WHEN n >= m THEN floor((over - f) / 2.0) ELSE f + ceil((over - f) / 2.0) END AS BIGINT) AS cb FROM o),
g AS (SELECT *, len(list_filter(range(1, ca + 1), lambda k: {_DRAW.format(seed=41, key='key', side='a')})) AS fa, len(list_filter(range(1, cb + 1), lambda k: {_DRAW.format(seed=41, key='key', side='b')})) AS fb FROM c)
SELECT conv_id, turn, array_to_string(a[fa + 1 : fa + n - ca], ' ') AS a, array_to_string(b[fb + 1 : fb + m - cb], ' ') AS b FROM g""")
def truncated_pairs_random(spark, d):
    """Each turn and the one after it in 24 words together; each cut falls to the front or the end by a seeded draw."""
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    own = table(spark, d, "conversations").withColumn("after", after).where("after is not null")
    words = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), 1)
    key = F.concat_ws(":", "conv_id", "turn")
    cut = own.select("conv_id", "turn", X.truncate_pair(words("text"), words("after"), 24, key, 41).alias("t"))
    return cut.select("conv_id", "turn", F.array_join("t.a", " ").alias("a"), F.array_join("t.b", " ").alias("b"))


_U = "CAST('0x' || substr(md5('53|' || doc_id || '|{kind}|' || {at}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("span_masked_tokens", rf"""WITH RECURSIVE t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
r AS (
  SELECT doc_id, n, 0::BIGINT AS o, 0::BIGINT AS s, 0::BIGINT AS e FROM t
  UNION ALL
  SELECT doc_id, n, greatest(o + ctx, least(o + m + g, n)), o + m, least(o + m + g, n) FROM (
    SELECT *, CAST(floor({_U.format(kind="m", at="o")} * ctx) AS BIGINT) AS m FROM (
      SELECT *, least(g * 6, n - o) AS ctx FROM (
        SELECT *, CASE WHEN u < 1 / (1 + 1 / 2.0::DOUBLE + 1 / 3.0::DOUBLE) THEN 1 WHEN u < (1 + 1 / 2.0::DOUBLE) / (1 + 1 / 2.0::DOUBLE + 1 / 3.0::DOUBLE) THEN 2 ELSE 3 END AS g FROM (
          SELECT doc_id, n, o, {_U.format(kind="n", at="o")} AS u FROM r WHERE o < n))))),
p AS (SELECT doc_id, n, unnest(range(s, e)) AS position FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS nth FROM p)
SELECT doc_id, CAST(position AS INTEGER) AS position, CASE WHEN {_U.format(kind="k", at="position")} < 0.8::DOUBLE THEN 'mask' WHEN {_U.format(kind="k", at="position")} < 0.9::DOUBLE THEN 'keep' ELSE 'random' END AS kind
FROM k WHERE nth <= greatest(1, round_even(n * 0.15::DOUBLE, 0))""")
def span_masked_tokens(spark, d):
    """Masked positions of whole texts, by spans of one to three words in contexts of six words each."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), 1))
    own = table(spark, d, "documents").select("doc_id", n.alias("n"))
    return own.select("doc_id", F.inline(X.masked_tokens(F.col("n"), F.col("doc_id"), 0.15, 3, 53)))


#: The first 35 merges of a published byte-level vocabulary, in order of rank.
MERGES = [
    ("Ġ", "t"), ("Ġ", "a"), ("h", "e"), ("i", "n"), ("r", "e"), ("o", "n"), ("Ġt", "he"), ("e", "r"), ("Ġ", "s"), ("a", "t"), ("Ġ", "w"), ("Ġ", "o"),
    ("e", "n"), ("Ġ", "c"), ("i", "t"), ("i", "s"), ("a", "n"), ("o", "r"), ("e", "s"), ("Ġ", "b"), ("e", "d"), ("Ġ", "f"), ("in", "g"), ("Ġ", "p"),
    ("o", "u"), ("Ġa", "n"), ("a", "l"), ("a", "r"), ("Ġt", "o"), ("Ġ", "m"), ("Ġo", "f"), ("Ġ", "in"), ("Ġ", "d"), ("Ġ", "h"), ("Ġan", "d"),
]

_HIDDEN = "range(0, 33) || range(127, 161) || [173]"
_LETTER = f"(CASE WHEN list_contains({_HIDDEN}, b) THEN chr(CAST(255 + list_position({_HIDDEN}, b) AS INTEGER)) ELSE chr(CAST(b AS INTEGER)) END)"
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+".replace("'", "''")


@query("byte_pieces", f"""WITH RECURSIVE m(rank, a, b) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(MERGES))}),
p AS (SELECT item_id, unnest(regexp_extract_all(text, '{_PIECES}')) AS piece, unnest(range(len(regexp_extract_all(text, '{_PIECES}')))) AS i FROM benchmark),
d AS (SELECT DISTINCT piece FROM p),
x AS (SELECT piece, k, CAST('0x' || substr(h, k, 2) AS BIGINT) AS b FROM (SELECT piece, h, unnest(range(1, length(h), 2)) AS k FROM (SELECT piece, hex(encode(piece)) AS h FROM d))),
l AS (SELECT piece, string_agg('◀' || {_LETTER} || '▶', '' ORDER BY k) AS s FROM x GROUP BY piece),
r AS (SELECT piece, s FROM l UNION ALL SELECT piece, replace(s, '◀' || a || '▶◀' || b || '▶', '◀' || a || b || '▶') FROM (SELECT piece, s, (SELECT min(rank) FROM m WHERE contains(s, '◀' || a || '▶◀' || b || '▶')) AS first FROM r) JOIN m ON rank = first),
e AS (SELECT piece, s FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE contains(s, '◀' || a || '▶◀' || b || '▶')))
SELECT item_id, string_agg(replace(replace(replace(s, '▶◀', ' '), '◀', ''), '▶', ''), ' ' ORDER BY i) AS pieces FROM p JOIN e USING (piece) GROUP BY item_id""")
def byte_pieces(spark, d):
    """Byte-level tokens of whole texts by the merges above."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.byte_pieces(F.col("text"), MERGES), " ").alias("pieces"))
