"""Quality rules, line first: each line is judged on its own, lines that fail go, and a document that loses too much goes too.

Rules of a line, first that holds: *punctuation* (three words or more, of which 3 in 10 carry a run of two or more signs such
as *** or %%, or end in a run of ! or ?; or no letter or digit at all; or one or two words without a closing mark),
*navigation* (two separators or more that stand alone, one for every four words at least), *boilerplate* (a stock phrase of
cookie bars, legal footers or sign-up boxes in a short line; one word that makes up half of ten words or more; a line equal to
an earlier one of the text). Beside these stand base rules on the whole text. A document that passes the base rules is kept
unless the lines that go hold more than MAX_LOST percent of the code points of its words.

All counts are exact except that words and windows are compared by 64-bit hashes (n * n / 2^64 for a text of n words).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, slices, string_buffer, table
from ._words import byte_set, span_hashes, spans

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_LOST = 30

#: Patterns of words and lines; Python's re and RE2 read them alike.
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[#*$%&|<>=~^_+@\x5C]{2,}|[!?]{2,}[.,;:]*$"
SEPARATOR = r"^(?:[|/>~•·»›]|::|>>|--)$"
LETTER = r"[A-Za-z0-9]|[^\x00-\x7F]"
CLOSED = r"[.!?:;…。！？][\"')\x5D”’»]*$"
#: Stock phrases, in lower case.
STOCK = (
    r"accept (?:all )?cookies|uses? cookies|cookie (?:policy|settings|preferences)|privacy policy|terms (?:of|and) (?:use|service|conditions)"
    r"|all rights reserved|enable javascript|javascript is (?:disabled|required)|lorem ipsum|sign up (?:for|to) our|subscribe to our|newsletter"
    r"|follow us on|share (?:this|on)|click here|read more|skip to (?:main )?content|back to top|powered by|log ?in to|terms apply"
)
STOCK_WORDS = 20

_WORD, _SIGNS, _SEPARATOR, _LETTER, _CLOSED, _STOCK = (re.compile(x) for x in (WORD, SIGNS, SEPARATOR, LETTER, CLOSED, STOCK))
_BLANK = byte_set(0x20, *range(0x09, 0x0E))
_SYMBOL = byte_set(*b"#*$%&|<>")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = ("", "punctuation", "navigation", "boilerplate")


def line_rule(line: str) -> tuple[int, int]:
    """Number in RULES of the rule that the line fails, and the code points of its words; a line without a word fails none."""
    words = _WORD.findall(line)
    n, chars = len(words), sum(map(len, words))
    if not n:
        return 0, 0
    if not _LETTER.search(line) or n < 3 and not _CLOSED.search(words[-1]) or n >= 3 and 10 * sum(_SIGNS.search(w) is not None for w in words) >= 3 * n:
        return 1, chars
    separators = sum(_SEPARATOR.search(w) is not None for w in words)
    if separators >= 2 and 4 * separators >= n:
        return 2, chars
    if n <= STOCK_WORDS and _STOCK.search(line.translate(_LOW)) or n >= 10 and 2 * max(Counter(words).values()) >= n:
        return 3, chars
    return 0, chars


@lru_cache(1 << 14)
def _short_line_rule(line: str) -> tuple[int, int]:
    return line_rule(line)


def clean_lines(text: str) -> tuple[str, list[int], int]:
    """The lines that stay; how many lines fail each of RULES (at 0: the repeats); code points of words that go."""
    kept, failed, lost, seen = [], [0] * len(RULES), 0, set()
    for line in text.split("\n"):
        rule, chars = _short_line_rule(line) if len(line) < 200 else line_rule(line)
        if not chars:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        if again or rule:
            failed[0 if again else rule] += 1
            lost += chars
        else:
            kept.append(line)
    return "\n".join(kept), failed, lost


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of every text, from its bytes; a null text is empty."""
    data, offsets = string_buffer(texts)
    start, end = spans(data, offsets, _BLANK)
    first = np.searchsorted(start, offsets)
    n_words = np.diff(first)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    points, symbols = upto((data & 0xC0 != 0x80) & ~_BLANK[data]), upto(_SYMBOL[data])
    text = np.repeat(np.arange(len(texts)), n_words)
    repeated = np.zeros(len(start), bool)
    if len(start) > 2:
        h = span_hashes(data, start, end)
        window = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        whole = np.flatnonzero(text[:-2] == text[2:])
        order = whole[np.lexsort((window[whole], text[whole]))]
        same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        for k in range(3):
            repeated[order[again] + k] = True
    return {
        "n_words": n_words,
        "word_chars": np.diff(points[offsets]),
        "n_symbols": np.diff(symbols[offsets]),
        "n_repeat_words": np.diff(upto(repeated)[first]),
    }


COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
    " n_punctuation long, n_navigation long, n_boilerplate long, n_lost_chars long, cleaned string"
)


def judged(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """COLUMNS for every document (cleaned only if asked for: the lines that stay, whatever the verdict).

    A null, empty or blank text has no word: all counts are 0 and it fails the base. Texts are read whole, in steps of bounded
    bytes; rows do not meet, so repeated rows and null ids each get their own verdict. Columns other than doc_id and text are
    not read; an empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                base = base_counts(part.column(1))
                lines = [clean_lines(t or "") for t in part.column(1).to_pylist()]
                n = base["n_words"]
                bad = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED * n)
                failed = np.array([f for _, f, _ in lines], np.int64).reshape(-1, len(RULES))
                lost = np.array([x for _, _, x in lines], np.int64)
                columns = [part.column(0), n, base["word_chars"], base["n_symbols"], failed[:, 0], base["n_repeat_words"], bad, ~bad & (100 * lost <= MAX_LOST * base["word_chars"])]
                columns += [failed[:, 1], failed[:, 2], failed[:, 3], lost, pa.array([t if with_text else None for t, _, _ in lines], pa.string())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[c.split()[0] for c in COLUMNS.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), COLUMNS)


def clean(docs: DataFrame) -> DataFrame:
    """doc_id and the cleaned text of the documents that are kept."""
    return judged(docs).where("kept").select("doc_id", F.col("cleaned").alias("text"))


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), with_text=False).drop("cleaned")


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    count = lambda pattern: f"len(list_filter(w, lambda x: regexp_matches(x, {q(pattern)})))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
wd AS (SELECT i, doc_id, text, regexp_extract_all(text, {q(WORD)}) AS w FROM d),
pos AS (SELECT i, w, unnest(range(1, len(w) - 1)) AS p FROM wd),
win AS (SELECT i, p, count(*) OVER (PARTITION BY i, w[p], w[p + 1], w[p + 2]) AS c FROM pos),
rep AS (SELECT i, count(DISTINCT p + k) AS n_repeat_words FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY i),
ln AS (SELECT i, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
lw AS (SELECT i, line_no, line, regexp_extract_all(line, {q(WORD)}) AS w, row_number() OVER (PARTITION BY i, line ORDER BY line_no) AS nth FROM ln),
judged AS (
  SELECT i, nth, list_sum(list_transform(w, lambda x: length(x))) AS chars,
    CASE WHEN NOT regexp_matches(line, {q(LETTER)}) OR len(w) < 3 AND NOT regexp_matches(w[-1], {q(CLOSED)}) OR len(w) >= 3 AND 10 * {count(SIGNS)} >= 3 * len(w) THEN 1
      WHEN {count(SEPARATOR)} >= 2 AND 4 * {count(SEPARATOR)} >= len(w) THEN 2
      WHEN len(w) <= {STOCK_WORDS} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {q(STOCK)})
        OR len(w) >= 10 AND 2 * list_max(map_values(list_histogram(w))) >= len(w) THEN 3
      ELSE 0 END AS rule
  FROM lw WHERE len(w) > 0),
l AS (
  SELECT i, count(*) FILTER (nth > 1) AS n_dup_lines, count(*) FILTER (nth = 1 AND rule = 1) AS n_punctuation, count(*) FILTER (nth = 1 AND rule = 2) AS n_navigation,
    count(*) FILTER (nth = 1 AND rule = 3) AS n_boilerplate, coalesce(sum(chars) FILTER (nth > 1 OR rule > 0), 0) AS n_lost_chars
  FROM judged GROUP BY i),
b AS (
  SELECT wd.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_punctuation, 0)::BIGINT AS n_punctuation, coalesce(n_navigation, 0)::BIGINT AS n_navigation, coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate, coalesce(n_lost_chars, 0)::BIGINT AS n_lost_chars
  FROM wd LEFT JOIN rep USING (i) LEFT JOIN l USING (i))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * n_lost_chars <= {MAX_LOST} * word_chars AS kept FROM b
"""


SQL = _sql()
