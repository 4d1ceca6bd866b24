"""License scans by canonical digest: whole texts, normalised and hashed, hash-joined to the digests of known licences.

The canonical form drops lines that are copyright statements and nothing more, lower-cases A-Z, makes every run of punctuation
and white space one space, and writes equivalent spellings one way. DataFrame functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table
from .license_texts import KNOWN, SPELLINGS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"^[\x00-\x27\x29-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Patterns of one line as it is written; Java and RE2 read them alike. A copyright statement has a form: after marks such as * or
#: #, the word or the sign; years; the holder, whose words are names (capitals first), a few joining words, addresses; perhaps
#: `All rights reserved`; and nothing more. So what a line says after that makes it a clause, whatever its words, and a holder may
#: be called May or Use. Without a year or sign the word must not be followed by one of a licence's own sentences, which may start
#: a line where a text is wrapped. Lines without any capital, or without any small letter, have no names to go by: in these no word
#: of a clause may stand, and in the first at most five words for the holder.
_MARKS = r"[\x00-\x27\x29-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_LEAD = r"(?i:copyrights?(?:[ \t]+notices?)?:?|copr\.|\(c\)|©)"
_YEAR = r"[12][0-9]{3}(?:[ \t]*[-–—][ \t]*(?:[0-9]{2,4}|(?i:present|now)))?"
_LEADS = rf"{_LEAD}(?:[ \t]*(?:{_LEAD}|{_YEAR}|[,;&]|(?i:and\b)))*"
_NAME = r"[\p{Lu}\p{Lt}\p{Lo}0-9][^\s:;.,()<>]*(?:\.[^\s:;.,()<>]+)*|(?:\p{Lu}\.)+|(?:Inc|Ltd|Co|Corp|Jr|Sr|Dr|St|LLC|Mr|Ms|S\.A|B\.V|S\.p\.A|GmbH|e\.V)\."
_JOIN = r"(?i:and|of|the|by|for|de|da|di|del|della|la|le|van|von|der|den|dos|du|y|et|al\.?|contributors?|authors?|developers?|maintainers?|project|team|others|members|foundation|its|respective|owners?|holders?)\b"
_CONTACT = r"<[^>\s]*>|\([^()\s]+\)|[^\s<>()]+@[^\s<>()]+|https?://[^\s]+|www\.[^\s]+"
_TOKEN = rf"(?:{_JOIN}|{_CONTACT}|{_NAME})"
_BETWEEN = r"(?:,?[ \t]+(?:[-–—&|/][ \t]+)?|,)"
_RESERVED = r"(?:[ \t.,;]*(?i:all rights reserved))?"
_STATEMENT = rf"^{_MARKS}{_LEADS}[ \t]*(?:{_TOKEN}(?:{_BETWEEN}{_TOKEN})*)?[.,]?{_RESERVED}{_MARKS}$"
_PLAIN = rf"^{_MARKS}{_LEADS}[ \t]*(?:[^\s:;.()]+[.,]?[ \t]*){{0,5}}{_RESERVED}{_MARKS}$"
_WORD = rf"^{_MARKS}(?i:copyrights?\b|copr\.|©)"
_DATED = r"(?:^|[^0-9])(?:19|20)[0-9][0-9](?:[^0-9]|$)|©|\((?i:c)\)"
_YEARED = r"(?:^|[^0-9])(?:19|20)[0-9][0-9](?:[^0-9]|$)"
_SENTENCE = rf"^{_MARKS}(?i:copyrights?(?:[^a-z0-9]*$|[^a-z0-9]+(?:notices?|holders?|owners?|laws?|interests?|statements?|licen[cs]es?|infringements?|protections?|acts?|treaty|treaties|rights?|claims?|works?|and|or|in|is|are|to|of|as|for|that|which)(?:[^a-z]|$)))"
_CLAUSE = r"(?i:(?:^|[^a-z])(?:may|must|shall|not|permission|permitted|forbidden|prohibited|requires?|required|use|uses|using|subject|without|provided|only|costs?|pays?|sell|redistribution|conditions?|agree|license[ds]?|licence[ds]?)(?:[^a-z]|$))"
_RIGHTS = rf"^{_MARKS}(?i:all rights reserved)[^A-Za-z0-9]*$"
#: A statement without its holder yet, at the end of a line: the holder is on the next.
_OPEN = r"(?im)^([^A-Za-z0-9\n(©]*(?:copyrights?|copr\.|\(c\)|©)(?:[ \t]*(?:copyrights?|\(c\)|©|[12][0-9]{3}|[-–—,;&]|and\b|by\b|present\b))*)[ \t\r]*\n[ \t*#/;%-]*(\p{Lu})"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©‐-―‘-”]+"


def _is_statement(line: Column) -> Column:
    """Whether a line is a copyright statement and nothing more."""
    started = line.rlike(_WORD) & (line.rlike(_DATED) | ~line.rlike(_SENTENCE)) | line.rlike(_YEARED)
    one_case = ~line.rlike(r"\p{Ll}") | ~line.rlike(r"\p{Lu}")
    formed = F.when(one_case, (line.rlike(_STATEMENT) & line.rlike(r"\p{Lu}") | line.rlike(_PLAIN)) & ~line.rlike(_CLAUSE)).otherwise(line.rlike(_STATEMENT))
    return started & formed | line.rlike(_RIGHTS)


def canonical(text: Column) -> Column:
    """The canonical form; null is the empty text."""
    own = F.coalesce(text, F.lit(""))
    out = F.translate(own, _UPPER, _LOWER)
    marked = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("copr.")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("all rights"))
    kept = F.filter(F.split(F.regexp_replace(own, _OPEN, "$1 $2"), "\n"), lambda line: ~_is_statement(line))
    out = F.when(marked, F.translate(F.array_join(kept, "\n"), _UPPER, _LOWER)).otherwise(out)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, _GAP, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a}"), F.lit(f" {b}"))
    return F.trim(out)


def known_digests(spark, known=None) -> DataFrame:
    """canonical_sha256 and license of the known texts (license, text); of two names for one text the first by name."""
    frame = spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    return frame.groupBy(F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256 and license (null if the text is none of the known ones) of every document.

    A null text is the empty text, whose digest no licence has. Repeated rows and null ids pass through; other columns are
    not read; an empty table gives an empty table. The join is by digest, so copies of one text may be split by size.
    """
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text").cast("string")), 256).alias("canonical_sha256"))
    return digests.join(known, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_canonical(text: str) -> str:
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    has = lambda p: f"regexp_matches(l, '{p}')"
    started = f"({has(_WORD)} AND ({has(_DATED)} OR NOT {has(_SENTENCE)}) OR {has(_YEARED)})"
    small, capital = has(r"\p{Ll}"), has(r"\p{Lu}")
    formed = f"CASE WHEN NOT {small} OR NOT {capital} THEN ({has(_STATEMENT)} AND {capital} OR {has(_PLAIN)}) AND NOT {has(_CLAUSE)} ELSE {has(_STATEMENT)} END"
    joined = f"regexp_replace(coalesce({text}, ''), '{_OPEN}', '\\1 \\2', 'g')"
    out = lower(f"array_to_string(list_filter(string_split({joined}, chr(10)), lambda l: NOT ({started} AND ({formed}) OR {has(_RIGHTS)})), chr(10))")
    out = f"' ' || trim(regexp_replace({out}, '{_GAP}', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a}', ' {b}')"
    return f"trim({out})"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
WITH known(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}),
k AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license) AS license FROM known GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS canonical_sha256 FROM documents)
SELECT d.doc_id, d.canonical_sha256, k.license FROM d LEFT JOIN k ON k.digest = d.canonical_sha256
"""
