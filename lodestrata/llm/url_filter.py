"""URL filters: host suffixes and path prefixes, looked up by short hash prefixes and confirmed by full digests.

A URL is expanded into every host suffix at a label border, joined to every prefix of its path whose length some rule has.
The digests' first four bytes are the keys of an equi-join with the rules' digests; a full digest confirms a match, and of
the rules that fit the longest wins. Distinct (host, path) pairs are expanded once, so one URL on a third of all rows costs
no more than one on a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
KEY_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_frame(spark, rules=None) -> DataFrame:
    """verdict, host and path of each rule as a table; rules may also come from files of these columns."""
    return spark.createDataFrame(RULES if rules is None else rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    Of rules that fit, the longest (host and path together) wins, on a tie the longer host, then `block`. A null URL, or one
    without ://, has an empty host and path and gets the default with a null rule. Repeated rows stay repeated; null ids
    stay null; other columns are not read; rules with a null field are ignored, and so is a rule with an empty host.
    """
    spark = pages.sparkSession
    clean = rules.where("verdict is not null and path is not null and host is not null and host <> ''").select("verdict", F.lower("host").alias("rule_host"), F.col("path").alias("rule_path")).distinct()
    lengths = [r[0] for r in clean.select(F.length("rule_path")).distinct().orderBy(1).collect()]  # at most the longest path
    if not lengths:
        clean = spark.createDataFrame([], clean.schema)
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths or [0]]), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    pairs = urls.where("host <> ''").select("host", "path").distinct()
    expressions = pairs.select("host", "path", F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\0"), p))))).alias("expression"))
    digest = F.sha2("expression", 256)
    probes = expressions.select("host", "path", digest.alias("digest")).withColumn("key", F.substring("digest", 1, KEY_DIGITS))
    table_ = clean.withColumn("rule_digest", F.sha2(F.concat("rule_host", F.lit("\0"), "rule_path"), 256)).withColumn("key", F.substring("rule_digest", 1, KEY_DIGITS))
    hits = probes.join(table_, "key").where("digest = rule_digest")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "block")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_frame(spark))


_HOST = r"translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
SQL = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(verdict, h, p) AS (VALUES {", ".join(str(x) for x in RULES)}),
m AS (SELECT DISTINCT u.host, u.path, r.verdict, r.h || r.p AS rule,
    row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.h) + length(r.p) DESC, length(r.h) DESC, r.verdict = 'block' DESC) AS n
  FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = r.h OR u.host LIKE '%.' || r.h) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, '{DEFAULT}') AS verdict
FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path AND m.n = 1
"""
