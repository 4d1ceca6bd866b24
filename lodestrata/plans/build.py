"""Queries that build, clean and join labelled data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins as J
from ..operators import labels as L
from ..operators import profile as P
from ..operators import splits as S
from ..sources import sinks
from ..sources.tables import shard_counts, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def measurements(spark, d):
    """The events as measurements: the label of (user, day) under an event type."""
    e = table(spark, d, "events")
    label = L.priority_label([(F.col("event_type") == "error", 0), (F.col("value") >= 60, 1), (F.col("value") <= 40, 0)])
    return e.select("user_id", F.to_date("ts").alias("day"), "event_type", label.alias("label"))


_CTE = """m AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, CASE WHEN event_type = 'error' THEN 0 WHEN value >= 60 THEN 1 WHEN value <= 40 THEN 0 END AS label FROM events),
c AS (SELECT user_id, day, event_type, min(label) AS label FROM m WHERE label IS NOT NULL GROUP BY ALL HAVING min(label) = max(label))"""
KEYS = ["user_id", "day", "event_type"]


@query("label_build", f"""WITH {_CTE}, k AS (SELECT * FROM c WHERE substr(md5('7|' || user_id), 1, 1) NOT IN ('0', '1')),
g AS (SELECT event_type FROM k GROUP BY 1 HAVING count(DISTINCT (user_id, day)) >= 20), f AS (SELECT k.* FROM k SEMI JOIN g USING (event_type)),
n AS (SELECT count(DISTINCT (user_id, day)) AS n FROM f)
SELECT event_type, count(*) AS observed, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, any_value(n) - count(*) AS missing,
round(count(*) / any_value(n), 9) AS density, round(count(*) FILTER (label = 1) / count(*), 9) AS prevalence, (count(*) FILTER (label = 1) = 0 OR count(*) FILTER (label = 0) = 0) AS is_constant
FROM f, n GROUP BY event_type""")
def label_build(spark, d):
    """Label, drop contradictions, remove held-out users, keep well-covered types, profile each type."""
    clean = L.without_contradictions(measurements(spark, d), KEYS)
    users = clean.select("user_id").distinct().where(F.substring(S.hash_order(7, F.col("user_id")), 1, 1).isin("0", "1"))
    kept = L.with_enough_members(L.without_members(clean, users, ["user_id"]), "event_type", ["user_id", "day"], 20)
    total = kept.agg(F.count_distinct("user_id", "day").alias("n_rows"))
    return L.label_profile(kept.crossJoin(total), "event_type", "label", F.max("n_rows"))


@query("contradiction_free_pairs", f"WITH {_CTE} SELECT user_id, CAST(day AS VARCHAR) AS day, event_type, label FROM c")
def contradiction_free_pairs(spark, d):
    return L.without_contradictions(measurements(spark, d), KEYS).withColumn("day", F.col("day").cast("string"))


_WIDE = ", ".join(f"max(label) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase"))


@query("label_matrix_wide", f"""WITH {_CTE}, w AS (SELECT user_id, event_type, min(label) AS label FROM m WHERE label IS NOT NULL GROUP BY ALL HAVING min(label) = max(label)) SELECT user_id, {_WIDE} FROM w GROUP BY 1""")
def label_matrix_wide(spark, d):
    """A row for each user: the labels that agree over all days."""
    own = L.without_contradictions(measurements(spark, d), ["user_id", "event_type"])
    return L.label_matrix(own, "user_id", "event_type", "label", ["click", "error", "purchase"])


@query("label_matrix_by_day", f"""WITH {_CTE} SELECT user_id, CAST(day AS VARCHAR) AS day, {", ".join(f"max(label) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase"))} FROM c GROUP BY 1, 2""")
def label_matrix_by_day(spark, d):
    """The matrix over all days: a row for each user and day."""
    own = L.without_contradictions(measurements(spark, d), KEYS)
    return L.label_matrix(own, ["user_id", "day"], "event_type", "label", ["click", "error", "purchase"]).withColumn("day", F.col("day").cast("string"))


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("part_id"), F.col("text").alias("part"))


@query("contains_benchmark", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contains_benchmark(spark, d):
    return J.containing_pairs(*_texts(spark, d)).select(F.col("text_id").alias("doc_id"), F.col("part_id").alias("item_id"))


@query("decontaminate_documents", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def decontaminate_documents(spark, d):
    hits = J.containing_pairs(*_texts(spark, d)).select(F.col("text_id").alias("doc_id"))
    return L.without_members(table(spark, d, "documents").select("doc_id", "source"), hits, ["doc_id"])


@query("sparse_label_profile", """SELECT source, count(quality) AS observed, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative, count(*) - count(quality) AS missing,
round(count(quality) / count(*), 9) AS density, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 9) AS prevalence, count(quality) > 0 AND (count(*) FILTER (quality = 1) = 0 OR count(*) FILTER (quality = 0) = 0) AS is_constant
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def sparse_label_profile(spark, d):
    both = J.many_to_one(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])
    return L.label_profile(both, "source", "quality", F.count("*"))


@query("label_histogram", f"WITH {_CTE}, s AS (SELECT count(*) AS observed FROM c GROUP BY user_id, day) SELECT observed, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 9) AS fraction FROM s GROUP BY 1")
def label_histogram(spark, d):
    return P.count_of_counts(L.without_contradictions(measurements(spark, d), KEYS), ["user_id", "day"])


_Q = ", ".join(f"round(quantile_cont({{0}}, {q}), 6) AS {n}" for q, n in ((0.05, "q05"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.95, "q95")))


@query("numeric_summary", f"SELECT l_returnflag, count(l_quantity) AS n, round(min(l_quantity), 6) AS min, {_Q.format('l_quantity')}, round(max(l_quantity), 6) AS max, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def numeric_summary(spark, d):
    return P.summary(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


@query("priority_reason_audit", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'error event' WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL THEN 'no number' WHEN value > 40 AND value < 60 THEN 'undecided' ELSE '' END AS reason,
round(log10(value + 0.001), 6) AS log_value FROM events""")
def priority_reason_audit(spark, d):
    e = table(spark, d, "events")
    k = X.to_number(F.get_json_object("props", "$.k"))
    rows = L.with_reason(e, [("error event", F.col("event_type") == "error"), ("no number", k.isNull()), ("undecided", (F.col("value") > 40) & (F.col("value") < 60))])
    return rows.select("event_id", "reason", F.round(X.log10_offset(F.col("value")), 6).alias("log_value"))


@query("validated_join_m2o", "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def validated_join_m2o(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    both = J.many_to_one(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), orders, ["l_orderkey"])
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("validated_join_o2o", "SELECT d.doc_id, d.n_chars AS n_chars_a, length(d.text) AS n_chars_b FROM documents d")
def validated_join_o2o(spark, d):
    docs = table(spark, d, "documents")
    return J.one_to_one(docs.select("doc_id", "n_chars"), docs.select("doc_id", F.length("text").cast("long").alias("n_chars")), ["doc_id"])


@query("left_zero_fill", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def left_zero_fill(spark, d):
    return J.zero_filled_counts(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("capped_representatives", "SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def capped_representatives(spark, d):
    return J.first_per_key(table(spark, d, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"], 10)


_CANON = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query("full_pairs", f"WITH k AS (SELECT doc_id, md5({_CANON}) AS k FROM documents) SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM k a JOIN k b USING (k) WHERE a.doc_id < b.doc_id")
def full_pairs(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.md5(X.canonical_text(F.col("text"))).alias("k"))
    return J.pairs_by_key(k.select("k", F.col("doc_id").alias("left_id")), k.select("k", F.col("doc_id").alias("right_id")), "k").where("left_id < right_id").select("left_id", "right_id")


@query("overlap_by_key_type", f"""WITH k AS (SELECT doc_id, lang, md5(text) AS exact, md5({_CANON}) AS canonical FROM documents), l AS (SELECT doc_id, lang, 'exact' AS key_type, exact AS k FROM k UNION ALL SELECT doc_id, lang, 'canonical', canonical FROM k)
SELECT key_type, count(*) AS n_rows, count(*) FILTER (m > 0) AS n_overlap, round(count(*) FILTER (m > 0) / count(*), 9) AS fraction, CAST(sum(m) AS BIGINT) AS n_matches FROM (SELECT a.doc_id, a.key_type, count(b.doc_id) AS m FROM l a LEFT JOIN l b ON a.k = b.k AND a.key_type = b.key_type AND b.doc_id % 2 = 0 WHERE a.doc_id % 2 = 1 GROUP BY ALL) GROUP BY 1""")
def overlap_by_key_type(spark, d):
    """Leakage summary: odd documents against even ones, by kind of key."""
    k = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit("exact").alias("key_type"), F.md5("text").alias("k")), F.struct(F.lit("canonical").alias("key_type"), F.md5(X.canonical_text(F.col("text"))).alias("k")))).alias("x")).select("doc_id", "x.*")
    counts = k.where("doc_id % 2 = 0").groupBy("key_type", "k").agg(F.count("*").alias("m"))
    rows = k.where("doc_id % 2 = 1").join(counts, ["key_type", "k"], "left").groupBy("key_type").agg(F.count("*").alias("n_rows"), F.count("m").alias("n_overlap"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_matches"))
    return rows.select("key_type", "n_rows", "n_overlap", F.round(F.col("n_overlap") / F.col("n_rows"), 9).alias("fraction"), "n_matches")


@query("grid_completeness", """WITH g AS (SELECT * FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events), (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)), o AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events)
SELECT event_type, CASE WHEN o.user_id IS NULL THEN 'missing' ELSE 'present' END AS state, count(*) AS n FROM g LEFT JOIN o USING (user_id, event_type, day) GROUP BY ALL""")
def grid_completeness(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return J.grid_gaps(e, [e.select("user_id"), e.select("event_type"), e.select("day")]).groupBy("event_type", "state").agg(F.count("*").alias("n"))


@query("activity_join_filtered", """SELECT n_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE (l_tax IS NULL OR l_tax < 0.05) AND (l_returnflag IS NULL OR l_returnflag <> 'R') AND l_quantity > 10 GROUP BY ALL""")
def activity_join_filtered(spark, d):
    l = table(spark, d, "lineitem").where("(l_tax is null or l_tax < 0.05) and (l_returnflag is null or l_returnflag <> 'R') and l_quantity > 10")  # noqa: E741
    j = l.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("parquet_row_counts", "SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_shards FROM lineitem")
def parquet_row_counts(spark, d):
    return shard_counts(table(spark, d, "lineitem"))


@query("shard_holdout", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, i AS row_index, CASE WHEN i < 50 THEN 'val' ELSE 'train' END AS split, CASE WHEN i >= 50 THEN CAST(floor((i - 50) / 100) AS BIGINT) END AS shard FROM r")
def shard_holdout(spark, d):
    return sinks.assign_shards(table(spark, d, "documents").select("doc_id"), "doc_id", val_size=50, shard_size=100)


@query("dedup_keep_first", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_keep_first(spark, d):
    docs = table(spark, d, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("x"))
    return first.select("x.*")


@query("first_seen_union", f"WITH u AS (SELECT md5({_CANON}) AS k, 0 AS s, doc_id AS i FROM documents UNION ALL SELECT md5({_CANON}), 1, conv_id * 1000 + turn FROM conversations) SELECT k, s AS source_rank, i AS position FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY s, i) = 1")
def first_seen_union(spark, d):
    """Each whole text once over both tables, in the order of the tables and of their rows."""
    k = F.md5(X.canonical_text(F.col("text"))).alias("k")
    a = table(spark, d, "documents").select(k, F.lit(0).alias("s"), F.col("doc_id").alias("i"))
    b = table(spark, d, "conversations").select(k, F.lit(1).alias("s"), (F.col("conv_id") * 1000 + F.col("turn")).alias("i"))
    return a.unionByName(b).groupBy("k").agg(F.min(F.struct("s", "i")).alias("m")).select("k", F.col("m.s").alias("source_rank"), F.col("m.i").alias("position"))


@query("set_compare_by_group", """WITH a AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts < TIMESTAMP '2024-01-08'), b AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'),
f AS (SELECT event_type, a.user_id AS x, b.user_id AS y FROM a FULL JOIN b USING (event_type, user_id)), g AS (SELECT event_type, count(*) AS u FROM f GROUP BY 1)
SELECT event_type, count(*) FILTER (ia) AS n_a, count(*) FILTER (ib) AS n_b, count(*) FILTER (ia AND ib) AS n_both, count(*) AS n_union, count(*) FILTER (ia AND NOT ib) AS only_a, count(*) FILTER (ib AND NOT ia) AS only_b,
round(count(*) FILTER (ia AND ib) / nullif(count(*) FILTER (ib), 0), 9) AS coverage, round(count(*) FILTER (ia AND ib) / count(*), 9) AS jaccard
FROM (SELECT event_type, user_id, bool_or(s = 'a') AS ia, bool_or(s = 'b') AS ib FROM (SELECT *, 'a' AS s FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY ALL) GROUP BY 1""")
def set_compare_by_group(spark, d):
    e = table(spark, d, "events")
    return S.compare_sets(e.where("ts < timestamp_ntz'2024-01-08'"), e.where("ts >= timestamp_ntz'2024-01-25'"), ["user_id"], ["event_type"])


@query("config_mismatch", "SELECT a.l_linenumber, (CASE WHEN a.q IS DISTINCT FROM b.q THEN 1 ELSE 0 END + CASE WHEN a.m IS DISTINCT FROM b.m THEN 1 ELSE 0 END) AS n_mismatch FROM (SELECT l_linenumber, max(l_quantity) AS q, min(l_tax) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN (SELECT l_linenumber, max(l_quantity) AS q, min(l_tax) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (l_linenumber)")
def config_mismatch(spark, d):
    one = lambda f: table(spark, d, "lineitem").where(F.col("l_returnflag") == f).groupBy("l_linenumber").agg(F.max("l_quantity").alias("q"), F.min("l_tax").alias("m"))
    return J.field_mismatches(one("A"), one("R"), "l_linenumber", ["q", "m"]).select("l_linenumber", F.size("mismatches").alias("n_mismatch"))


@query("lookup_with_default", "SELECT e.event_type, count(*) AS n, coalesce(t.id, 209) AS token_id FROM events e LEFT JOIN (VALUES ('click', 1), ('purchase', 2)) t(event_type, id) USING (event_type) GROUP BY ALL")
def lookup_with_default(spark, d):
    ids = spark.createDataFrame([("click", 1), ("purchase", 2)], "event_type string, token_id int")
    return J.lookup(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", ids, "token_id", 209)
