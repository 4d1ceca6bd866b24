"""Queries over readers, writers, functions and streams: each goes out through a writer or function and comes back as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as X2
from ..functions import text as X
from ..functions import udfs as U
from ..operators import clusters as C
from ..operators import inference as I
from ..operators import joins as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import splits as S
from ..operators import states
from ..sources import exports, sinks
from ..sources import tables as T
from ..sources.shared import scratch_path
from ..sources.tables import table
from ..streaming import streams
from .measure import _DIFF, _SCORED, differences, scored
from .measure import SQL as _MEASURED
from .split_text import _STEPS, training_steps

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# sources and sinks


@query("source_labelled_csv", "SELECT doc_id, CAST(toxic AS INTEGER) AS toxic FROM labels WHERE toxic IS NOT NULL")
def source_labelled_csv(spark, d):
    """Out as gzip CSV, back through the reader that checks the target."""
    path = scratch_path(spark, "labels")
    sinks.write_csv(table(spark, d, "labels").where("toxic is not null").select("doc_id", "toxic"), path, gzip=True)
    return T.read_labelled_csv(spark, path, "doc_id", "toxic", binary=True).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))


@query("source_any_format", "SELECT f.format, n.* FROM (VALUES ('csv'), ('tsv'), ('json'), ('parquet'), ('orc')) f(format), (SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total, min(n_name) AS first FROM nation) n")
def source_any_format(spark, d):
    own, out = table(spark, d, "nation").select("n_nationkey", "n_name"), None
    for kind in ("csv", "tsv", "json", "parquet", "orc"):
        path = f"{scratch_path(spark, 'nation')}.{kind}"
        if kind in ("csv", "tsv"):
            own.write.options(header=True, sep="\t" if kind == "tsv" else ",").csv(path)
        else:
            own.write.format(kind).save(path)
        rows = T.read_any(spark, path).agg(F.count("*").alias("n"), F.sum(F.col("n_nationkey").cast("long")).alias("total"), F.min("n_name").alias("first")).select(F.lit(kind).alias("format"), "*")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("source_shards", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE doc_id >= 50")
def source_shards(spark, d):
    """A folder of shards with a hold-out file beside them, which the reader leaves out."""
    path, docs = scratch_path(spark, "shards"), table(spark, d, "documents").select("doc_id", F.col("text").alias("Text"))
    docs.where("doc_id >= 50").write.parquet(path)
    exports.single_file(docs.where("doc_id < 50"), f"{path}/val.parquet", "parquet")
    return T.read_shards(spark, path, "text").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("source_id_lines", """WITH l AS (SELECT doc_id AS line, CASE WHEN doc_id % 50 = 7 THEN ' ' WHEN doc_id % 50 = 9 THEN 'one' ELSE 'id ' || doc_id END AS value FROM documents), o AS (SELECT line, trim(value) AS id FROM l),
b AS (SELECT 'blank' AS problem, line FROM o WHERE id = '' UNION ALL SELECT 'duplicate', line FROM (SELECT line, row_number() OVER (PARTITION BY id ORDER BY line) AS n FROM o WHERE id <> '') WHERE n > 1)
SELECT problem, count(*) AS n, array_to_string(list(line ORDER BY line)[1:10], ',') AS first_lines FROM b GROUP BY 1""")
def source_id_lines(spark, d):
    value = F.when(F.col("doc_id") % 50 == 7, " ").when(F.col("doc_id") % 50 == 9, "one").otherwise(F.concat(F.lit("id "), F.col("doc_id")))
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("line"), value.alias("value"))
    return T.checked_ids(lines).select("problem", "n", F.array_join(F.col("first_lines").cast("array<string>"), ",").alias("first_lines"))


@query("source_tsv_repaired", "SELECT DISTINCT doc_id, quality FROM labels WHERE toxic IS NOT NULL")
def source_tsv_repaired(spark, d):
    path = f"{scratch_path(spark, 'repaired')}.tsv"
    own = table(spark, d, "labels").select(F.col("doc_id").alias("ID"), F.col("quality").alias("X"), F.col("toxic").alias("Y"))
    own.unionAll(own).write.options(header=True, sep="\t").csv(path)
    rows = T.repaired_tsv(T.read_any(spark, path), {"ID": "Drug_ID", "X": "Drug"}, "Y")
    return rows.select(F.col("Drug_ID").cast("long").alias("doc_id"), F.col("Drug").cast("long").alias("quality"))


_LOOKUP = "SELECT o_orderkey, c_name, n_name FROM {o} LEFT JOIN {c} ON o_custkey = c_custkey LEFT JOIN {n} ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'"


@query("source_sql_lookup", _LOOKUP.format(o="orders", c="customer", n="nation"))
def source_sql_lookup(spark, d):
    """Plain SQL over the tables: the look-up of ids is one join, in no batches."""
    return spark.sql(_LOOKUP, o=table(spark, d, "orders"), c=table(spark, d, "customer"), n=table(spark, d, "nation"))


@query("file_manifest", "SELECT 'names.txt' AS file, CAST(sum(length(r_name) + 1) AS BIGINT) AS n_bytes, sha256(string_agg(r_name || chr(10), '' ORDER BY r_name)) AS sha256 FROM region")
def file_manifest(spark, d):
    """A small text file under a pinned digest, which the manifest checks."""
    folder, names = scratch_path(spark, "manifest"), table(spark, d, "region").select("r_name")
    exports.single_file(names.select(F.col("r_name").alias("value")).repartition(1).sortWithinPartitions("value"), f"{folder}/names.txt", "text")
    digest = names.agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("r_name")), "\n"), F.lit("\n")), 256)).first()[0]
    return exports.pinned(spark, folder, {"names.txt": digest}, "*.txt")


@query("sink_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_json(spark, d):
    path = scratch_path(spark, "json")
    exports.write_json(table(spark, d, "nation").select("n_regionkey", "n_name", "n_nationkey"), path)
    return spark.read.schema("n_nationkey long, n_name string, n_regionkey long").json(path)


@query("sink_text", "SELECT item_id || ' ' || length(text) AS line FROM benchmark")
def sink_text(spark, d):
    path = scratch_path(spark, "text")
    exports.write_text(table(spark, d, "benchmark").select(F.concat("item_id", F.lit(" "), F.length("text")).alias("line")), "line", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("sink_aligned", "SELECT doc_id, 'quality' AS name, CAST(quality AS INTEGER) AS label FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS INTEGER) FROM labels WHERE toxic IS NOT NULL")
def sink_aligned(spark, d):
    path = scratch_path(spark, "aligned")
    exports.write_aligned(sinks.with_position(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", name="row"), path, "doc_id", ["quality", "toxic"])
    return exports.read_aligned(spark, path, "doc_id").withColumn("label", F.col("label").cast("int"))


@query("sink_markdown", "SELECT '| n_regionkey | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_regionkey || ' | ' || n || ' |' || chr(10), '' ORDER BY n_regionkey) AS report FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)")
def sink_markdown(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).orderBy("n_regionkey")
    return spark.createDataFrame([(sinks.markdown(rows),)], "report string")


@query("sink_refuses_existing", "SELECT true AS refused, count(*) AS n_rows FROM nation")
def sink_refuses_existing(spark, d):
    from pyspark.errors import AnalysisException

    path, own, refused = scratch_path(spark, "once"), table(spark, d, "nation").select("n_nationkey", "n_name"), False
    exports.write_json(own, path)
    try:
        exports.write_json(own, path)
    except AnalysisException:
        refused = True
    return spark.read.json(path).agg(F.count("*").alias("n_rows")).select(F.lit(refused).alias("refused"), "n_rows")


@query("shard_rows_wide", "WITH r AS (SELECT *, row_number() OVER (ORDER BY lang, doc_id) - 1 AS i FROM documents) SELECT doc_id, i AS row_index, CASE WHEN i < 50 THEN 'val' ELSE 'train' END AS split, CASE WHEN i >= 50 THEN CAST(floor((i - 50) / 100) AS BIGINT) END AS shard, md5(text) AS digest, source FROM r")
def shard_rows_wide(spark, d):
    """Rows in a stable order by two keys, with all their columns, in shards behind a hold-out."""
    docs = table(spark, d, "documents").select("lang", "doc_id", "source", "text")
    return sinks.assign_shards(docs, "lang", "doc_id", val_size=50, shard_size=100).select("doc_id", "row_index", "split", "shard", F.md5("text").alias("digest"), "source")


@query("concat_by_position", "SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.source, b.quality FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM documents) a JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM labels) b USING (i)")
def concat_by_position(spark, d):
    """Two tables side by side, row by row in order."""
    a = sinks.with_position(table(spark, d, "documents").select(F.col("doc_id").alias("left_id"), "source"), "left_id")
    b = sinks.with_position(table(spark, d, "labels").select(F.col("doc_id").alias("right_id"), "quality"), "right_id")
    return a.join(b, "row_index").select("left_id", "right_id", "source", "quality")


@query("projection_renamed", "SELECT doc_id AS row_id, source AS original_source, lang, n_chars FROM documents")
def projection_renamed(spark, d):
    docs = T.require_columns(table(spark, d, "documents"), "DOC_ID", "source")
    return docs.select(F.col("doc_id").alias("row_id"), F.col("source").alias("original_source"), "lang", "n_chars")


@query("first_bad_rows", "SELECT reason, count(*) AS n, min(doc_id) AS first_row FROM (SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN n_chars > 5000 THEN 'too long' ELSE 'ok' END AS reason FROM documents) GROUP BY 1")
def first_bad_rows(spark, d):
    """How many rows fail each check, and the first of them."""
    rows = L.with_reason(table(spark, d, "documents"), [("empty", F.trim("text") == ""), ("too long", F.col("n_chars") > 5000), ("ok", F.lit(True))])
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_row"))


# joins, metrics, statistics


@query("semi_join_dimension", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 4)")
def semi_join_dimension(spark, d):
    return L.with_enough_members(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", ["event_type"], 4).select("event_id", "user_id")


@query("brute_force_agreement", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT DISTINCT CAST(floor(i * ((SELECT count(*) FROM v) - 1) / 31::DOUBLE) AS BIGINT) AS vec_id FROM range(32) r(i))
SELECT a.vec_id AS query_id, round(max(list_cosine_similarity(a.e, b.e)), 6) AS best, true AS agrees FROM v a SEMI JOIN q ON q.vec_id = a.vec_id JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1""")
def brute_force_agreement(spark, d):
    """32 evenly spaced vectors against all, beside what the nearest-neighbour join finds."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"))
    q = S.evenly_spaced(v, 32, F.count("*"), "corpus_id").withColumnRenamed("corpus_id", "query_id")
    return J.brute_force_agreement(q, v, J.nearest_by_cosine(q, v))


@query("pair_accuracy_by_group", "WITH s AS (SELECT d.source, d.doc_id, l.quality AS y, d.n_chars AS p FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL) SELECT a.source, count(*) AS n_pairs, round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 6) AS pair_accuracy FROM s a JOIN s b ON a.source = b.source AND a.y = 1 AND b.y = 0 GROUP BY 1")
def pair_accuracy_by_group(spark, d):
    own = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("p")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return M.pair_accuracy(own, ["source"], "y", "p").where("n_pairs > 0")


@query("mismatch_rates", "WITH l AS (SELECT l_linenumber AS k, l_returnflag AS f, max(l_quantity) AS q, min(l_tax) AS m FROM lineitem GROUP BY ALL) SELECT count(*) AS n_pairs, round(avg((a.q IS DISTINCT FROM b.q)::INT), 9) AS rate_q, round(avg((a.m IS DISTINCT FROM b.m)::INT), 9) AS rate_m, round(avg((a.q IS DISTINCT FROM b.q OR a.m IS DISTINCT FROM b.m)::INT), 9) AS rate_any FROM l a JOIN l b ON a.k = b.k AND a.f = 'A' AND b.f = 'R'")
def mismatch_rates(spark, d):
    one = lambda f: table(spark, d, "lineitem").where(F.col("l_returnflag") == f).groupBy("l_linenumber").agg(F.max("l_quantity").alias("q"), F.min("l_tax").alias("m"))
    return J.mismatch_rates(one("A"), one("R"), "l_linenumber", ["q", "m"])


@query("constant_predictor", "WITH m AS (SELECT median(n_chars) AS m FROM documents WHERE doc_id % 5 <> 0) SELECT source, count(*) AS n, round(avg(abs(n_chars - m)), 6) AS mae FROM documents, m WHERE doc_id % 5 = 0 GROUP BY 1")
def constant_predictor(spark, d):
    """The training median as the prediction of every test row."""
    own = M.constant_prediction(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", F.col("doc_id") % 5 != 0)
    return own.where("doc_id % 5 = 0").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("n_chars") - F.col("predicted"))), 6).alias("mae"))


@query("macro_f1_by_group", f"WITH {_SCORED}, c AS (SELECT source, count(*) AS n, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM s WHERE y IS NOT NULL GROUP BY 1) SELECT source, n, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1 FROM c")
def macro_f1_by_group(spark, d):
    return M.macro_f1(scored(spark, d), ["source"], "y", F.col("p") >= 0.5)


@query("choice_accuracy", "WITH b AS (SELECT conv_id, arg_max((role = 'assistant')::INT, (length(text), -turn)) AS hit FROM conversations GROUP BY 1) SELECT count(*) AS n_groups, round(avg(hit), 6) AS accuracy FROM b")
def choice_accuracy(spark, d):
    """Turns as the options of a conversation: is the longest one the assistant's?"""
    own = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return M.choice_accuracy(own, "conv_id", "turn", "n", F.col("role") == "assistant")


@query("mergeable_states", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 4) AS sd FROM documents GROUP BY 1")
def mergeable_states(spark, d):
    """Metric states made by part, merged, and read off at the end."""
    own = table(spark, d, "documents").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    metric = states.moments_metric("n_chars")
    whole = states.compute(states.merge(states.update(own, ["source", "part"], metric), ["source"], metric), ["source"], metric)
    return whole.select("source", "n", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"))


_UNITS = "u AS (SELECT user_id, avg(value) AS v, count(*)::DOUBLE AS c, row_number() OVER (ORDER BY user_id) - 1 AS i FROM events GROUP BY user_id)"
_RHO = "k AS (SELECT i, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS a, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS b FROM u)"


def numbered_units(spark, d):
    own = table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("v"), F.count("*").cast("double").alias("c"))
    return sinks.with_position(own, "user_id", name="i")


_UNITS = _UNITS.replace("avg(value) AS v", "round(avg(value), 9) AS v")


@query("permutation_spearman", f"WITH {_UNITS}, {_RHO}, z AS (SELECT corr(a, b) AS rho FROM k), o AS (SELECT r, b, row_number() OVER (PARTITION BY r ORDER BY md5('19|' || r || '|' || i), i) - 1 AS i FROM range(200) t(r), k), m AS (SELECT r, abs(corr(k.a, o.b)) AS m FROM o JOIN k USING (i) GROUP BY r) SELECT round(any_value(rho), 6) AS rho, count(*) AS n_permutations, round((count(*) FILTER (m >= abs(rho) - 1e-15) + 1) / (count(*) + 1), 9) AS p FROM m, z")
def permutation_spearman(spark, d):
    return I.permutation_spearman(numbered_units(spark, d), "v", "c", 200, 19)


_DRAW = "CAST(('0x' || substr(md5('23|' || r || '|' || x.i), 1, 7)) AS BIGINT)"


@query("endpoint_record", f"""WITH {_UNITS}, w AS (SELECT i, round(v - 50, 9) AS z, count(*) OVER () AS n FROM u), s AS (SELECT r, w.z FROM range(200) t(r), w x, w WHERE w.i = {_DRAW} % x.n), m AS (SELECT r, avg(z) AS m FROM s GROUP BY r), g AS (SELECT count(*) AS n, round(avg(z), 6) AS mean, round(median(z), 6) AS median, count(*) FILTER (z > 0) AS n_pos, count(*) FILTER (z < 0) AS n_neg FROM w)
SELECT g.n, g.mean, q.low, q.high, g.median, g.n_pos, g.n_neg FROM g, (SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m) q""")
def endpoint_record(spark, d):
    """The exact sign p is tested by itself (sign_test); with so many units SQL's factorials overflow."""
    units = numbered_units(spark, d).select("i", F.round(F.col("v") - 50, 9).alias("z"))
    return I.endpoint_record(units, "z", 200, 23).drop("p")


WILCOXON = _MEASURED["wilcoxon_exact"]


def _bundle_sql() -> str:
    """Each contrast's exact signed-rank test by its number of sign patterns, Holm over the contrasts, Friedman over the blocks."""
    pairs = [(x, y) for i, x in enumerate("ANR") for y in "ANR"[i + 1 :]]
    long = " UNION ALL ".join(f"SELECT '{x}-{y}' AS g, k, s, round({x} - {y}, 9) AS diff FROM v WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {'ANR'.replace(x, '').replace(y, '')} IS NOT NULL" for x, y in pairs)
    ranks = ", ".join(f"({' + '.join(f'({o} < {c})::INT' for o in 'ANR')}) + (({' + '.join(f'({o} = {c})::INT' for o in 'ANR')}) + 1) / 2.0 AS r{c}" for c in "ANR")
    tests = WILCOXON.split("SELECT a.g, n,", 1)
    head = tests[0].split("r AS (", 1)[1]
    return f"""WITH RECURSIVE {_DIFF.replace("d AS", "d0 AS", 1)}, v AS (SELECT k, s, max(diff) FILTER (g = 'A') AS A, max(diff) FILTER (g = 'N') AS N, max(diff) FILTER (g = 'R') AS R FROM d0 GROUP BY ALL), d AS ({long}),
r AS ({head}, x AS (SELECT a.g AS contrast, n,{tests[1]}),
h AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, contrast) + 1) * p) AS h FROM x),
b AS (SELECT * FROM v WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL), f AS (SELECT {ranks} FROM b),
f2 AS (SELECT count(*) AS m, sum(rA) AS sx, sum(rN) AS sy, sum(rR) AS sz, sum(rA * rA + rN * rN + rR * rR) AS q FROM f), f3 AS (SELECT (2 * ((sx * sx + sy * sy + sz * sz) / m::DOUBLE - 12.0 * m) / (q - 12.0 * m))::DOUBLE AS t FROM f2)
SELECT contrast, n, w_plus, p, rank_biserial, median, round(max(h) OVER (ORDER BY p, contrast ROWS UNBOUNDED PRECEDING), 9) AS p_holm, round(t, 9) AS friedman, round(exp(-t / 2), 9) AS friedman_p FROM h, f3"""


@query("paired_bundle", _bundle_sql())
def paired_bundle(spark, d):
    own = differences(spark, d).groupBy("k", "s").pivot("g", ["A", "N", "R"]).agg(F.max("diff"))
    return I.paired_bundle(own, ["A", "N", "R"])


@query("label_attachment", """WITH k AS (SELECT doc_id, source, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS k FROM documents), p AS (SELECT k, string_agg(DISTINCT source, ';' ORDER BY source) AS provenance FROM k GROUP BY 1),
l AS (SELECT doc_id, 'quality' AS task, CAST(quality AS INTEGER) AS label FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS INTEGER) FROM labels WHERE toxic IS NOT NULL) SELECT l.doc_id, p.provenance, l.task, l.label, m.kind FROM l JOIN k USING (doc_id) JOIN p USING (k) LEFT JOIN (VALUES ('toxic', 'safety')) m(task, kind) USING (task)""")
def label_attachment(spark, d):
    """The labels of all rows, with the sources in which their text occurs and what is known of the task."""
    k = table(spark, d, "documents").select("doc_id", "source", F.md5(X.canonical_text(F.col("text"))).alias("k"))
    facts = table(spark, d, "labels").join(k.select("doc_id", "k"), "doc_id")
    meta = spark.createDataFrame([("toxic", "safety")], "task string, kind string")
    long = C.attach_labels(k, facts.select("doc_id", "quality", "toxic", "k"), "k", "source", ["quality", "toxic"], meta, carry=["doc_id"])
    return long.select("doc_id", "provenance", "task", "label", "kind")


_SETS = "t AS (SELECT DISTINCT item_id AS k, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark), n AS (SELECT k, count(*) AS n FROM t GROUP BY 1), e AS (SELECT a, b FROM (SELECT x.k AS a, y.k AS b, count(*) AS s FROM t x JOIN t y ON x.w = y.w AND x.k <> y.k GROUP BY ALL) JOIN n nx ON nx.k = a JOIN n ny ON ny.k = b WHERE s / (nx.n + ny.n - s) >= 0.2 - 1e-9)"


@query("leader_clusters", f"""WITH RECURSIVE {_SETS}, g AS (SELECT i.item_id AS k, row_number() OVER (ORDER BY count(e.b) DESC, i.item_id) AS o FROM benchmark i LEFT JOIN e ON e.a = i.item_id GROUP BY 1), j AS (SELECT a, list(b) AS near FROM e GROUP BY 1), h AS (SELECT g.k, g.o, coalesce(j.near, []) AS near FROM g LEFT JOIN j ON j.a = g.k),
r AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS leaders UNION ALL SELECT h.o, CASE WHEN len(list_intersect(h.near, r.leaders)) = 0 THEN list_append(r.leaders, h.k) ELSE r.leaders END FROM r JOIN h ON h.o = r.o + 1),
f AS (SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM r ORDER BY o DESC LIMIT 1)) SELECT h.k AS node, CASE WHEN h.k IN (SELECT leader FROM f) THEN h.k ELSE (SELECT arg_min(e.b, g.o) FROM e JOIN f ON f.leader = e.b JOIN g ON g.k = e.b WHERE e.a = h.k) END AS cluster FROM h""")
def leader_clusters(spark, d):
    """Test items that share a fifth of their words, clustered around leaders."""
    items = table(spark, d, "benchmark")
    sets = items.select("item_id", F.explode(F.array_distinct(X.words(F.lower("text")))).alias("w"))
    return C.leader_clusters(items.select(F.col("item_id").alias("node")), C.token_graph(sets, "item_id", "w", 0.2))


@query("resume_contract", "SELECT source, CASE WHEN s.n IS NULL THEN 'new' WHEN s.n = w.n THEN 'reuse' ELSE 'stale' END AS state FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) w LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY 1) s USING (source)")
def resume_contract(spark, d):
    """Which artifacts of an earlier run may be used again."""
    docs = table(spark, d, "documents")
    made = lambda df: df.groupBy("source").agg(F.sha2(F.count("*").cast("string"), 256).alias("digest"))
    return S.reusable(made(docs.where("lang <> 'de'")), made(docs), "source", ["digest"])


# draws, features and functions


@query("logit_choices", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM u), t AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS w FROM r WHERE r <= 5),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p, sum(w) OVER (PARTITION BY vec_id ORDER BY r) / sum(w) OVER (PARTITION BY vec_id) AS c FROM t) SELECT vec_id, CAST(max(i) FILTER (r = 1) AS INTEGER) AS argmax, string_agg(i::VARCHAR, ',' ORDER BY r) AS top, round(max(p) FILTER (r = 1), 9) AS p_first,
CAST(coalesce(arg_min(i, r) FILTER (CAST('0x' || substr(md5('29|' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < c), max(i) FILTER (r = 5)) AS INTEGER) AS drawn FROM p GROUP BY vec_id""")
def logit_choices(spark, d):
    """Each vector as logits: the best, the five best renormalised, and a seeded draw among them."""
    own = table(spark, d, "embeddings").select("vec_id", X2.top_choices(F.col("embedding").cast("array<double>"), 5).alias("best"))
    return own.select("vec_id", F.col("best")[0].choice.alias("argmax"), F.array_join(F.transform("best", lambda c: c.choice.cast("string")), ",").alias("top"), F.round(F.col("best")[0].p, 9).alias("p_first"), X2.drawn(F.col("best"), 29, F.col("vec_id")).alias("drawn"))


@query("wrap_epoch", "SELECT i AS draw, n_nationkey, n_name FROM range(60) t(i) JOIN nation ON n_nationkey = i % 25")
def wrap_epoch(spark, d):
    """An epoch of 60 draws over the 25 nations."""
    return S.wrapped(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), "n_nationkey", 25, 60)


@query("wrap_padding", "SELECT i % 8 AS part, CAST(floor(i / 8) AS BIGINT) AS place, CASE WHEN i < 25 THEN i ELSE 0 END AS n_nationkey FROM range(32) t(i)")
def wrap_padding(spark, d):
    """The 25 nations over 8 equal parts, the first one repeated."""
    return S.wrap_padded(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")), "n_nationkey", 25, 8)


@query("shard_numbers", "SELECT doc_id % 6 AS shard, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def shard_numbers(spark, d):
    """All rows, dealt by number over three ranks of two workers."""
    out = None
    for k in range(6):
        own = streams.own_shard(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), 2, 3, k // 2, k % 2).select(F.lit(k).cast("long").alias("shard"), "doc_id")
        out = own if out is None else out.unionAll(own)
    return out.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("rank_merge", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def rank_merge(spark, d):
    """Results of two ranks in order, cut to the first 100 (the operator's own limit)."""
    own = table(spark, d, "documents").select("doc_id", "source")
    return streams.merged([own.where("doc_id % 2 = 1"), own.where("doc_id % 2 = 0")], "doc_id", 100)


@query("text_normal_forms", "SELECT item_id, lower(trim(text)) AS stripped, trim(regexp_replace(lower('  ' || text || chr(10)), '\\s+', ' ', 'g')) AS canonical, '' AS nothing FROM benchmark")
def text_normal_forms(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.lower_strip(F.concat(F.lit(" \t"), "text", F.lit("\n "))).alias("stripped"), X.canonical_text(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("canonical"), X.lower_strip(F.lit(None).cast("string")).alias("nothing"))


_STD = "trim(regexp_replace(lower(url), '\\s+', ' ', 'g'))"


@query("key_sets", f"SELECT page_id, {_STD} AS standard, split_part({_STD}, '-', 1) AS connectivity, regexp_replace({_STD}, '[0-9]+', '', 'g') AS scaffold, regexp_replace(regexp_replace({_STD}, '[0-9]+', '', 'g'), '[a-z]', 'x', 'g') AS generic, CASE WHEN url IS NULL THEN 'missing' WHEN {_STD} = '' THEN 'empty' ELSE 'ok' END AS status FROM pages")
def key_sets(spark, d):
    own = table(spark, d, "pages")
    return own.select("page_id", X2.key_set(F.col("url"), X.canonical_text(F.col("url"))).alias("k")).select("page_id", "k.*")


@query("score_transforms", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(1 / (1 + exp(-e[1])), 9) AS sigmoid, round(1 / (1 + exp(-50.0::DOUBLE)), 9) AS clipped, round(exp(e[1] - list_max(e)) / list_sum([exp(x - list_max(e)) FOR x IN e]), 9) AS softmax, round(greatest(e[1], e[2]) + ln(1 + exp(-abs(e[1] - e[2]))), 9) AS log_add FROM v""")
def score_transforms(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(X.sigmoid(e[0]), 9).alias("sigmoid"), F.round(X.sigmoid(e[0] + 1e6), 9).alias("clipped"), F.round(X.softmax(e)[0], 9).alias("softmax"), F.round(X.log_add_exp(e[0], e[1]), 9).alias("log_add"))


@query("hop_distances", """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn IS NOT NULL), g AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, run) AS n FROM g)
SELECT a.conv_id, a.turn + 1 AS i, b.turn + 1 AS j, CAST(abs(a.turn - b.turn) + 1 AS INTEGER) AS d FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.run = b.run AND a.n > 1""")
def hop_distances(spark, d):
    """Steps between turns of a conversation, as the sparse matrix with a start token."""
    t = table(spark, d, "conversations").select("conv_id", "turn")
    edges = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("i"), (F.col("turn") + 1).alias("j")).distinct()
    return X2.shifted_distances(X2.hop_distances(edges, ["conv_id"]), ["conv_id"])


@query("attention_span", """WITH a AS (SELECT item_id, [length(x) % 3 FOR x IN string_split(text, ' ')] AS y FROM benchmark), u AS (SELECT item_id, y, unnest(range(len(y))) AS i FROM a), w AS (SELECT item_id, y, i, unnest(range(len(y))) AS j FROM u)
SELECT item_id, count(*) AS n, count(*) FILTER ((abs(i - j) <= 1 OR abs(i - j) > 3 OR y[i + 1] = 0) AND 4 * i < 3 * len(y) AND 4 * j < 3 * len(y)) AS n_open FROM w GROUP BY 1""")
def attention_span(spark, d):
    """Whole texts; the last quarter of the tokens of each counts as absent."""
    own = table(spark, d, "benchmark").select("item_id", F.transform(F.split("text", " "), lambda x: F.length(x) % 3).alias("y")).withColumn("here", F.transform("y", lambda _, i: (4 * i < 3 * F.size("y")).cast("int")))
    m = F.flatten(X2.attention_span(F.col("y"), F.col("here"), 3))
    return own.select("item_id", F.size(m).cast("long").alias("n"), F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_open"))


@query("ulp_match", "SELECT doc_id, true AS same, true AS next, false AS other FROM documents")
def ulp_match(spark, d):
    x = 1 + F.col("n_chars") / 7.0
    own = table(spark, d, "documents").select("doc_id", x.alias("x"), (x + F.pow(F.lit(2.0), F.floor(F.log2(x)) - 52)).alias("next"), (x * (1 + 1e-9)).alias("other"))
    same = U.within_ulp()
    return own.select("doc_id", same("x", "x").alias("same"), same("x", "next").alias("next"), same("x", "other").alias("other"))


@query("score_ranges", "SELECT metric, count(*) AS n, count(*) FILTER (CASE metric WHEN 'auroc' THEN x BETWEEN 0 AND 1 WHEN 'spearman' THEN x BETWEEN -1 AND 1 ELSE x >= 0 END) AS n_possible FROM (SELECT 'auroc' AS metric, value / 100 AS x FROM events UNION ALL SELECT 'spearman', (value - 50) / 40 FROM events UNION ALL SELECT 'mae', value - 50 FROM events) GROUP BY 1")
def score_ranges(spark, d):
    v = F.col("value")
    long = table(spark, d, "events").select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), x.alias("x")) for m, x in (("auroc", v / 100), ("spearman", (v - 50) / 40), ("mae", v - 50))])).alias("s")).select("s.*")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.count_if(X2.in_range(F.col("x"), F.col("metric"))).alias("n_possible"))


@query("truncated_pairs", """WITH t AS (SELECT item_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS n, item_id % 23 AS m FROM benchmark), o AS (SELECT *, greatest(n + m - 16, 0) AS over, least(greatest(n + m - 16, 0), abs(n - m)) AS d FROM t)
SELECT item_id, CAST(n - CASE WHEN n >= m THEN d + ceil((over - d) / 2.0) ELSE floor((over - d) / 2.0) END AS INTEGER) AS n_a, CAST(m - CASE WHEN n >= m THEN floor((over - d) / 2.0) ELSE d + ceil((over - d) / 2.0) END AS INTEGER) AS n_b FROM o""")
def truncated_pairs(spark, d):
    b = F.array_repeat(F.lit("x"), (F.col("item_id") % 23).cast("int"))
    own = table(spark, d, "benchmark").select("item_id", X.truncate_pair(X.words(F.col("text")), b, 16).alias("t"))
    return own.select("item_id", F.size("t.a").alias("n_a"), F.size("t.b").alias("n_b"))


@query("log_buckets", "WITH r AS (SELECT doc_id, doc_id - n_chars AS relative FROM documents), c AS (SELECT *, least(greatest(relative, -99), 99) AS c FROM r) SELECT doc_id, relative, CAST(CASE WHEN abs(c) <= 4 THEN c ELSE (ceil(ln(abs(c) / 4.0::DOUBLE) / ln(99 / 4.0::DOUBLE) * 3) + 4) * sign(c) END AS INTEGER) AS bucket FROM c")
def log_buckets(spark, d):
    """Offsets far beyond the farthest bucket too."""
    own = table(spark, d, "documents").select("doc_id", (F.col("doc_id") - F.col("n_chars")).alias("relative"))
    return own.withColumn("bucket", X.log_bucket(F.col("relative"), 8, 100))


@query("learning_rates_cyclic", _STEPS + " SELECT i AS step, round(CASE WHEN i < warm THEN i / greatest(1, warm) ELSE greatest(0.0, 1 - floor((i - warm) / len) / 4.0 + ((CASE WHEN floor((i - warm) / len) % 2 = 0 THEN 1 ELSE -1 END) * cos(pi() * (i - warm) / len) - 1) / 8.0) END, 9)::DOUBLE AS rate FROM (SELECT *, greatest(1, floor((total - warm) / 4))::DOUBLE AS len FROM s)")
def learning_rates_cyclic(spark, d):
    rate = X.learning_rate(F.col("step"), F.col("warm"), F.col("total"), "cyclic")
    return training_steps(spark, d).select("step", F.round(rate, 9).alias("rate"))


@query("strict_timestamps", "SELECT event_id, event_id % 3 <> 0 AS is_strict, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment FROM events")
def strict_timestamps(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    own = table(spark, d, "events").select("event_id", X2.utc_timestamp(text).alias("t"))
    return own.select("event_id", F.col("t").isNotNull().alias("is_strict"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("predict_by_file", "SELECT doc_id, round(1 / (1 + exp(-length(text) / 1000.0::DOUBLE)), 9) AS p FROM documents WHERE text IS NOT NULL")
def predict_by_file(spark, d):
    """A scorer chosen by the name of its file, as an Arrow function over whole batches."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(U.scorer("models/length.model", binary=True)("text"), 9).alias("p"))


@query("encode_lengths", "SELECT doc_id, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL")
def encode_lengths(spark, d):
    v = U.encoder(lambda: U.length_pair)("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", v.alias("v")).select("doc_id", F.col("v")[0].cast("long").alias("n_chars"), F.col("v")[1].cast("long").alias("n_bytes"))


_BITS = "SELECT item_id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 256 AS INTEGER) AS bit FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark)"


@query("fingerprints", f"WITH b AS ({_BITS}) SELECT item_id, bit, 'count' AS kind, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT item_id, bit, 'bit', CAST(1 AS BIGINT) FROM b GROUP BY ALL")
def fingerprints(spark, d):
    own, w = table(spark, d, "benchmark"), X.words(F.lower("text"))
    one = lambda counts, kind: X2.fingerprint(own, "item_id", w, 256, counts).select("item_id", "bit", F.lit(kind).alias("kind"), "n")
    return one(True, "count").unionAll(one(False, "bit"))


@query("descriptors", "WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM documents) SELECT doc_id, length(text)::DOUBLE AS n_chars, len(w)::DOUBLE AS n_words, CASE WHEN len(w) > 0 THEN round(list_sum([length(x) FOR x IN w]) / len(w), 6) ELSE -1 END AS mean_word, CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text), 6) ELSE -1 END AS digit_share, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 6) ELSE -1 END AS distinct_share FROM t WHERE text IS NOT NULL")
def descriptors(spark, d):
    """Named features of whole texts; NaN shows as -1 here."""
    own = table(spark, d, "documents").where("text is not null").select("doc_id", X2.descriptors(F.col("text")).alias("f")).select("doc_id", "f.*")
    return own.select("doc_id", *[F.round(F.nanvl(c, F.lit(-1.0)), 6).alias(c) for c in own.columns[1:]])


@query("reordered_tokens", "WITH t AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark) SELECT item_id, string_agg(w, ' ' ORDER BY md5('31|' || item_id || '|' || i), i) AS text FROM t GROUP BY 1")
def reordered_tokens(spark, d):
    """Words in a seeded order; the plan fails if any was lost."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(X2.reordered(F.split("text", " "), F.col("item_id"), 31), " ").alias("text"))


# streams


@query("stream_encoded", "SELECT CASE WHEN text IS NULL THEN 'unparseable' WHEN len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) > 500 THEN 'too long' ELSE 'kept' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def stream_encoded(spark, d):
    """Documents as a file stream: the text column is found by name, encoded, and what is left out has a reason."""
    own = streams.file_stream(spark, f"{d}/documents.parquet")
    column = streams.sniffed(own.columns, "text", "html")
    parts = streams.encode_or_reason(own.select("doc_id", column), column, X.words, 500)
    names, out = ("kept", "left"), None
    for name, part in zip(names, parts):
        where = scratch_path(spark, f"stream-{name}")
        streams.drain(part.select("doc_id", F.lit("kept").alias("outcome") if name == "kept" else F.col("reason").alias("outcome")), f"{where}/out", f"{where}/state")
        rows = spark.read.schema("doc_id long, outcome string").parquet(f"{where}/out")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query("stream_resumed", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids, CAST(0 AS BIGINT) AS n_again FROM events")
def stream_resumed(spark, d):
    """Events in 40 files, drained twice with one checkpoint: the second run finds nothing new."""
    where = scratch_path(spark, "resumed")
    table(spark, d, "events").repartition(40, "event_id").write.parquet(f"{where}/in")
    stream = lambda: streams.file_stream(spark, f"{where}/in").select("event_id")
    streams.drain(stream(), f"{where}/out", f"{where}/state")
    first = spark.read.parquet(f"{where}/out").count()
    streams.drain(stream(), f"{where}/out", f"{where}/state")
    return spark.read.parquet(f"{where}/out").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids")).withColumn("n_again", F.col("n") - F.lit(first))
