"""Queries that split, digest, scan and process text; UDF and streaming surfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as X2
from ..functions import text as X
from ..functions import udfs as U
from ..operators import digests as D
from ..operators import metrics as M
from ..operators import splits as S
from ..sources import tables as T
from ..sources.shared import scratch_path
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


_SIZES = "s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM s)"


@query("cluster_holdout", f"WITH {_SIZES}, o AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY md5('5|' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT source, n, before < greatest(1, round_even(total * 0.15, 0)) AS held FROM o, t")
def cluster_holdout(spark, d):
    return S.hold_out_groups(table(spark, d, "documents").select("source"), "source", 5, 0.15)


@query("group_kfold", "SELECT doc_id, CAST(CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM documents")
def group_kfold(spark, d):
    return S.group_folds(table(spark, d, "documents").select("doc_id", "source"), "source", 5).select("doc_id", "fold")


@query("hash_sample", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('3|' || doc_id), doc_id) <= 7")
def hash_sample(spark, d):
    return S.sample_per_group(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 7, 3)


@query("linspace_sample", "SELECT DISTINCT doc_id FROM documents, range(32) r(i) WHERE doc_id = floor(i * ((SELECT count(*) FROM documents) - 1) / 31::DOUBLE)")
def linspace_sample(spark, d):
    return S.evenly_spaced(table(spark, d, "documents").select("doc_id"), 32, F.count("*"), "doc_id")


def _fold_sql(order: str, seed: int) -> str:
    return f"""WITH RECURSIVE {_SIZES}, o AS (SELECT source, n, total, row_number() OVER (ORDER BY {order}, md5('{seed}|' || source)) AS i FROM s, t),
f AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS source, 0::BIGINT AS n, 0::HUGEINT AS tr, 0::HUGEINT AS va, NULL::VARCHAR AS part
UNION ALL SELECT o.i, o.source, o.n, f.tr + CASE WHEN f.tr + o.n <= 0.8::DOUBLE * total THEN o.n ELSE 0 END, f.va + CASE WHEN NOT f.tr + o.n <= 0.8::DOUBLE * total AND f.va + o.n <= 0.1::DOUBLE * total THEN o.n ELSE 0 END,
CASE WHEN f.tr + o.n <= 0.8::DOUBLE * total THEN 'train' WHEN f.va + o.n <= 0.1::DOUBLE * total THEN 'valid' ELSE 'test' END FROM f JOIN o ON o.i = f.i + 1) SELECT source, n, part FROM f WHERE i > 0"""


@query("scaffold_split_greedy", _fold_sql("CASE WHEN n <= least(0.1::DOUBLE, 1 - 0.8::DOUBLE - 0.1::DOUBLE) * total / 2 THEN 1 ELSE 0 END", 42))
def scaffold_split_greedy(spark, d):
    return S.greedy_split(table(spark, d, "documents").select("source"), "source", seed=42)


@query("size_desc_split", _fold_sql("n DESC", 42))
def size_desc_split(spark, d):
    return S.greedy_split(table(spark, d, "documents").select("source"), "source", seed=42, big_first=False)


@query("split_disjointness", """WITH p AS (SELECT CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 5 AS fold, source, md5(text) AS text_key FROM documents), k AS (SELECT fold, 'source' AS key_type, source AS k FROM p UNION ALL SELECT fold, 'text_key', text_key FROM p),
g AS (SELECT key_type, k, count(DISTINCT fold) AS parts FROM k GROUP BY ALL) SELECT key_type, count(*) AS n_keys, count(*) FILTER (parts > 1) AS n_straddling FROM g GROUP BY 1""")
def split_disjointness(spark, d):
    rows = S.group_folds(table(spark, d, "documents").select("source", F.md5("text").alias("text_key")), "source", 5)
    return S.straddling(rows, "fold", ["source", "text_key"])


@query("blinded_targets", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN quality END AS quality FROM labels")
def blinded_targets(spark, d):
    own = table(spark, d, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))
    return S.blinded(own, "quality", "split").select("doc_id", "quality")


@query("group_digest", "SELECT source, sha256(string_agg(text, chr(10) ORDER BY text)) AS digest FROM documents GROUP BY 1")
def group_digest(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(D.set_digest(F.col("text")).alias("digest"))


@query("ordered_digest", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY 1")
def ordered_digest(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(D.ordered_digest(F.col("turn"), F.col("text")).alias("digest"))


@query("membership_digest", "SELECT role, sha256(string_agg('[\"' || conv_id || '\",\"' || turn || '\"]', chr(10) ORDER BY '[\"' || conv_id || '\",\"' || turn || '\"]')) AS digest FROM conversations GROUP BY 1")
def membership_digest(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(D.membership_digest(F.col("conv_id"), F.col("turn")).alias("digest"))


@query("json_digest", "SELECT event_id, sha256('{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}') AS digest FROM events")
def json_digest(spark, d):
    return table(spark, d, "events").select("event_id", D.json_digest({"user": F.col("user_id"), "type": F.col("event_type")}).alias("digest"))


@query("table_digest")
def table_digest(spark, d):
    return D.table_digest(table(spark, d, "orders"))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "key": r"AKIA[0-9A-Z]{16}", "password": r"password\s*=\s*[^\s]+"}


@query("pii_secret_scan", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in PATTERNS.items()) + "], lambda x: x IS NOT NULL), ',') AS hits FROM documents")
def pii_secret_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.scan_patterns(F.col("text"), PATTERNS), ",").alias("hits"))


_ANSWER = r"""array_to_string(list_filter(string_split_regex(regexp_replace(lower({t}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"""


@query("answer_normalise", f"SELECT item_id, {_ANSWER.format(t='text')} AS answer FROM benchmark")
def answer_normalise(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.normalise_answer(F.col("text")).alias("answer"))


@query("token_f1", f"""WITH t AS (SELECT conv_id, turn, role, string_split({_ANSWER.format(t='text')}, ' ') AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
f AS (SELECT conv_id, 2.0 * list_sum([least(len(list_filter(x, lambda t: t = u)), len(list_filter(y, lambda t: t = u))) FOR u IN list_distinct(x)]) / (len(x) + len(y)) AS f, (x = y)::INT AS em FROM p) SELECT conv_id, round(max(f)::DOUBLE, 6) AS f1, max(em) AS exact FROM f GROUP BY 1""")
def token_f1(spark, d):
    """Each turn against the next; the best pair of each conversation."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.split(X.normalise_answer(F.col("text")), " ").alias("w"))
    pairs = t.withColumnRenamed("w", "a").join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("b")), ["conv_id", "turn"])
    return M.token_f1(pairs, "conv_id", "a", "b")


@query("length_stats", "SELECT lang, max(n) AS max_len, min(n) AS min_len, round(avg(n), 6) AS mean_len, count(*) FILTER (n > 500) AS n_over_500 FROM (SELECT lang, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS n FROM documents) GROUP BY 1")
def length_stats(spark, d):
    own = table(spark, d, "documents").select("lang", F.size(X.words(F.col("text"))).cast("long").alias("n"))
    return own.groupBy("lang").agg(F.max("n").alias("max_len"), F.min("n").alias("min_len"), F.round(F.avg("n"), 6).alias("mean_len"), F.count_if(F.col("n") > 500).alias("n_over_500"))


@query("stride_windows", "WITH w AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM benchmark), s AS (SELECT item_id, w, unnest(CASE WHEN len(w) <= 16 THEN [0] ELSE range(0, CAST(ceil((len(w) - 16) / 12.0) * 12 AS BIGINT) + 1, 12) END) AS s FROM w) SELECT item_id, s AS start, array_to_string(w[s + 1 : s + 16], ' ') AS tokens FROM s")
def stride_windows(spark, d):
    own = table(spark, d, "benchmark").select("item_id", F.explode(X.windows(X.words(F.col("text")), 16, 4)).alias("w"))
    return own.select("item_id", F.col("w.start").cast("long").alias("start"), F.array_join("w.tokens", " ").alias("tokens"))


@query("conversation_pack", """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, n AS used, 0::BIGINT AS pack FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.turn, o.i, CASE WHEN f.used + o.n > 600 THEN o.n ELSE f.used + o.n END, f.pack + CASE WHEN f.used > 0 AND f.used + o.n > 600 THEN 1 ELSE 0 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id, pack, count(*) AS n_turns FROM f GROUP BY ALL""")
def conversation_pack(spark, d):
    """Turns in order into packs of at most 600 characters."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    packs = turns.select("conv_id", F.explode(X.packed(F.transform("t", lambda x: F.length(x.text).cast("long")), 600)).alias("pack"))
    return packs.groupBy("conv_id", "pack").agg(F.count("*").alias("n_turns"))


@query("islands", "WITH s AS (SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS island FROM conversations) SELECT conv_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(turn) AS first_turn FROM s GROUP BY ALL")
def islands(spark, d):
    rows = X.islands(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], F.col("role") == "user")
    return rows.groupBy("conv_id", "island").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("offset_prefix", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_chars FROM conversations")
def offset_prefix(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("offset_chars"))


@query("chronology_violations", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (l_shipdate < o_orderdate) AS n_before, CAST(min(o_orderdate) AS VARCHAR) AS first_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def chronology_violations(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderdate"), "l_orderkey")
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n_before"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("first_order"))


_U = "CAST('0x' || substr(md5('17|' || vec_id || '|' || {i}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("mask_positions_hash", f"SELECT vec_id, array_to_string(list_filter(range(1, len(embedding)), lambda i: {_U.format(i='i')} < 0.15), ',') AS masked FROM embeddings")
def mask_positions_hash(spark, d):
    at = X.masked_positions(F.col("vec_id"), F.size("embedding"), 0.15, 17)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(at.cast("array<string>"), ",").alias("masked"))


@query("pad_arrays", "WITH w AS (SELECT item_id, [length(x) FOR x IN string_split(text, ' ')] AS a FROM benchmark), m AS (SELECT *, max(len(a)) OVER (PARTITION BY item_id // 16) AS n FROM w) SELECT item_id, array_to_string(list_resize(a, n, 0), ',') AS ids, array_to_string([CASE WHEN i < len(a) THEN 1 ELSE 0 END FOR i IN range(n)], ',') AS mask FROM m")
def pad_arrays(spark, d):
    """Batches of 16 items, each filled up to its longest, with the mask."""
    own = table(spark, d, "benchmark").select("item_id", F.transform(F.split("text", " "), lambda x: F.length(x)).alias("ids"))
    out = X2.padded_batches(own, "ids", F.floor(F.col("item_id") / 16), 0)
    return out.select("item_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ids", "mask")])


@query("mean_pooling", "SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL")
def mean_pooling(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return X.mean_vector(v, ["label"], "v").select("label", F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_STEPS = "WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT CAST(ceil(n / 16.0) AS BIGINT) AS total, CAST(floor(ceil(n / 16.0) / 10) AS BIGINT) AS warm FROM n), s AS (SELECT total, warm, unnest(range(total)) AS i FROM p)"


def training_steps(spark, d):
    """A row for each step of one pass over the documents in batches of 16: step, total and warm-up steps."""
    plan = X.exposure_plan(F.col("n_rows"), F.lit(0), F.lit(16), F.lit(1.0))
    total = T.shard_counts(table(spark, d, "documents")).select(plan["additional_steps"].alias("total"))
    return total.where("total > 0").select("total", F.floor(F.col("total") / 10).alias("warm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("step"))


@query("learning_rates", f"{_STEPS} SELECT i AS step, round(CASE WHEN i < warm THEN least(1.0, (i + 1) / greatest(1, warm)) ELSE 0.5 * (1 + cos(pi() * least(1.0, greatest(0.0, (i - warm) / greatest(1, total - warm))))) END, 9)::DOUBLE AS rate FROM s")
def learning_rates(spark, d):
    rate = X.learning_rate(F.col("step"), F.col("warm"), F.col("total"), "cosine")
    return training_steps(spark, d).select("step", F.round(rate, 9).alias("rate"))


@query("udf_embed_stub")
def udf_embed_stub(spark, d):
    return table(spark, d, "documents").select("doc_id", U.ngram_encoder()(F.col("text")).alias("embedding"))


WORD_MERGES = [("t", "h"), ("th", "e"), ("e", "r"), ("i", "n"), ("in", "g"), ("o", "n")]
_MERGED = "array_to_string([regexp_replace(w, '(.)', '◀\\1▶', 'g') FOR w IN string_split_regex(trim(lower(text)), '\\s+')], '')"
for _a, _b in WORD_MERGES:
    _MERGED = f"replace({_MERGED}, '◀{_a}▶◀{_b}▶', '◀{_a}{_b}▶')"
_MERGED = _MERGED.replace("\\s+')], '')", "\\s+')], '■')")


@query("ngram_bpe", f"SELECT item_id, array_to_string(regexp_extract_all({_MERGED}, '◀([^▶]*)▶', 1), ' ') AS pieces FROM benchmark")
def ngram_bpe(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(U.word_pieces(WORD_MERGES)(F.lower("text")), " ").alias("pieces"))


@query("span_mask")
def span_mask(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(U.span_mask(0.15, 3, 5)(F.col("doc_id"), F.size(X.words(F.col("text"))))).alias("n_masked"))


@query("stream_file_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_file_dedup(spark, d):
    """The events as a file stream, each event once whatever the order of the files, drained into a table."""
    from ..streaming import streams

    where = scratch_path(spark, "stream")
    own = streams.file_stream(spark, f"{d}/events.parquet")
    once = streams.first_seen(own.select("event_type", "event_id"), ["event_type", "event_id"])
    with streams.disk_state(spark):
        streams.drain(once, f"{where}/out", f"{where}/state")
    return spark.read.parquet(f"{where}/out").groupBy("event_type").agg(F.count("event_id").alias("n"))
