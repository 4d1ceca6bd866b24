"""Queries that profile, score and compare."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import inference as I
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import profile as P
from ..operators.ordered import percentiles
from ..sources.sinks import with_position
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


@query("pivot_counts", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def pivot_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().fillna(0)


@query("dispersion_across_repeats", "SELECT user_id, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(max(abs(value)), 6) AS max_abs FROM events GROUP BY ALL")
def dispersion_across_repeats(spark, d):
    return P.dispersion(table(spark, d, "events"), ["user_id", "event_type"], "value")


_CELLS = "c AS (SELECT l_returnflag AS task, l_linestatus AS method, l_linenumber AS step, avg(l_discount) AS score FROM lineitem GROUP BY ALL)"


def cells(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("step")).agg(F.round(F.avg("l_discount"), 9).alias("score"))


_CELLS = _CELLS.replace("avg(l_discount)", "round(avg(l_discount), 9)")


@query("select_by_validation", f"WITH {_CELLS} SELECT task, method, step, score FROM c QUALIFY row_number() OVER (PARTITION BY task, method ORDER BY score, step) = 1")
def select_by_validation(spark, d):
    return P.best_by(cells(spark, d), ["task", "method"], "score", "step")


@query("smallest_quartile", "WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, CASE WHEN r <= floor(n / 4) THEN 'small' ELSE 'rest' END AS subset, count(*) AS n, median(n_chars) AS median FROM r GROUP BY ALL")
def smallest_quartile(spark, d):
    own = P.smallest_quarter(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")
    return percentiles(own, ["source", "subset"], "n_chars", (0.5,)).select("source", "subset", "n", F.col("q")[0].alias("median"))


@query("size_audit", "SELECT coalesce(source, '*') AS source, count(*) AS n_rows, count(*) FILTER (s > 0) AS n_valid, count(*) FILTER (NOT s > 0) AS n_invalid, count(*) FILTER (s BETWEEN 1 AND 2000) AS n_within, count(*) FILTER (s > 2000) AS n_over, max(s) FILTER (s > 0) AS max_size FROM (SELECT source, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents) GROUP BY ROLLUP (source)")
def size_audit(spark, d):
    return P.size_audit(table(spark, d, "documents"), "source", X.letters_only_length(F.col("text")).cast("long"), 2000)


@query("rollup_all_vs_split", """SELECT split, member, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM (SELECT 'all' AS split, 'all' AS member, l_quantity FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag, l_quantity FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_quantity FROM lineitem) GROUP BY ALL""")
def rollup_all_vs_split(spark, d):
    own = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return P.membership_rollup(own, ["l_returnflag", "l_linestatus"], [F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity")])


@query("log_scrape", "WITH l AS (SELECT event_id || '/' || user_id || ' [' || event_type || ']' AS line FROM events) SELECT CAST(regexp_extract(line, '(\\d+)/(\\d+)\\s+\\[', 2) AS BIGINT) AS total, count(*) AS n, max(CAST(regexp_extract(line, '(\\d+)/(\\d+)\\s+\\[', 1) AS BIGINT)) AS last FROM l GROUP BY 1")
def log_scrape(spark, d):
    from ..sources.tables import scrape

    lines = table(spark, d, "events").select(F.concat("event_id", F.lit("/"), "user_id", F.lit(" ["), "event_type", F.lit("]")).alias("value"))
    return scrape(lines).groupBy("total").agg(F.count("*").alias("n"), F.max("done").alias("last"))


@query("json_flatten", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_flatten(spark, d):
    k = F.from_json("props", "k bigint").getField("k")
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"), "label")


def _nearest_sql(where: str, on: str) -> str:
    return f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS corpus_id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id {on} WHERE {where})
SELECT query_id, corpus_id, round(s, 6) AS similarity, s + 1e-7 >= 0.7 AS hit_ge_0_70, s + 1e-7 >= 0.95 AS hit_ge_0_95 FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, corpus_id) = 1"""


def _flags(df):
    return df.select("query_id", "corpus_id", F.round("similarity", 6).alias("similarity"), *[c.alias(n) for n, c in J.threshold_flags(F.col("similarity"), (0.70, 0.95)).items()])


@query("nearest_embedding_exact", _nearest_sql("a.vec_id % 5 = 0", ""))
def nearest_embedding_exact(spark, d):
    """Each fifth vector (the stated query set) against all."""
    v = _vectors(spark, d)
    return _flags(J.nearest_by_cosine(v.where("corpus_id % 5 = 0").withColumnRenamed("corpus_id", "query_id"), v))


@query("in_group_nearest", _nearest_sql("a.vec_id % 5 = 0", "AND a.label = b.label"))
def in_group_nearest(spark, d):
    v = _vectors(spark, d)
    return _flags(J.nearest_by_cosine(v.where("corpus_id % 5 = 0").withColumnRenamed("corpus_id", "query_id"), v, equal=["label"]))


@query("nearest_token_jaccard", """WITH q AS (SELECT DISTINCT item_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM benchmark), c AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents),
nq AS (SELECT id, count(*) AS n FROM q GROUP BY 1), nc AS (SELECT id, count(*) AS n FROM c GROUP BY 1), s AS (SELECT q.id AS qid, c.id AS cid, count(*) AS k FROM q JOIN c USING (t) WHERE q.id + 1000000000 <> c.id GROUP BY ALL)
SELECT qid AS query_id, cid AS corpus_id, round(k / (nq.n + nc.n - k), 6) AS similarity FROM s JOIN nq ON nq.id = qid JOIN nc ON nc.id = cid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY k / (nq.n + nc.n - k) DESC, cid) = 1""")
def nearest_token_jaccard(spark, d):
    """The document closest to each benchmark item, by distinct words."""
    tokens = lambda df, i, n, base: df.select((F.col(i) + base).alias(n), F.explode(F.array_distinct(X.words(F.lower("text")))).alias("token"))
    best = J.nearest_by_tokens(tokens(table(spark, d, "benchmark"), "item_id", "query_id", 1_000_000_000), tokens(table(spark, d, "documents"), "doc_id", "corpus_id", 0))
    return best.select((F.col("query_id") - 1_000_000_000).alias("query_id"), "corpus_id", F.round("similarity", 6).alias("similarity"))


@query("applicability_gap", """SELECT user_id, count(*) FILTER (value < 60) AS n_low, count(*) FILTER (value >= 60) AS n_high, round(avg(e) FILTER (value < 60), 6) AS mean_low, round(avg(e) FILTER (value >= 60), 6) AS mean_high,
round(CASE WHEN count(*) FILTER (value < 60) >= 5 AND count(*) FILTER (value >= 60) >= 5 THEN (avg(e) FILTER (value < 60) - avg(e) FILTER (value >= 60)) / avg(e) END, 6) AS relative_gap FROM (SELECT *, abs(value - 50) AS e FROM events) GROUP BY 1""")
def applicability_gap(spark, d):
    return P.gap_by_threshold(table(spark, d, "events").withColumn("e", F.abs(F.col("value") - 50)), ["user_id"], "e", "value", 60.0, 5)


_PRED = "p AS (SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice AS y, l_quantity * 1500 AS p, l_discount FROM lineitem)"


def predictions(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"), "l_discount")


@query("exposure_sensitivity", f"""WITH {_PRED}, e AS (SELECT l_returnflag, abs(y - p) AS e, l_discount >= 0.05 AS x FROM p) SELECT l_returnflag, count(*) AS n, count(*) FILTER (x) AS n_exposed, round(avg(e), 4) AS mae_all, round(avg(e) FILTER (x), 4) AS mae_exposed, round(avg(e) FILTER (NOT x), 4) AS mae_unexposed,
round(avg(e) FILTER (NOT x) - avg(e), 4) AS delta, round(count(*) FILTER (x) / count(*), 4) AS exposed_fraction FROM e GROUP BY 1""")
def exposure_sensitivity(spark, d):
    own = predictions(spark, d).select("l_returnflag", F.abs(F.col("y") - F.col("p")).alias("e"), (F.col("l_discount") >= 0.05).alias("x"))
    return P.exposure(own, "l_returnflag", "e", "x", 4)


_DIV = """WITH s AS (SELECT {g} AS g, {c} AS c, count(*) AS k FROM {t} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k DESC, c) AS r FROM s), a AS (SELECT g, CAST(sum(k) AS BIGINT) AS n, sum(k * ln(k)) AS klnk, count(*) AS m, max(k) AS top, sum(k) FILTER (r <= 5) AS top5, count(*) FILTER (k = 1) AS ones FROM r GROUP BY g), h AS (SELECT *, greatest(ln(n) - klnk / n, 0.0) AS h FROM a)
SELECT g AS {g}, n, m AS n_distinct, round(h, 6) AS entropy, CASE WHEN m > 1 THEN round(h / ln(m), 6) END AS evenness, round(exp(h), 6) AS effective, round(top / n, 6) AS top1_share, round(top5 / n, 6) AS top5_share, round(ones / m, 6) AS singleton_fraction FROM h"""


@query("diversity_by_group", _DIV.format(g="source", c="lang", t="documents"))
def diversity_by_group(spark, d):
    return P.diversity(table(spark, d, "documents").select("source", "lang"), "source", "lang")


@query("token_diversity", "SELECT lang, token, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents) GROUP BY ALL)) WHERE rank <= 15")
def token_diversity(spark, d):
    tokens = table(spark, d, "documents").select("lang", F.explode(X.words(F.lower("text"))).alias("token"))
    return P.most_common(tokens, "token", 15, ["lang"])


@query("regression_metrics", f"WITH {_PRED} SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(corr(y, p), 6) AS pearson FROM p GROUP BY ALL")
def regression_metrics(spark, d):
    return M.regression(predictions(spark, d), ["l_returnflag", "l_linestatus"], "y", "p")


_SCORED = "s AS (SELECT d.source, d.doc_id, l.quality AS y, least(d.n_chars / 5000.0, 1.0)::DOUBLE AS p FROM documents d JOIN labels l USING (doc_id))"


def scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query("auroc_by_group", f"WITH {_SCORED}, r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2.0 AS r FROM s), a AS (SELECT source, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(r) FILTER (y = 1) AS sr FROM r GROUP BY 1) SELECT source, n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) AS auroc FROM a")
def auroc_by_group(spark, d):
    return M.auroc(scored(spark, d), ["source"], "y", "p")


@query("auprc_by_group", f"WITH {_SCORED}, g AS (SELECT source, p, count(*) FILTER (y = 1) AS k, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT source, k, sum(k) OVER w AS tp, sum(n) OVER w AS al FROM g WINDOW w AS (PARTITION BY source ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT source, CAST(sum(k) AS BIGINT) AS n_pos, round(sum(k * tp / al) / nullif(sum(k), 0), 6) AS auprc FROM c GROUP BY 1")
def auprc_by_group(spark, d):
    return M.average_precision(scored(spark, d), ["source"], "y", "p")


@query("spearman_by_group", "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events) SELECT event_type, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman_by_group(spark, d):
    return M.spearman(table(spark, d, "events"), ["event_type"], "value", "user_id")


_RATES = """tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc"""


@query("confusion_at_half", f"WITH {_SCORED}, c AS (SELECT source, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM s GROUP BY 1) SELECT source, {_RATES} FROM c")
def confusion_at_half(spark, d):
    return M.confusion(scored(spark, d), ["source"], "y", F.col("p") >= 0.5)


_SWEEP = f"{_SCORED}, b AS (SELECT least(floor(p * 20 + 1e-9), 20) AS k, y FROM s), c AS (SELECT round(i / 20.0::DOUBLE, 9) AS threshold, count(*) FILTER (y = 1 AND k >= i) AS tp, count(*) FILTER (y = 0 AND k >= i) AS fp, count(*) FILTER (y = 0 AND k < i) AS tn, count(*) FILTER (y = 1 AND k < i) AS fn FROM range(21) t(i), b GROUP BY ALL)"


@query("threshold_sweep", f"WITH {_SWEEP} SELECT threshold, {_RATES} FROM c")
def threshold_sweep(spark, d):
    return M.threshold_sweep(scored(spark, d), "y", "p", 20)


@query("best_threshold", f"WITH {_SWEEP}, r AS (SELECT threshold, {_RATES} FROM c) SELECT threshold, f1 FROM r WHERE f1 IS NOT NULL ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return M.best_threshold(M.threshold_sweep(scored(spark, d), "y", "p", 20), "f1")


@query("calibration_ece", f"WITH {_SCORED}, b AS (SELECT CAST(least(floor(p * 12), 11) AS INTEGER) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS f FROM s GROUP BY 1), t AS (SELECT sum(n) AS a FROM b) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_score, round(f, 6) AS positive_rate, round(abs(m - f), 6) AS gap, round(coalesce(n / a * abs(m - f), 0), 6) AS ece_part FROM range(12) r(i) LEFT JOIN b ON b.bin = i, t")
def calibration_ece(spark, d):
    return M.calibration(scored(spark, d), "y", "p", 12)


@query("brier", f"WITH {_SCORED}, z AS (SELECT source, y, p, 4 * p - 2 AS x FROM s) SELECT source, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(greatest(x, 0.0) + ln(1 + exp(-abs(x))) - y * x), 6) AS log_loss FROM z GROUP BY 1")
def brier(spark, d):
    return M.probability_losses(scored(spark, d).withColumn("x", 4 * F.col("p") - 2), ["source"], "y", "p", "x")


@query("class_weights", "SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM labels GROUP BY 1")
def class_weights(spark, d):
    return M.class_weights(table(spark, d, "labels"), "quality")


@query("zscore_on_train", "WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_linestatus = 'F') SELECT l_returnflag, round(avg((l_quantity - m) / s), 6) AS mean_z, round(max((l_quantity - m) / s), 6) AS max_z FROM lineitem, f GROUP BY 1")
def zscore_on_train(spark, d):
    z = M.standardised(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), "l_quantity", F.col("l_linestatus") == "F")
    return z.groupBy("l_returnflag").agg(F.round(F.avg("z"), 6).alias("mean_z"), F.round(F.max("z"), 6).alias("max_z"))


@query("median_impute", "WITH j AS (SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN d.n_chars::DOUBLE END AS v FROM documents d LEFT JOIN labels l USING (doc_id)), m AS (SELECT median(v) AS m FROM j WHERE doc_id % 5 <> 0) SELECT source, round(avg(coalesce(v, m)), 6) AS mean FROM j, m GROUP BY 1")
def median_impute(spark, d):
    own = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source", F.when(F.col("quality") == 1, F.col("n_chars").cast("double")).alias("v"))
    return M.imputed(own, "v", F.col("doc_id") % 5 != 0).groupBy("source").agg(F.round(F.avg("v"), 6).alias("mean"))


_RANK = f"{_CELLS}, r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY task, method, score) - 1) / 2.0 AS r, score = max(score) OVER (PARTITION BY task, method) AS best FROM c WINDOW w AS (PARTITION BY task, method ORDER BY score DESC))"


def ranked(spark, d):
    best = F.col("score") == F.max("score").over(Window.partitionBy("task", "method"))
    return cells(spark, d).select("*", M.average_rank(["task", "method"], -F.col("score")).alias("r"), best.alias("best"))


@query("avg_rank_desc", f"WITH {_RANK} SELECT task, method, step, r::DOUBLE AS rank FROM r")
def avg_rank_desc(spark, d):
    return ranked(spark, d).select("task", "method", "step", F.col("r").alias("rank"))


@query("best_flag_ties", f"WITH {_RANK} SELECT step, round(avg(r), 6) AS mean_rank, median(r)::DOUBLE AS median_rank, count(*) FILTER (best) AS n_best FROM r GROUP BY 1")
def best_flag_ties(spark, d):
    return ranked(spark, d).groupBy("step").agg(F.round(F.avg("r"), 6).alias("mean_rank"), F.percentile("r", F.lit(0.5)).alias("median_rank"), F.count_if("best").alias("n_best"))


@query("versus_reference", f"WITH {_CELLS} SELECT c.step, count(*) FILTER (c.score - b.score > 1e-12) AS wins, count(*) FILTER (c.score - b.score < -1e-12) AS losses, count(*) FILTER (abs(c.score - b.score) <= 1e-12) AS ties FROM c JOIN c b ON c.task = b.task AND c.method = b.method AND b.step = 7 GROUP BY 1")
def versus_reference(spark, d):
    ref = F.max(F.when(F.col("step") == 7, F.col("score"))).over(Window.partitionBy("task", "method"))
    return P.outcome_counts(cells(spark, d).withColumn("ref", ref), ["step"], "score", "ref", F.lit(False))


@query("two_level_mean", f"WITH {_CELLS} SELECT method, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS n FROM (SELECT method, task, avg(score) AS m FROM c GROUP BY ALL) GROUP BY 1")
def two_level_mean(spark, d):
    return cells(spark, d).groupBy("method", "task").agg(F.avg("score").alias("m")).groupBy("method").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.count("*").alias("n"))


@query("difference_in_differences", f"WITH {_CELLS} SELECT task, round((max(score) FILTER (method = 'O' AND step = 1) - max(score) FILTER (method = 'O' AND step = 7)) - (max(score) FILTER (method = 'F' AND step = 1) - max(score) FILTER (method = 'F' AND step = 7)), 9) AS did FROM c GROUP BY 1")
def difference_in_differences(spark, d):
    at = lambda m, s: F.max(F.when((F.col("method") == m) & (F.col("step") == s), F.col("score")))
    return cells(spark, d).groupBy("task").agg(F.round((at("O", 1) - at("O", 7)) - (at("F", 1) - at("F", 7)), 9).alias("did"))


@query("modal_category", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def modal_category(spark, d):
    return P.most_common(table(spark, d, "events"), "event_type", 1, ["user_id"]).drop("rank")


_DIFF = "d AS (SELECT l_returnflag AS g, l_linenumber AS k, s, round(avg(l_discount) FILTER (l_linestatus = 'O') - avg(l_discount) FILTER (l_linestatus = 'F'), 4) AS diff FROM (SELECT *, CAST(l_quantity AS INTEGER) % 3 AS s FROM lineitem) GROUP BY ALL)"


def differences(spark, d):
    own = table(spark, d, "lineitem").withColumn("s", F.col("l_quantity").cast("int") % 3)
    avg = lambda x: F.avg(F.when(F.col("l_linestatus") == x, F.col("l_discount")))
    return own.groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("k"), "s").agg(F.round(avg("O") - avg("F"), 4).alias("diff"))


_SIGN = "SELECT g, count(*) FILTER (diff > 0) AS n_pos, count(*) FILTER (diff < 0) AS n_neg FROM d GROUP BY 1"
_SIGN_P = "round(CASE WHEN n_pos + n_neg = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(least(n_pos, n_neg) + 1), lambda i: factorial((n_pos + n_neg)::INTEGER)::DOUBLE / factorial(i::INTEGER)::DOUBLE / factorial((n_pos + n_neg - i)::INTEGER)::DOUBLE)) / pow(2.0, n_pos + n_neg)) END, 9)"


@query("sign_test", f"WITH {_DIFF}, n AS ({_SIGN}) SELECT g, n_pos, n_neg, {_SIGN_P} AS p FROM n")
def sign_test(spark, d):
    return I.sign_test(differences(spark, d), ["g"], "diff")


@query("holm", f"WITH {_DIFF}, n AS ({_SIGN}), p AS (SELECT g, {_SIGN_P} AS p FROM n), h AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, g) + 1) * p) AS h FROM p) SELECT g, p, round(max(h) OVER (ORDER BY p, g ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM h")
def holm(spark, d):
    return I.holm(I.sign_test(differences(spark, d), ["g"], "diff").select("g", "p"), "p", tie="g")


@query("wilcoxon_exact", f"""WITH RECURSIVE {_DIFF}, r AS (SELECT g, diff, CAST(2 * (rank() OVER (PARTITION BY g ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY g, abs(diff)) - 1) / 2.0) AS INTEGER) AS u, row_number() OVER (PARTITION BY g ORDER BY abs(diff), k, s) AS i FROM d WHERE diff <> 0),
a AS (SELECT g, count(*) AS n, sum(u) FILTER (diff > 0) AS plus, sum(u) AS total, median(diff) AS median FROM r GROUP BY 1),
w AS (SELECT g, 0 AS i, 0 AS s, 1.0::DOUBLE AS c FROM a UNION ALL SELECT g, i, s, sum(c) AS c FROM (SELECT w.g, w.i + 1 AS i, w.s + z.f * r.u AS s, w.c FROM w JOIN r ON r.g = w.g AND r.i = w.i + 1, (VALUES (0), (1)) z(f)) GROUP BY ALL)
SELECT a.g, n, coalesce(plus, 0) / 2.0::DOUBLE AS w_plus, round(least(1.0, 2.0 * (SELECT sum(c) FROM w WHERE w.g = a.g AND w.i = a.n AND w.s <= least(coalesce(plus, 0), total - coalesce(plus, 0))) / pow(2.0, n)), 9) AS p, round((2.0 * coalesce(plus, 0) - total) / total, 9) AS rank_biserial, round(median, 9) AS median FROM a""")
def wilcoxon_exact(spark, d):
    return I.wilcoxon(differences(spark, d), ["g"], "diff")


_BLOCKS = "b AS (SELECT l_linenumber, CAST(l_quantity AS INTEGER) AS q, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS x, round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS y, round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS z FROM lineitem GROUP BY ALL)"


@query("friedman3", f"""WITH {_BLOCKS}, k AS (SELECT {", ".join(f"({' + '.join(f'({o} < {c})::INT' for o in 'xyz')}) + (({' + '.join(f'({o} = {c})::INT' for o in 'xyz')}) + 1) / 2.0 AS r{c}" for c in "xyz")} FROM b WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
s AS (SELECT count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rz) AS sz, sum(rx * rx + ry * ry + rz * rz) AS q FROM k), t AS (SELECT n, (2 * ((sx * sx + sy * sy + sz * sz) / n::DOUBLE - 12.0 * n) / (q - 12.0 * n))::DOUBLE AS x FROM s) SELECT n, round(x, 9) AS statistic, round(exp(-x / 2), 9) AS p FROM t""")
def friedman3(spark, d):
    avg = lambda f: F.round(F.avg(F.when(F.col("l_returnflag") == f, F.col("l_discount"))), 6)
    own = table(spark, d, "lineitem").groupBy("l_linenumber", F.col("l_quantity").cast("int").alias("q")).agg(avg("A").alias("x"), avg("N").alias("y"), avg("R").alias("z"))
    return I.friedman3(own, ["x", "y", "z"])


@query("ols_residual", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def ols_residual(spark, d):
    return I.ols(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


_UNITS = "u AS (SELECT user_id, avg(value) AS v, count(*)::DOUBLE AS c, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM events GROUP BY user_id)"
_DRAW = "CAST(('0x' || substr(md5('{seed}|' || {r} || '|' || {i}), 1, 7)) AS BIGINT)"


def units(spark, d):
    own = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"), F.count("*").cast("double").alias("c"))
    return with_position(own, "user_id", name="i")


_SAMPLE = f"{_UNITS}, s AS (SELECT r, u.v, u.c FROM range(200) t(r), u x, u WHERE u.i = {_DRAW.format(seed=11, r='r', i='x.i')} % x.n)"


@query("bootstrap_mean_ci", f"WITH {_SAMPLE}, m AS (SELECT r, avg(v) AS m FROM s GROUP BY r) SELECT (SELECT count(*) FROM u) AS n, round((SELECT avg(v) FROM u), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_mean_ci(spark, d):
    return I.bootstrap_mean(units(spark, d), "v", 200, 11)


@query("bootstrap_spearman", f"WITH {_SAMPLE}, k AS (SELECT r, rank() OVER (PARTITION BY r ORDER BY v) + (count(*) OVER (PARTITION BY r, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY r ORDER BY c) + (count(*) OVER (PARTITION BY r, c) - 1) / 2.0 AS b FROM s), m AS (SELECT r, corr(a, b) AS m FROM k GROUP BY r) SELECT count(*) AS n_finite, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m WHERE m IS NOT NULL AND NOT isnan(m)")
def bootstrap_spearman(spark, d):
    return I.bootstrap_spearman(units(spark, d), "v", "c", 200, 11)


@query("permutation_p", f"WITH {_UNITS}, z AS (SELECT i, v - (SELECT avg(value) FROM events) AS z FROM u), m AS (SELECT r, abs(avg(CASE WHEN {_DRAW.format(seed=13, r='r', i='i')} % 2 = 0 THEN z ELSE -z END)) AS m FROM range(500) t(r), z GROUP BY r) SELECT round((count(*) FILTER (m >= (SELECT abs(avg(z)) FROM z) - 1e-9) + 1) / (count(*) + 1), 9) AS p FROM m")
def permutation_p(spark, d):
    centre = table(spark, d, "events").agg(F.avg("value").alias("centre"))
    return I.sign_flip_p(units(spark, d).crossJoin(centre).select("i", (F.col("v") - F.col("centre")).alias("z")), "z", 500, 13)
