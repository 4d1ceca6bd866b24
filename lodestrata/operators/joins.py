"""Joins with a contract."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch_path


def _unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, whose plan fails on the first repeated key; the count rides on the shuffle the join needs anyhow."""
    n = F.count("*").over(Window.partitionBy(*keys))
    message = F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys)))
    return df.withColumn("__n", n).where(F.assert_true(F.col("__n") == 1, message).isNull()).drop("__n")


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join whose right keys must be unique."""
    return left.join(_unique(right, keys), list(keys), how)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """An inner join with unique keys on both sides; other columns that both have get suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    named = [s.withColumnsRenamed({c: c + x for c in both}) for s, x in ((left, suffixes[0]), (right, suffixes[1]))]
    return _unique(named[0], keys).join(_unique(named[1], keys), list(keys))


def zero_filled_counts(base: DataFrame, facts: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Every row of base with the number of facts of its key, 0 where there are none."""
    counts = facts.groupBy(key).agg(F.count("*").alias(name))
    return base.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def pairs_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All pairs of rows that share a key; null and empty keys match nothing."""
    return left.where(F.col(key) != "").join(right.where(F.col(key) != ""), key)


def pair_groups(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`pairs_by_key` without making the pairs: for each key that both sides have, the number of rows of each and of their pairs.
    With the rows themselves this says all that the pairs do, in the size of the input; null and empty keys match nothing."""
    count = lambda df, name: df.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias(name))
    return count(left, "n_left").join(count(right, "n_right"), key).withColumn("n_pairs", F.col("n_left") * F.col("n_right"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key. Spark cuts each task's groups to n before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def containing_pairs(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text_id, part_id) wherever a part is a substring of a text. texts: text_id, text; parts: part_id, part.

    The words of a part that have white space on both sides are words of every text that holds it. Its longest pair of such words
    that follow each other is the key of an equi-join, by hash, or the longest word where there is but one; pairs keep frequent
    words from being keys. `contains` decides. Only parts without an inner word meet all texts, as a stated query set. Null and
    empty parts match nothing.
    """
    words = F.split("part", r"\s+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    known = parts.where("part <> ''").withColumn("__inner", inner)
    keyed = F.array_max(F.transform(_neighbours(F.col("__inner")), lambda k: F.struct((F.length(k.a) + F.length(k.b)).alias("n"), k.alias("k")))).getField("k")
    anchored = known.where(F.size("__inner") > 0).withColumn("anchor", F.xxhash64(keyed.a, keyed.b))
    single = anchored.where(F.size("__inner") == 1).isEmpty()
    own = texts.where("text is not null").withColumn("__w", F.split("text", r"\s+"))
    pairs = _neighbours(F.col("__w"))
    # single words are sent only if a part has no pair
    sent = pairs if single else F.concat(pairs, F.transform("__w", lambda w: F.struct(w.alias("a"), F.lit("").alias("b"))))
    own = own.select("text_id", F.explode(F.array_distinct(F.transform(sent, lambda k: F.xxhash64(k.a, k.b)))).alias("anchor"))
    near = own.join(anchored.select("part_id", "anchor"), "anchor").select("text_id", "part_id")
    near = near.join(texts, "text_id").join(anchored.select("part_id", "part"), "part_id").where("contains(text, part)").select("text_id", "part_id")
    rest = texts.join(known.where(F.size("__inner") == 0).select("part_id", "part"), F.expr("contains(text, part)")).select("text_id", "part_id")
    return near.unionAll(rest)


def _neighbours(words: Column) -> Column:
    """(a, b) of the words that follow each other; of a single word that and ''."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n == 1, F.transform(words, lambda w: F.struct(w.alias("a"), F.lit("").alias("b")))).otherwise(pairs)


def grid_gaps(observed: DataFrame, dims: Sequence[DataFrame]) -> DataFrame:
    """The keys of the full grid of the dimensions, and of what was observed outside, with `state`: present, missing or extra.

    Only values of the first dimension that miss something are crossed with the others: those whose observed keys in the grid are
    as many as the other dimensions allow are complete. So the work follows what was observed and what is missing. Null is a value.
    """
    dims = [d.distinct() for d in dims]
    keys = [c for d in dims for c in d.columns]
    lead = dims[0].columns

    def same(a: str, b: str, names: Sequence[str]) -> list[Column]:
        return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]

    seen = observed.select(*keys).distinct()
    for n, d in enumerate(dims):
        seen = seen.alias("o").join(d.withColumn(f"__in{n}", F.lit(True)).alias("d"), same("o", "d", d.columns), "left").select(*[f"o.{k}" for k in keys], *[F.col(f"__in{m}") for m in range(n + 1)])
    inside = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"__in{n}"), F.lit(False)) for n in range(len(dims))))
    seen = seen.select(*keys, inside.alias("__inside"))
    present = seen.where("__inside").select(*keys)
    room = dims[0].sparkSession.range(1).select(F.lit(1).cast("decimal(38,0)").alias("__room"))
    for d in dims[1:]:
        room = room.crossJoin(d.agg(F.count("*").alias("__size"))).select((F.col("__room") * F.col("__size")).alias("__room"))  # one row
    full = present.groupBy(*lead).agg(F.count("*").alias("__n")).crossJoin(room).where("__n = __room")
    grid = dims[0].alias("d").join(full.alias("f"), same("d", "f", lead), "left_anti")
    for d in dims[1:]:
        grid = grid.crossJoin(d)
    missing = grid.alias("g").join(present.alias("p"), same("g", "p", keys), "left_anti").select(*keys, F.lit("missing").alias("state"))
    return seen.select(*keys, F.when(F.col("__inside"), "present").otherwise("extra").alias("state")).unionByName(missing)


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and the names of fields that differ (null equals null) between two runs; rows without a twin list `missing`."""
    a, b = left.select(key, F.struct(*fields).alias("__a")), right.select(key, F.struct(*fields).alias("__b"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields]))
    return a.join(b, key, "full").select(key, F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.array(F.lit("missing"))).otherwise(differs).alias("mismatches"))


def nearest_by_cosine(queries: DataFrame, corpus: DataFrame, equal: Sequence[str] = (), block: int = 1024, copies: int = 16) -> DataFrame:
    """For each query (query_id, vector) the corpus row (corpus_id, vector) of the largest cosine, ties to the lowest id.

    Exact. A stated query set meets all rows, in blocks: both sides are packed into blocks of at most `block` vectors, query blocks
    are copied `copies` times, and a join on the columns in `equal`, the length of the vectors and the number of the copy pairs
    each corpus block with every query block of its key once. A pair is a matrix product; each task keeps its best for each query,
    and the best of these wins. Nothing passes through the driver, the corpus is read once, and rows of other keys do not meet.
    Rows of the query's own id do not count; null or empty vectors and rows with a null key meet nothing; queries without a
    partner have no row.
    """
    import numpy as np
    import pyarrow as pa

    def packed(df: DataFrame, i: str) -> DataFrame:
        names = ["key", "dim", f"{i}s", f"{i}_v"]

        def run(batches):
            held: dict = {}

            def out(key):
                ids, v = (np.concatenate(x) for x in zip(*held.pop(key)))
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*key, ids.tobytes(), v.tobytes()], [pa.string(), pa.int32(), pa.binary(), pa.binary()])], names=names)

            for batch in batches:
                keys = batch.column(0).dictionary_encode()
                code, dim, ids = np.asarray(keys.indices), np.asarray(batch.column(1)), np.asarray(batch.column(2))
                for c, n in {*zip(code.tolist(), dim.tolist())}:
                    here = np.flatnonzero((code == c) & (dim == n))
                    v = np.asarray(batch.column(3).take(pa.array(here)).flatten(), float).reshape(-1, n)
                    key = (keys.dictionary[c].as_py(), n)
                    for a in range(0, len(here), block):
                        if key in held and sum(len(x) for x, _ in held[key]) + len(here[a : a + block]) > block:
                            yield out(key)
                        held.setdefault(key, []).append((ids[here[a : a + block]], v[a : a + block]))
                if sum(len(x) for parts in held.values() for x, _ in parts) > 32 * block:
                    for key in list(held):
                        yield out(key)
            for key in list(held):
                yield out(key)

        known = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.col(i).isNotNull()
        for c in equal:
            known &= F.col(c).isNotNull()
        key = F.to_json(F.struct(*equal)) if equal else F.lit("")
        rows = df.where(known).select(key.alias("key"), F.size("vector").alias("dim"), F.col(i).cast("long").alias(i), F.col("vector").cast("array<double>").alias("vector"))
        return rows.mapInArrow(run, f"key string, dim int, {i}s binary, {i}_v binary")

    def best(batches):
        found: dict[bytes, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["query_ids"], np.int64)
                ids = np.frombuffer(r["corpus_ids"], np.int64)
                order = np.argsort(ids, kind="stable")
                s = np.frombuffer(r["query_id_v"], float).reshape(len(q), -1) @ np.frombuffer(r["corpus_id_v"], float).reshape(len(ids), -1)[order].T
                s[q[:, None] == ids[order][None, :]] = -np.inf
                at = s.argmax(1)
                got, got_id = s[np.arange(len(q)), at], ids[order][at]
                if r["query_ids"] not in found:
                    found[r["query_ids"]] = [got, got_id]
                else:
                    top, top_id = found[r["query_ids"]]
                    better = (got > top) | (got == top) & (got_id < top_id)
                    found[r["query_ids"]] = [np.where(better, got, top), np.where(better, got_id, top_id)]
                if len(found) > 256:
                    yield from answers(found)
                    found.clear()
        yield from answers(found)

    def answers(found):
        for raw, (got, got_id) in found.items():
            has = np.isfinite(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64)[has]), pa.array(got_id[has]), pa.array(got[has])], names=["query_id", "corpus_id", "similarity"])

    asked = packed(queries, "query_id").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    held = packed(corpus, "corpus_id").withColumn("__copy", F.pmod(F.xxhash64("corpus_ids"), F.lit(copies)).cast("int"))
    pairs = held.join(asked, ["key", "dim", "__copy"]).select("query_ids", "query_id_v", "corpus_ids", "corpus_id_v")
    rows = pairs.mapInArrow(best, "query_id long, corpus_id long, similarity double")
    return rows.groupBy("query_id").agg(F.max_by(F.struct("corpus_id", "similarity"), F.struct(F.col("similarity"), -F.col("corpus_id"))).alias("b")).select("query_id", "b.corpus_id", "b.similarity")


def nearest_by_tokens(queries: DataFrame, corpus: DataFrame, first: float = 0.5, fall: float = 4.0) -> DataFrame:
    """For each query (query_id, token) the corpus set (corpus_id, token) of the largest Jaccard similarity, ties to the lowest id.

    Sets are kept rare tokens first. Two sets of similarity t or more share a token among the first n - ceil(t n) + 1 of each, and
    their sizes differ by at most the factor t; so a round looks up only the rare ends of the queries, under a threshold, and what
    the ends share bounds what the sets can share. A query
    that has found a similarity of its threshold or more is done; one that has found less asks once more, under that; one that has
    found none goes on under a threshold that falls by the factor `fall`, until a single shared token would do. So common tokens
    are looked up only for queries that nothing better answers. Rounds are few, each writes what it has found.

    A query that shares no token has corpus_id null and similarity 0. A set does not meet itself (same id). Rows must be distinct.
    """
    spark = queries.sparkSession

    def fixed(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    freq = corpus.groupBy("token").agg(F.count("*").alias("df"))

    def sets(df: DataFrame, i: str, n: str) -> DataFrame:
        """i, n and the tokens' hashes, rare ones first; tokens of no corpus set come before all."""
        known = df.join(freq, "token", "left").select(i, F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.xxhash64("token").alias("h")).alias("t"))
        return known.groupBy(i).agg(F.array_sort(F.collect_list("t")).alias("t")).select(i, F.size("t").alias(n), F.transform("t", lambda x: x["h"]).alias(f"{n}_t"))

    q, c = fixed(sets(queries, "query_id", "nq"), "query-sets"), fixed(sets(corpus, "corpus_id", "nc"), "corpus-sets")
    least = 1.0 / ((q.agg(F.max("nq")).first()[0] or 1) + (c.agg(F.max("nc")).first()[0] or 1))
    prefix = lambda n, t: F.col(n) - F.ceil(F.col(n) * t - 1e-9).cast("int") + 1
    index = c.select("corpus_id", "nc", F.posexplode("nc_t").alias("pc", "token"))
    # what two sets may still share behind the last token that their rare ends share
    behind = F.least(F.min(F.col("nq") - 1 - F.col("pq")), F.min(F.col("nc") - 1 - F.col("pc")))
    left = fixed(q.select("query_id", F.lit(first).alias("t"), F.lit(0.0).alias("similarity"), F.lit(None).cast("long").alias("corpus_id")), "left")
    done = []
    while True:
        asked = left.join(q, "query_id").select("query_id", "t", "nq", F.posexplode(F.slice("nq_t", F.lit(1), F.greatest(F.lit(0), F.least(F.col("nq"), prefix("nq", F.col("t")))))).alias("pq", "token"))
        fits = (F.col("nc") >= F.col("nq") * F.col("t") - 1e-9) & (F.col("nc") * F.col("t") <= F.col("nq") + 1e-9) & (F.col("pc") < prefix("nc", F.col("t"))) & (F.col("query_id") != F.col("corpus_id"))
        met = asked.join(index, "token").where(fits).groupBy("query_id", "corpus_id", "t", "nq", "nc").agg((F.count("*") + behind).alias("most"), F.count("*").alias("least"))
        met = met.where(F.col("most") >= (F.col("nq") + F.col("nc")) * F.col("t") / (1 + F.col("t")) - 1e-9)
        met = met.withColumn("high", F.col("most") / (F.col("nq") + F.col("nc") - F.col("most")))
        # what a set surely reaches is a bar for all others of its query
        bar = met.groupBy("query_id").agg(F.max(F.col("least") / (F.col("nq") + F.col("nc") - F.col("least"))).alias("bar"))
        met = met.join(bar, "query_id").where(F.col("high") >= F.col("bar") - 1e-12).select("query_id", "corpus_id")
        both = met.join(q, "query_id").join(c, "corpus_id").withColumn("k", F.size(F.array_intersect("nq_t", "nc_t")))
        scored = both.select("query_id", "corpus_id", (F.col("k") / (F.col("nq") + F.col("nc") - F.col("k"))).alias("similarity"))
        best = scored.groupBy("query_id").agg(F.max_by(F.struct("corpus_id", "similarity"), F.struct(F.col("similarity"), -F.col("corpus_id"))).alias("b"))
        now = left.select("query_id", "t").join(best, "query_id", "left").select("query_id", "t", F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"), F.col("b.corpus_id").alias("corpus_id"))
        now = fixed(now, "found")
        over = (F.col("similarity") >= F.col("t") - 1e-12) | (F.col("t") <= least)
        done.append(now.where(over))
        falling = F.when(F.col("similarity") > 0, F.col("similarity")).otherwise(F.greatest(F.col("t") / fall, F.lit(least)))
        left = now.where(~over).withColumn("t", falling)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done).select("query_id", "corpus_id", "similarity")


def threshold_flags(similarity: Column, cuts: Sequence[float], slack: float = 1e-7) -> dict[str, Column]:
    """hit_ge_0_70 and the like: whether the similarity reaches each cut, with a little slack."""
    return {f"hit_ge_{c:.2f}".replace(".", "_"): similarity + F.lit(slack) >= F.lit(c) for c in cuts}


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, default) -> DataFrame:
    """df with a column of a dictionary (key, value), the default where the key is unknown."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def mismatch_rates(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: the pairs found, and for each field and for any of them the share of pairs that differ (null equals null)."""
    pairs = field_mismatches(left, right, key, fields).where(~F.array_contains("mismatches", "missing"))
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    return pairs.agg(F.count("*").alias("n_pairs"), *[share(F.array_contains("mismatches", f)).alias(f"rate_{f}") for f in fields], share(F.size("mismatches") > 0).alias("rate_any"))


def brute_force_agreement(queries: DataFrame, corpus: DataFrame, nearest: DataFrame, slack: float = 1e-6) -> DataFrame:
    """query_id, best (the largest cosine by meeting every corpus row) and whether `nearest` has it within the slack.

    queries: a stated few (32, say), so they are copied to all tasks; each task keeps its best before the shuffle.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    norm = lambda df, i: df.select(i, F.col("vector").cast("array<double>").alias("v")).withColumn("v", F.transform("v", lambda x: x / F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-300))))
    q = norm(queries, "query_id").withColumnRenamed("v", "q")
    met = norm(corpus, "corpus_id").crossJoin(F.broadcast(q)).where("query_id <> corpus_id")
    best = met.groupBy("query_id").agg(F.max(dot(F.col("q"), F.col("v"))).alias("best"))
    both = best.join(nearest.select("query_id", "similarity"), "query_id", "left")
    return both.select("query_id", F.round("best", 6).alias("best"), F.coalesce(F.abs(F.col("best") - F.col("similarity")) <= slack, F.lit(False)).alias("agrees"))
