"""Features, masks and draws as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch_path
from .text import softmax, uniform, words


def fingerprint(df: DataFrame, key: str, tokens: Column, size: int, counts: bool) -> DataFrame:
    """key, bit, n: the hashed tokens of each row, sparse; n is the count, or 1 where only presence matters."""
    bit = lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")
    rows = df.select(key, F.explode(F.transform(tokens, bit)).alias("bit"))
    return rows.groupBy(key, "bit").agg((F.count("*") if counts else F.max(F.lit(1).cast("long"))).alias("n"))


def descriptors(text: Column) -> Column:
    """Named numeric features of a text; what cannot be computed (a null text, a mean of nothing) is NaN."""
    w = words(text)
    n = F.size(w)
    nan = F.lit(float("nan"))
    number = lambda c: F.coalesce(c.cast("double"), nan)
    return F.struct(
        number(F.length(text)).alias("n_chars"),
        number(F.when(text.isNotNull(), n)).alias("n_words"),
        number(F.when(n > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n)).alias("mean_word"),
        number(F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / F.length(text))).alias("digit_share"),
        number(F.when(n > 0, F.size(F.array_distinct(w)) / n)).alias("distinct_share"),
    )


def reordered(tokens: Column, key: Column, seed: int) -> Column:
    """The tokens in a seeded order of their own; fails if they are not the same tokens as before."""
    drawn = F.array_sort(F.transform(tokens, lambda t, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), t.alias("t"))))
    out = F.transform(drawn, lambda x: x.t)
    return F.when(F.assert_true(F.array_sort(out) == F.array_sort(tokens), F.lit("tokens changed")).isNull(), out)


def shifted_distances(df: DataFrame, groups: Sequence[str] = (), far: float = 1e8) -> DataFrame:
    """From long matrices of distances (groups, i, j, d): rows (i + 1, j + 1, d + 1) of those in reach. Position 0 is the start
    token, whose row and column are empty; pairs out of reach (d = far) are left out."""
    return df.where(F.col("d") < far).select(*groups, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), (F.col("d") + 1).alias("d"))


def hop_distances(edges: DataFrame, groups: Sequence[str], most: int | None = None) -> DataFrame:
    """groups, i, j, d: the number of steps from i to j along the edges (groups, i, j), whatever it is, or up to `most`; d of i
    to itself is 0.

    The known distances double in each round: a pair k + 1 to 2k steps apart has a midpoint k steps from its first end. So there
    are as many rounds as the logarithm of the largest distance, each written to the shared folder; null ends are no edges.
    """
    keys = [*groups, "i", "j"]
    spark = edges.sparkSession

    def fixed(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "hops")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    step = edges.select(*groups, "i", "j").unionAll(edges.select(*groups, F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct()
    known = fixed(step.select(*groups, "i").distinct().select(*groups, "i", F.col("i").alias("j"), F.lit(0).alias("d")).unionAll(step.select(*keys, F.lit(1).alias("d"))))
    reach = 1
    while most is None or reach < most:
        far = known.where(F.col("d") == reach).select(*groups, "i", F.col("j").alias("via"))
        if far.isEmpty():
            break
        on = far.join(known.where("d > 0").select(*groups, F.col("i").alias("via"), "j", (F.col("d") + reach).alias("d")), [*groups, "via"]).drop("via")
        known = fixed(known.unionByName(on.select(*known.columns)).groupBy(*keys).agg(F.min("d").alias("d")))
        reach *= 2
    return known if most is None else known.where(F.col("d") <= most)


def padded_batches(df: DataFrame, values: str, batch: Column, fill) -> DataFrame:
    """df with the arrays of each batch filled up to its longest one, and `mask`: 1 at own values, 0 at fillers. Nothing is cut;
    a null array is empty. The longest of a batch is a maximum, combined before the shuffle."""
    own = df.withColumn("__b", batch).withColumn(values, F.coalesce(F.col(values), F.slice(F.array(F.lit(fill)), 1, 0)))
    longest = own.groupBy(F.col("__b").alias("__of")).agg(F.max(F.size(values)).alias("__n"))
    joined = own.join(longest, F.col("__b").eqNullSafe(F.col("__of")))
    gap = F.col("__n") - F.size(values)
    mask = F.concat(F.transform(values, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap))
    return joined.withColumn("mask", mask).withColumn(values, F.concat(values, F.array_repeat(F.lit(fill), gap))).drop("__b", "__of", "__n")


def attention_span(labels: Column, present: Column, span: int) -> Column:
    """For each row i and column j 1 where j is at most one step away, or farther than span, or row i has no label (0); and
    both are present."""
    return F.transform(labels, lambda y, i: F.transform(labels, lambda _, j: (((F.abs(i - j) <= 1) | (F.abs(i - j) > span) | (y == 0)) & (F.get(present, i) == 1) & (F.get(present, j) == 1)).cast("int")))


def top_choices(logits: Column, k: int) -> Column:
    """The k highest of an array of logits as (choice, p), the first on ties first, with p renormalised over them."""
    ranked = F.slice(F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("order"), i.alias("choice")))), 1, k)
    p = softmax(F.transform(ranked, lambda r: -r.order))
    return F.zip_with(ranked, p, lambda r, q: F.struct(r.choice.alias("choice"), q.alias("p")))


def drawn(choices: Column, seed: int, *parts: Column) -> Column:
    """The choice that a seeded uniform number falls on; choices: (choice, p)."""
    u = uniform(seed, *parts)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("got"))
    step = lambda acc, c: F.struct((acc["sum"] + c.p).alias("sum"), F.coalesce(acc.got, F.when(u < acc["sum"] + c.p, c.choice)).alias("got"))
    return F.aggregate(choices, start, step, lambda acc: F.coalesce(acc.got, F.element_at(choices, -1).choice))


def in_range(value: Column, metric: Column) -> Column:
    """Whether a score is finite and possible: auroc, auprc, accuracy in [0, 1]; spearman, pearson, mcc in [-1, 1]; others >= 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    bounds = F.when(metric.isin("auroc", "auprc", "accuracy"), value.between(0, 1)).when(metric.isin("spearman", "pearson", "mcc"), value.between(-1, 1)).otherwise(value >= 0)
    return F.coalesce(finite & bounds, F.lit(False))


def checked(value: Column, metric: Column) -> Column:
    """value; the plan fails where it is out of range for its metric."""
    return F.when(F.assert_true(in_range(value, metric), F.concat(F.lit("bad score of "), metric)).isNull(), value)


def utc_timestamp(text: Column) -> Column:
    """A timestamp from the strict form 2024-01-31T23:59:59Z, else null."""
    strict = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")
    return F.when(strict, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def key_set(text: Column, canonical: Column, keys: Mapping[str, Callable[[Column], Column]] | None = None) -> Column:
    """The keys of a structured text and a status: ok, empty (nothing canonical) or missing.

    keys: name to a function from the canonical form to a key, any column function or Arrow UDF; a failing one gives null and the
    status `failed`. By default the canonical form, the part before its first hyphen, the form without digits, and the same with
    all letters alike.
    """
    made = {n: f(canonical) for n, f in (keys or DEFAULT_KEYS).items()}
    known = F.coalesce(canonical, F.lit(""))
    failed = reduce(lambda a, b: a | b, (k.isNull() for k in made.values()), F.lit(False))
    status = F.when(text.isNull(), "missing").when(known == "", "empty").when(failed, "failed").otherwise("ok")
    return F.struct(*[k.alias(n) for n, k in made.items()], status.alias("status"))


def _frame(canonical: Column) -> Column:
    return F.regexp_replace(canonical, "[0-9]+", "")


DEFAULT_KEYS: dict[str, Callable[[Column], Column]] = {
    "standard": lambda c: c,
    "connectivity": lambda c: F.substring_index(c, "-", 1),
    "scaffold": _frame,
    "generic": lambda c: F.regexp_replace(_frame(c), "[a-z]", "x"),
}
