"""Exact paired statistics, all inside the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch_path
from .metrics import average_rank
from .ordered import prefix_sums, value_ranks

DIGITS = 9

#: Draws of a task of `resampled`.
TASK_DRAWS = 1 << 20


def sign_p(k: Column, n: Column) -> Column:
    """Two-sided sign test: twice the smaller binomial tail, at most 1; 1 for no pairs. k of n are positive."""
    m = F.least(k, n - k)
    # term i of the tail from term i - 1: times (n - i + 1) / i
    steps = F.when(m >= 1, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.pow(F.lit(0.5), n.cast("double"))
    tail = F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), lambda acc, i: F.struct((acc.t * (n - i + 1) / i).alias("t"), (acc.s + acc.t * (n - i + 1) / i).alias("s")), lambda acc: acc.s)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def sign_test(df: DataFrame, groups: Sequence[str], difference: str) -> DataFrame:
    """Positive and negative differences (ties dropped) and the exact p of each group."""
    d = F.col(difference)
    rows = df.groupBy(*groups).agg(F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"))
    return rows.withColumn("p", F.round(sign_p(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")), DIGITS))


def wilcoxon(df: DataFrame, groups: Sequence[str], difference: str) -> DataFrame:
    """Exact two-sided signed-rank test, zeros dropped, ties averaged; also the rank-biserial effect and the median.

    Ranks are doubled so they are whole; the number of sign patterns of each rank sum grows by one pair at a time. The
    counts are exact in a double for up to 53 pairs of a group.
    """
    own = df.where(F.col(difference) != 0).select(*groups, F.col(difference).alias("d"), F.abs(difference).alias("m"))
    ranked = own.withColumn("u", (2 * average_rank(groups, F.col("m"))).cast("int"))
    rows = ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("u")).alias("us"), F.sum(F.when(F.col("d") > 0, F.col("u")).otherwise(0)).alias("plus"), F.sum("u").alias("total"), F.percentile("d", F.lit(0.5)).alias("median"))
    size = F.col("total").cast("int")
    start = F.transform(F.sequence(F.lit(0), size), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    step = lambda acc, u: F.transform(acc, lambda x, s: x + F.when(s >= u, F.element_at(acc, F.greatest(s - u + 1, F.lit(1)))).otherwise(0.0))
    counts = F.aggregate("us", start, step)
    low = F.least("plus", F.col("total") - F.col("plus")).cast("int")
    tail = F.aggregate(F.slice(counts, F.lit(1), low + 1), F.lit(0.0), lambda a, x: a + x)
    p = F.least(F.lit(1.0), 2.0 * tail / F.pow(F.lit(2.0), F.col("n").cast("double")))
    return rows.select(*groups, "n", (F.col("plus") / 2.0).alias("w_plus"), F.round(p, DIGITS).alias("p"), F.round((2.0 * F.col("plus") - F.col("total")) / F.col("total"), DIGITS).alias("rank_biserial"), F.round("median", DIGITS).alias("median"))


def holm(df: DataFrame, p: str, name: str = "p_holm", groups: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Holm's step-down adjustment over each family."""
    whole = Window.partitionBy(*groups)
    order = whole.orderBy(p, *([tie] if tie else []))
    scaled = F.least(F.lit(1.0), (F.count("*").over(whole) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("__h", scaled).withColumn(name, F.round(F.max("__h").over(order.rowsBetween(Window.unboundedPreceding, 0)), DIGITS)).drop("__h")


def friedman3(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Friedman's test of three columns over rows (blocks), corrected for ties; two degrees of freedom, so p = exp(-x / 2)."""
    cols = [F.col(c) for c in columns]

    def rank(c):
        below = sum(((o < c).cast("int") for o in cols), F.lit(0))
        same = sum(((o == c).cast("int") for o in cols), F.lit(0))
        return below + (same + 1) / F.lit(2.0)

    ranks = df.dropna(subset=list(columns)).select(*[rank(c).alias(f"r{i}") for i, c in enumerate(cols)])
    sums = ranks.agg(F.count("*").alias("n"), *[F.sum(f"r{i}").alias(f"s{i}") for i in range(3)], F.sum(sum((F.col(f"r{i}") * F.col(f"r{i}") for i in range(3)), F.lit(0.0))).alias("q"))
    n = F.col("n")
    between = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(3)), F.lit(0.0)) / n - 12.0 * n
    x = F.try_divide(2 * between, F.col("q") - 12.0 * n)
    return sums.select("n", F.round(x, DIGITS).alias("statistic"), F.round(F.exp(-x / 2), DIGITS).alias("p"))


def ols(df: DataFrame, groups: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope and intercept of each group."""
    return df.groupBy(*groups).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.regr_count(y, x).alias("n"))


def draw(seed: int, replicate: Column, i: Column) -> Column:
    """A whole number below 2^28 from md5(seed|replicate|i): the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), i.cast("string"))), 1, 7), 16, 10).cast("long")


def resampled(units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """units (i from 0, other columns) drawn with replacement, n a replicate: replicate and the unit's columns.

    The units are counted while the plan is built. A draw is a number of one range, so draws are dealt over tasks however many
    units there are, and Spark knows their size: no side that grows with replicates * n is ever broadcast for a small one.
    """
    spark, n = units.sparkSession, units.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-replicates * n // TASK_DRAWS))
    slots = spark.range(0, replicates * n, 1, parts).select(F.pmod("id", F.lit(replicates)).alias("replicate"), F.expr(f"id div {replicates}").alias("slot"))
    return slots.select("replicate", F.pmod(draw(seed, F.col("replicate"), F.col("slot")), F.lit(max(n, 1))).alias("i")).join(units, "i")


def bootstrap_mean(units: DataFrame, value: str, replicates: int, seed: int) -> DataFrame:
    """Mean and its percentile interval (95 %)."""
    means = resampled(units, replicates, seed).groupBy("replicate").agg(F.avg(value).alias("m"))
    q = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return units.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).crossJoin(q).select("n", "mean", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def bootstrap_spearman(units: DataFrame, a: str, b: str, replicates: int, seed: int, least_finite: float = 0.999) -> DataFrame:
    """Percentile interval of Spearman's rho, ranked anew in every replicate; fails if too few have a finite one. Values may not be
    null."""
    spark, drawn, path = units.sparkSession, resampled(units, replicates, seed), scratch_path(units.sparkSession, "draws")
    # equal pairs of values are drawn often: they are counted, once, and both sides ranked by parts of a replicate
    pairs = drawn.groupBy("replicate", F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))
    pairs.write.parquet(path)
    pairs = spark.read.schema(pairs.schema).parquet(path)
    side = lambda v, name: value_ranks(pairs, ["replicate"], v, "__n").withColumnRenamed("rank", name)
    ranks = pairs.join(side("__a", "ra"), ["replicate", "__a"]).join(side("__b", "rb"), ["replicate", "__b"])
    ranks = ranks.withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))))
    rho = ranks.groupBy("replicate").agg(F.corr("ra", "rb").alias("rho")).where("rho is not null")
    q = rho.agg(F.count("*").alias("n_finite"), F.percentile("rho", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    enough = F.assert_true(F.col("n_finite") >= least_finite * replicates, F.lit("too few replicates have a correlation"))
    return q.where(enough.isNull()).select("n_finite", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def sign_flip_p(units: DataFrame, value: str, replicates: int, seed: int) -> DataFrame:
    """Permutation p of a mean difference: (1 + flips at least as extreme) / (1 + flips); units: i, value."""
    flips = units.sparkSession.range(replicates).select(F.col("id").alias("replicate"))
    sign = F.when(draw(seed, F.col("replicate"), F.col("i")) % 2 == 0, 1).otherwise(-1)
    means = units.crossJoin(flips).groupBy("replicate").agg(F.abs(F.avg(sign * F.col(value))).alias("m"))
    seen = units.agg(F.abs(F.avg(value)).alias("seen"))
    return means.crossJoin(F.broadcast(seen)).agg(F.round((F.count_if(F.col("m") >= F.col("seen") - 1e-9) + 1) / (F.count("*") + 1), DIGITS).alias("p"))


def permutation_spearman(units: DataFrame, a: str, b: str, replicates: int, seed: int, slack: float = 1e-15) -> DataFrame:
    """rho, and the permutation p of |rho|: (1 + permutations at least as extreme) / (1 + permutations); units: i from 0, a, b.

    Ranks do not change under a permutation, so they are made once. A replicate deals the ranks of b anew by a seeded order. Ranks
    and places in a replicate come from running totals by parts, so no task gets all units; values may not be null.
    """
    one = units.select("i", F.col(a).alias("__a"), F.col(b).alias("__b"), F.lit(1).cast("long").alias("__n"))
    side = lambda v, name: value_ranks(one, [], v, "__n").withColumnRenamed("rank", name)
    ranks = one.join(side("__a", "ra"), "__a").join(side("__b", "rb"), "__b").select("i", "ra", "rb")
    seen = ranks.agg(F.corr("ra", "rb").alias("rho"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("i").cast("string")))
    slots = units.sparkSession.range(replicates).select(F.col("id").alias("replicate")).join(ranks, how="cross")
    places = prefix_sums(slots.select("replicate", "rb", "i", order.alias("__o"), F.lit(1).cast("long").alias("__n")), ["replicate"], ["__o", "i"], {"__place": "__n"})
    dealt = places.select("replicate", "rb", F.col("__place").alias("i"))
    rho = dealt.join(ranks.select("i", "ra"), "i").groupBy("replicate").agg(F.abs(F.corr("ra", "rb")).alias("r"))
    counts = rho.crossJoin(F.broadcast(seen)).agg(F.max("rho").alias("rho"), F.count_if(F.col("r") >= F.abs("rho") - slack).alias("extreme"), F.count("*").alias("n"))
    return counts.select(F.round("rho", 6).alias("rho"), F.col("n").alias("n_permutations"), F.round((F.col("extreme") + 1) / (F.col("n") + 1), DIGITS).alias("p"))


def endpoint_record(units: DataFrame, value: str, replicates: int, seed: int) -> DataFrame:
    """One row: n, mean, median, bootstrap interval of the mean, counts of signs and their exact p; units: i from 0, value."""
    v = F.col(value)
    signs = units.agg(F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.count_if(v > 0).alias("n_pos"), F.count_if(v < 0).alias("n_neg"))
    signs = signs.withColumn("p", F.round(sign_p(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")), DIGITS))
    return bootstrap_mean(units, value, replicates, seed).crossJoin(signs)


def paired_bundle(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Three paired methods: Friedman's test over all, and for each contrast the exact signed-rank test with Holm's adjustment."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    long = df.dropna(subset=list(columns)).select(F.explode(F.array(*[F.struct(F.lit(f"{x}-{y}").alias("contrast"), F.round(F.col(x) - F.col(y), 9).alias("diff")) for x, y in pairs])).alias("c")).select("c.*")
    tests = holm(wilcoxon(long, ["contrast"], "diff"), "p", tie="contrast")
    whole = friedman3(df, columns).select(F.col("statistic").alias("friedman"), F.col("p").alias("friedman_p"))
    return tests.crossJoin(F.broadcast(whole))
