"""Profiles of sparse and skewed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import percentiles, prefix_sums

DIGITS = 6


def finite(value: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def summary(df: DataFrame, value: str, groups: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """n, min, q05, q25, median, q75, q95, max, mean, sd (population) of the finite values; n 0 and nulls if there are none."""
    v = finite(F.col(value))
    q = percentiles(df.withColumn("__value", v), groups, "__value", (0.05, 0.25, 0.5, 0.75, 0.95)).select(*[F.col(g).alias(f"__of_{g}") for g in groups], "q")
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    rows = df.groupBy(*groups).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd")).join(q, same, "left")
    r = lambda c, name: F.round(c, digits).alias(name)
    names = ("q05", "q25", "median", "q75", "q95")
    return rows.select(*groups, "n", r(F.col("min"), "min"), *[r(F.col("q")[i], x) for i, x in enumerate(names)], r(F.col("max"), "max"), r(F.col("mean"), "mean"), r(F.col("sd"), "sd"))


def count_of_counts(df: DataFrame, row: Sequence[str], name: str = "observed") -> DataFrame:
    """How many rows have each number of entries, and their share; non-empty numbers only."""
    sizes = df.groupBy(*row).agg(F.count("*").alias(name)).groupBy(name).agg(F.count("*").alias("n_rows"))
    return sizes.crossJoin(sizes.agg(F.sum("n_rows").alias("__all"))).select(name, "n_rows", F.round(F.col("n_rows") / F.col("__all"), 9).alias("fraction"))


def diversity(df: DataFrame, group: str, category: str, blank: str = "<acyclic>", digits: int = DIGITS) -> DataFrame:
    """Shannon entropy (nats), normalised entropy, effective number, distinct, singletons, and the shares of the largest and five largest."""
    sizes = df.groupBy(group, F.when(F.coalesce(F.btrim(category), F.lit("")) == "", blank).otherwise(F.col(category)).alias("__c")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group).orderBy(F.desc("k"), "__c")
    top5 = sizes.withColumn("__r", F.row_number().over(w)).groupBy(group).agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("klnk"), F.count("*").alias("n_distinct"), F.max("k").alias("top"), F.sum(F.when(F.col("__r") <= 5, F.col("k"))).alias("top5"), F.count_if(F.col("k") == 1).alias("ones")
    )
    h = F.greatest(F.ln("n") - F.col("klnk") / F.col("n"), F.lit(0.0))
    r = lambda c, name: F.round(c, digits).alias(name)
    return top5.select(group, "n", "n_distinct", r(h, "entropy"), r(F.try_divide(h, F.ln("n_distinct")), "evenness"), r(F.exp(h), "effective"), r(F.col("top") / F.col("n"), "top1_share"), r(F.col("top5") / F.col("n"), "top5_share"), r(F.col("ones") / F.col("n_distinct"), "singleton_fraction"))


def most_common(df: DataFrame, category: str, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """The k most frequent categories (of each group), ties by name."""
    sizes = df.where(F.col(category).isNotNull()).groupBy(*groups, category).agg(F.count("*").alias("n"))
    if not groups:
        return sizes.orderBy(F.desc("n"), category).limit(k)
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), category))).where(F.col("rank") <= k)


def gap_by_threshold(df: DataFrame, groups: Sequence[str], error: str, similarity: str, cut: float, least: int = 1, digits: int = DIGITS) -> DataFrame:
    """Mean error below and from a similarity cut, and the relative gap; nulls unless both sides have `least` rows."""
    low, high = F.col(similarity) < cut, F.col(similarity) >= cut
    e = F.col(error)
    rows = df.groupBy(*groups).agg(F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"), F.avg(F.when(low, e)).alias("a"), F.avg(F.when(high, e)).alias("b"), F.avg(e).alias("all"))
    both = (F.col("n_low") >= least) & (F.col("n_high") >= least)
    return rows.select(*groups, "n_low", "n_high", F.round("a", digits).alias("mean_low"), F.round("b", digits).alias("mean_high"), F.round(F.when(both, F.try_divide(F.col("a") - F.col("b"), F.col("all"))), digits).alias("relative_gap"))


def exposure(df: DataFrame, group: str, error: str, exposed: str, digits: int = DIGITS) -> DataFrame:
    """Mean error of all, exposed and unexposed rows, the change without exposed ones, and the exposed share."""
    e, x = F.col(error), F.col(exposed)
    rows = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(x).alias("n_exposed"), F.avg(e).alias("a"), F.avg(F.when(x, e)).alias("b"), F.avg(F.when(~x, e)).alias("c"))
    r = lambda c, name: F.round(c, digits).alias(name)
    return rows.select(group, "n", "n_exposed", r(F.col("a"), "mae_all"), r(F.col("b"), "mae_exposed"), r(F.col("c"), "mae_unexposed"), r(F.col("c") - F.col("a"), "delta"), r(F.col("n_exposed") / F.col("n"), "exposed_fraction"))


def size_audit(df: DataFrame, group: str, size: Column, cap: int) -> DataFrame:
    """Rows, valid, invalid, within and over the cap and the largest valid size: for each group and for all (`*`), in one pass."""
    own = df.select(F.col(group).cast("string").alias(group), size.alias("__s"))
    valid = F.col("__s") > 0
    rows = own.rollup(group).agg(F.count("*").alias("n_rows"), F.count_if(valid).alias("n_valid"), F.count_if(valid & (F.col("__s") <= cap)).alias("n_within"), F.count_if(valid & (F.col("__s") > cap)).alias("n_over"), F.max(F.when(valid, F.col("__s"))).alias("max_size"), F.grouping(group).alias("__g"))
    return rows.select(F.when(F.col("__g") == 1, "*").otherwise(F.col(group)).alias(group), "n_rows", "n_valid", (F.col("n_rows") - F.col("n_valid")).alias("n_invalid"), "n_within", "n_over", "max_size")


def membership_rollup(df: DataFrame, splits: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over all rows (`all`, `all`) and for each split column and each of its values."""
    long = df.withColumn("__k", F.array(F.struct(F.lit("all").alias("split"), F.lit("all").alias("member")), *[F.struct(F.lit(s).alias("split"), F.col(s).cast("string").alias("member")) for s in splits]))
    return long.withColumn("__k", F.explode("__k")).groupBy("__k.split", "__k.member").agg(*aggregates)


def dispersion(df: DataFrame, keys: Sequence[str], value: str, digits: int = DIGITS) -> DataFrame:
    """Number, mean, population sd and largest absolute value of repeats of one key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_pop(v), digits).alias("sd"), F.round(F.max(F.abs(v)), digits).alias("max_abs"))


def smallest_quarter(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with `subset`: `small` for the first floor(n/4) of the group in order, else `rest`."""
    rows = prefix_sums(df.withColumn("__one", F.lit(1)), [group], order, {"__r": "__one"})
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    both = rows.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    return both.withColumn("subset", F.when(F.col("__r") < F.floor(F.col("__n") / 4), "small").otherwise("rest")).drop("__r", "__n", "__g", "__one")


def best_by(df: DataFrame, keys: Sequence[str], metric: str, name: str, largest: bool = False) -> DataFrame:
    """The row of the best metric of each key, ties by name; a max_by, so partial results are combined before the shuffle."""
    value = F.when(F.col(metric).isNotNull(), F.col(metric) if largest else -F.col(metric))
    others = [c for c in df.columns if c not in keys]
    tie = df.groupBy(*keys).agg(F.max(value).alias("__m"))
    top = df.join(tie, list(keys)).where(value == F.col("__m"))
    return top.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(name)).alias("__b")).select(*keys, "__b.*")


def outcome_counts(df: DataFrame, groups: Sequence[str], a: str, b: str, smaller_is_better: Column, tolerance: float = 1e-12) -> DataFrame:
    """Wins, losses and ties of a against b, by utility beyond the tolerance."""
    d = F.when(smaller_is_better, F.col(b) - F.col(a)).otherwise(F.col(a) - F.col(b))
    return df.groupBy(*groups).agg(F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties"))
