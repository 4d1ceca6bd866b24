"""Group-aware splits, samples, and proofs that nothing leaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..sources.shared import scratch_path
from .ordered import prefix_sums


def hash_order(seed: int, key: Column) -> Column:
    """A seeded order that every engine gives alike."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of each group, by seeded hash. Tasks cut their groups to n before the shuffle."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def evenly_spaced(df: DataFrame, n: int, total: Column, position: str) -> DataFrame:
    """Rows whose position is floor(i * (total - 1) / (n - 1)) for i below n."""
    grid = df.sparkSession.range(n).crossJoin(df.agg(total.alias("__t"))).select(F.floor(F.col("id") * (F.col("__t") - 1) / F.lit(max(1, n - 1))).alias(position)).distinct()
    return df.join(grid, position, "left_semi")


def hold_out_groups(df: DataFrame, group: str, seed: int, share: float) -> DataFrame:
    """groups (group, n, held): whole groups in seeded order until at least share of the rows, rounded half to even, are held."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    order = Window.orderBy(hash_order(seed, F.col(group)), group)  # a row for each group
    target = F.greatest(F.lit(1), F.bround(F.sum("n").over(Window.partitionBy()) * F.lit(share)))
    return sizes.withColumn("held", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) < target)


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """df with `fold`: rows of a group share one, by hash; no shuffle."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def fold_parts(df: DataFrame, fold: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The training rows (all folds but k) and the validation rows (fold k), both without the fold column; rows without a fold are
    in neither."""
    return df.where(F.col(fold) != k).drop(fold), df.where(F.col(fold) == k).drop(fold)


def split_partition(split: Column, valid: Column, name: str = "partition") -> Column:
    """train, valid or test from a split column that knows train and test and a flag for the rows of train that validate; the plan
    fails at any other split."""
    known = F.assert_true(F.coalesce(split.isin("train", "test"), F.lit(False)), F.concat(F.lit("unknown split: "), F.coalesce(split, F.lit("null"))))
    return F.when(known.isNull(), F.when(split == "test", "test").when(F.coalesce(valid, F.lit(False)), "valid").otherwise("train")).alias(name)


#: So many groups are placed one after the other by one task; more are first placed by runs.
FOLD_GROUPS = 1 << 16


def _filled(rows: DataFrame, room: float) -> DataFrame:
    """rows (first, then: their order; n) with `taken`: in order, each that still fits in the room is taken.

    Rows of more than half of the room left are large: at most one of them is taken. Up to the first large row that fits behind
    the small ones before it, or the small one that fills half of the room, the small rows are taken and the large ones refused;
    that row is taken too. So each round at least halves the room, and there are no more rounds than its logarithm; running totals
    are made by parts. When few rows are left one task places them.
    """
    spark, used, rest, out = rows.sparkSession, 0, rows, []
    while True:
        left = room - used
        out.append(rest.where(F.col("n") > left).withColumn("taken", F.lit(False)))
        rest = rest.where(F.col("n") <= left)
        if rest.count() <= FOLD_GROUPS:
            break
        path = scratch_path(spark, "fill")
        marked = rest.withColumn("__small", F.when(F.col("n") * 2 <= left, F.col("n")).otherwise(0))
        prefix_sums(marked, [], ["first", "then"], {"before": "__small"}).write.parquet(path)
        run = spark.read.parquet(path)
        small = F.col("__small") > 0
        ends = F.when(small, (F.col("before") + F.col("n")) * 2 > left).otherwise(F.col("before") + F.col("n") <= left)
        stop = run.where(ends).agg(F.min(F.struct("first", "then", "before", "n")).alias("s")).select("s.*").first()
        if stop.before is None:
            out.append(run.withColumn("taken", small).drop("before", "__small"))
            rest = rest.limit(0)
            break
        earlier = (F.col("first") < stop.first) | ((F.col("first") == stop.first) & (F.col("then") <= stop.then))
        last = (F.col("first") == stop.first) & (F.col("then") == stop.then)
        out.append(run.where(earlier).withColumn("taken", small | last).drop("before", "__small"))
        rest, used = run.where(~earlier).drop("before", "__small"), used + stop.before + stop.n

    def place(batches):
        import pyarrow as pa

        total = used
        for batch in batches:
            taken = []
            for n in batch.column("n").to_pylist():
                taken.append(total + n <= room)
                total += n * taken[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], names=[*batch.schema.names, "taken"])

    schema = StructType([*rows.schema.fields, StructField("taken", BooleanType())])
    out.append(rest.repartition(1).sortWithinPartitions("first", "then").mapInArrow(place, schema))
    return reduce(DataFrame.unionByName, out)


def greedy_split(df: DataFrame, group: str, shares: tuple[float, float] = (0.8, 0.1), seed: int | None = None, big_first: bool = True) -> DataFrame:
    """group, n, part: groups fill train, then valid, where they still fit, else test.

    Order: big_first puts groups over half of the valid or test room first, then the rest, each in seeded order; without it
    groups go by falling size. Null is a group too.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "groups")
    df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n")).withColumn("then", F.coalesce(hash_order(seed or 0, F.col("group")), F.lit(""))).write.parquet(path)
    sizes = spark.read.parquet(path)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    half = min(shares[1], 1 - shares[0] - shares[1]) * total / 2
    rows = sizes.withColumn("first", (F.col("n") <= F.lit(half)).cast("long") if big_first else -F.col("n"))
    train = _filled(rows, shares[0] * total)
    valid = _filled(train.where("not taken").drop("taken"), shares[1] * total)
    parts = train.where("taken").withColumn("part", F.lit("train")).drop("taken").unionByName(valid.withColumn("part", F.when(F.col("taken"), "valid").otherwise("test")).drop("taken"))
    return parts.select(F.col("group").alias(group), "n", "part")


def straddling(df: DataFrame, part: str, keys: Sequence[str]) -> DataFrame:
    """For each kind of key the number of values that occur in more than one part: all must be 0. Nulls and '' do not count."""
    long = df.select(part, F.explode(F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(k).cast("string").alias("key")) for k in keys])).alias("k")).select(part, "k.*").where("key <> ''")
    per = long.groupBy("key_type", "key").agg(F.count_distinct(part).alias("parts"))
    return per.groupBy("key_type").agg(F.count("*").alias("n_keys"), F.count_if(F.col("parts") > 1).alias("n_straddling"))


def compare_sets(a: DataFrame, b: DataFrame, keys: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Sizes of intersection, union and differences, coverage of b (null if b is empty) and Jaccard (1 if both are empty), by group."""
    left = a.select(*groups, *keys).distinct().withColumn("__a", F.lit(1))
    right = b.select(*groups, *keys).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, [*groups, *keys], "full")
    rows = both.groupBy(*groups).agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"), F.count("*").alias("n_union"))
    return rows.select(*groups, "n_a", "n_b", "n_both", "n_union", (F.col("n_a") - F.col("n_both")).alias("only_a"), (F.col("n_b") - F.col("n_both")).alias("only_b"), F.round(F.try_divide("n_both", "n_b"), 9).alias("coverage"), F.round(F.coalesce(F.try_divide("n_both", "n_union"), F.lit(1.0)), 9).alias("jaccard"))


def blinded(df: DataFrame, target: str, split: str, test: str = "test") -> DataFrame:
    """Targets of test rows become null."""
    return df.withColumn(target, F.when(F.col(split) != test, F.col(target)))


def reusable(saved: DataFrame, wanted: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and state of each artifact: `reuse` if every digest agrees, `stale` if one differs, `new` if nothing is saved."""
    from .joins import field_mismatches

    diff = field_mismatches(wanted, saved, key, fields)
    return wanted.select(key).join(diff, key).join(saved.select(key, F.lit(True).alias("__s")), key, "left").select(key, F.when(F.col("__s").isNull(), "new").when(F.size("mismatches") == 0, "reuse").otherwise("stale").alias("state"))


def wrapped(df: DataFrame, position: str, total: int, length: int) -> DataFrame:
    """An epoch of `length` draws over `total` rows (position from 0): draw k is row k modulo total."""
    draws = df.sparkSession.range(length).select(F.col("id").alias("draw"), F.pmod("id", F.lit(total)).alias(position))
    return draws.join(df, position)


def wrap_padded(df: DataFrame, position: str, total: int, parts: int) -> DataFrame:
    """part and place of every row (position from 0), dealt in turn; the first row is repeated until all parts are equal."""
    size = -(-total // parts) * parts
    slots = df.sparkSession.range(size).select(F.col("id").alias("slot"), F.when(F.col("id") < total, F.col("id")).otherwise(F.lit(0)).alias(position))
    return slots.join(df, position).withColumn("part", F.pmod("slot", F.lit(parts))).withColumn("place", F.floor(F.col("slot") / parts)).drop("slot")
