"""Running totals and ranks within groups of any size: no task gets a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch_path


def prefix_sums(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str]) -> DataFrame:
    """df with, for each item (name, column) of `sums`, the sum of that column over the rows of the group before this one.

    Rows are range-partitioned by group and order and written once to the shared folder with the number of their partition;
    a row's total is that of its own partition plus those of the group's partitions before, of which there is a row each.
    Null is a group of its own. The order of ties is open.
    """
    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("__part", F.spark_partition_id())
    path = scratch_path(spark, "sums")
    dealt.write.parquet(path)
    fixed = spark.read.schema(dealt.schema).parquet(path)
    up_to = (Window.unboundedPreceding, -1)
    zero = F.lit(0)
    inside = Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(*up_to)
    rows = fixed.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"__in_{k}") for k, c in sums.items()])
    parts = fixed.groupBy("__part", *groups).agg(*[F.sum(c).alias(f"__all_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(*up_to)
    base = parts.select(
        F.col("__part").alias("__of"), *[F.col(g).alias(f"__group_{g}") for g in groups], *[F.coalesce(F.sum(f"__all_{k}").over(earlier), zero).alias(f"__base_{k}") for k in sums]
    )
    same = F.col("__part") == F.col("__of")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__group_{g}"))
    return rows.join(base, same).select(*df.columns, *[(F.col(f"__in_{k}") + F.col(f"__base_{k}")).alias(k) for k in sums])


def value_ranks(df: DataFrame, groups: Sequence[str], value: str, count: str) -> DataFrame:
    """groups, value and rank: of rows that stand for `count` equal ones each, the 1-based rank of each value, ties averaged."""
    own = df.groupBy(*groups, value).agg(F.sum(count).alias("__c"))
    return prefix_sums(own, groups, [value], {"__under": "__c"}).select(*groups, value, (F.col("__under") + (F.col("__c") + 1) / F.lit(2.0)).alias("rank"))


def percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """groups, n and q: the number of values that are not null and their exact percentiles, interpolated, as an array.

    Equal values are counted before the shuffle and ranked by parts. Without groups there is one row, of nulls if there is no
    value; a group without values has no row.
    """
    own = df.select(*groups, F.col(value).cast("double").alias("__v")).where("__v is not null").groupBy(*groups, "__v").agg(F.count("*").alias("__c"))
    rows = prefix_sums(own, groups, ["__v"], {"__under": "__c"})
    size = rows.groupBy(*[F.col(g).alias(f"__group_{g}") for g in groups]).agg(F.max(F.col("__under") + F.col("__c")).alias("__n"))
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__group_{g}"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__under") <= place) & (place < F.col("__under") + F.col("__c")), F.col("__v")))

    places = [(F.col("__n") - 1) * F.lit(float(x)) for x in shares]
    ends = [c.alias(f"__{side}{i}") for i, x in enumerate(places) for side, c in (("low", at(F.floor(x))), ("high", at(F.ceil(x))))]
    found = rows.join(size, same).groupBy(*groups).agg(F.max("__n").alias("n"), *ends)
    n = F.col("n") - 1
    part = [n * F.lit(float(x)) - F.floor(n * F.lit(float(x))) for x in shares]
    return found.select(*groups, "n", F.array(*[F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * w for i, w in enumerate(part)]).alias("q"))
