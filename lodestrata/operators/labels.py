"""Label construction: from many raw measurements to contradiction-free sparse labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority_label(rules: Sequence[tuple[Column, int]]) -> Column:
    """The label of the first rule that holds, else null. A condition that is null does not hold."""
    out = F.lit(None).cast("int")
    for condition, label in reversed(rules):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def potency_label(value: Column, active: float, inactive: float) -> Column:
    """1 from `active` on, 0 up to `inactive`, null in between and for null."""
    return F.when(value >= active, 1).when(value <= inactive, 0)


def without_contradictions(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """One row for each key whose labels all agree; null labels do not count."""
    agreed = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.min(label).alias(label), F.max(label).alias("__other"))
    return agreed.where(F.col(label) == F.col("__other")).drop("__other")


def without_members(df: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df less the rows whose keys are in held. Null keys match nothing, so they stay."""
    return df.join(held.select(*keys).dropna().distinct(), list(keys), "left_anti")


def with_enough_members(df: DataFrame, group: str, members: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` distinct members."""
    enough = df.groupBy(group).agg(F.count_distinct(*members).alias("__n")).where(F.col("__n") >= least).select(group)
    return df.join(enough, group, "left_semi")


def label_profile(df: DataFrame, group: str, label: str, total: Column) -> DataFrame:
    """Per group: observed, positive, negative, missing, density, prevalence (null if nothing is observed), is_constant.

    total: aggregate that gives how many labels the group could have.
    """
    y = F.col(label)
    counts = df.groupBy(group).agg(F.count(y).alias("observed"), F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"), total.alias("__total"))
    return counts.select(
        group,
        "observed",
        "positive",
        "negative",
        (F.col("__total") - F.col("observed")).alias("missing"),
        F.round(F.try_divide(F.col("observed"), F.col("__total")), 9).alias("density"),
        F.round(F.try_divide(F.col("positive"), F.col("observed")), 9).alias("prevalence"),
        ((F.col("observed") > 0) & ((F.col("positive") == 0) | (F.col("negative") == 0))).alias("is_constant"),
    )


def label_matrix(df: DataFrame, row: str | Sequence[str], column: str, label: str, columns: Sequence[str]) -> DataFrame:
    """The wide form for a short list of columns: a label each, null where none is known. Rows must be free of contradictions."""
    return df.groupBy(*([row] if isinstance(row, str) else row)).pivot(column, list(columns)).agg(F.max(label))


def with_reason(df: DataFrame, reasons: Sequence[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """The first reason in order that applies, '' if the row is kept."""
    out = F.lit("")
    for text, condition in reversed(reasons):
        out = F.when(condition, F.lit(text)).otherwise(out)
    return df.withColumn(name, out)
