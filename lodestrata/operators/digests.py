"""Digests of groups of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_digest(value: Column) -> Column:
    """Aggregate: sha256 of the sorted values, joined by line ends. For groups of bounded size."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256)


def ordered_digest(position: Column, value: Column) -> Column:
    """Aggregate: sha256 of the values in order of position, joined by line ends. For groups of bounded size."""
    rows = F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r.v), "\n"), 256)


def membership_digest(*keys: Column) -> Column:
    """Aggregate: the set digest of rows written as JSON lists of their keys."""
    return set_digest(F.to_json(F.array(*[k.cast("string") for k in keys])))


def _row_sums(columns: Sequence[str]) -> list[Column]:
    """Each row's sha256 is cut in four 60-bit numbers; their sums do not depend on the order of rows."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"__s{k}") for k in range(4)]


def _summed() -> Column:
    return F.sha2(F.concat_ws("|", "__n", *[F.coalesce(F.col(f"__s{k}").cast("string"), F.lit("0")) for k in range(4)]), 256).alias("digest")


def table_digest(df: DataFrame) -> DataFrame:
    """One digest of a whole table that does not depend on the order of rows, for tables of any size: the hash of the count and
    of sums that are combined before the shuffle."""
    return df.agg(F.count("*").alias("__n"), *_row_sums(df.columns)).select(_summed())


def group_digests(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, n_rows and the table digest of each group's other columns."""
    sums = df.groupBy(*groups).agg(F.count("*").alias("__n"), *_row_sums(sorted(c for c in df.columns if c not in groups)))
    return sums.select(*groups, F.col("__n").alias("n_rows"), _summed())


#: Hexadecimal digits of a leaf's key: a group has at most 16^4 leaves, and any node 16 children.
LEAF_DIGITS = 4


def merkle_digests(df: DataFrame, groups: Sequence[str], value: Column, digits: int = LEAF_DIGITS) -> DataFrame:
    """groups and digest: the root of a Merkle tree over the values of each group, as a set with multiplicities.

    Equal values are counted before the shuffle. A leaf is a fixed range of keys, those whose sha256 begins with the same
    `digits` digits: the digest of its lines `sha256:count` in order. A node is the digest of `digit:digest` of its children in
    order; those without values are left out. Each level is an aggregation of its own, so no task holds more than a leaf's share
    of a group, whatever the group holds. Two groups with the same values have the same root, and where they differ, equal
    subtrees need not be looked at. Null values do not count; a group without others has no row.
    """
    return _rooted(merkle_leaves(df, groups, value, digits).withColumnRenamed("leaf", "__key"), groups, digits)


def merkle_leaves(df: DataFrame, groups: Sequence[str], value: Column, digits: int = LEAF_DIGITS) -> DataFrame:
    """groups, leaf and digest: the leaves of `merkle_digests`, to find where two groups differ."""
    own = df.select(*groups, F.sha2(value.cast("string"), 256).alias("__h")).where("__h is not null").groupBy(*groups, "__h").agg(F.count("*").alias("__n"))
    lines = own.withColumn("leaf", F.substring("__h", 1, digits)).withColumn("__line", F.concat_ws(":", "__h", "__n"))
    return lines.groupBy(*groups, "leaf").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), "\n"), 256).alias("digest"))


def _rooted(level: DataFrame, groups: Sequence[str], digits: int) -> DataFrame:
    for k in range(digits - 1, -1, -1):
        child = F.concat_ws(":", F.substring("__key", k + 1, 1), "digest").alias("__line")
        level = level.select(*groups, F.substring("__key", 1, k).alias("__key"), child)
        level = level.groupBy(*groups, "__key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), "\n"), 256).alias("digest"))
    return level.select(*groups, "digest")


def ordered_merkle(df: DataFrame, groups: Sequence[str], position: str, value: Column, leaf_rows: int = 1024, fan: int = 16) -> DataFrame:
    """groups and digest: the root of a Merkle tree over the values in order of position (dense, from 0; see `with_position`).

    Leaf k holds positions k * leaf_rows to (k + 1) * leaf_rows - 1: the digest of the values' sha256 in order, a line each; null
    is the empty line. A node holds `fan` children. Groups are levelled up until their longest has one node, a job for each level.
    """
    line = F.coalesce(F.sha2(value.cast("string"), 256), F.lit(""))
    rows = df.select(*groups, F.col(position).cast("long").alias("__p"), F.floor(F.col(position) / leaf_rows).cast("long").alias("__k"), line.alias("__line"))
    tops = rows.groupBy(*[F.col(g).alias(f"__group_{g}") for g in groups]).agg(F.max("__k").alias("__top"))
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__group_{g}"))

    def level(rows: DataFrame, *more: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct("__p", "__line")))
        return rows.groupBy(*groups, "__k", *more).agg(F.sha2(F.array_join(F.transform(held, lambda x: x["__line"]), "\n"), 256).alias("__line"))

    out = level(rows).join(tops, same).select(*groups, "__k", "__top", "__line")
    longest = tops.agg(F.max("__top")).first()[0] or 0
    while longest > 0:
        done = out.where("__top = 0")
        up = out.where("__top > 0").select(*groups, F.col("__k").alias("__p"), F.floor(F.col("__k") / fan).cast("long").alias("__k"), F.floor(F.col("__top") / fan).cast("long").alias("__top"), "__line")
        out = level(up, "__top").select(*groups, "__k", "__top", "__line").unionByName(done)
        longest //= fan
    return out.select(*groups, F.col("__line").alias("digest"))


def json_digest(fields: dict[str, Column]) -> Column:
    """sha256 of a JSON object with its keys in order and nothing between its tokens."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))
