"""Metric states: sums that are made by part, stored, merged and read off, so that new rows never need old ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """sums: the state, columns that add up over rows and parts; read: metrics from the added columns (by name)."""

    sums: Mapping[str, Column]
    read: Mapping[str, Callable[[], Column]]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def regression_metric(truth: str, predicted: str) -> Metric:
    """mae, rmse, r2 and Pearson's r of rows where both are known; a metric without spread is null."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    both = y.isNotNull() & p.isNotNull()
    own = lambda x: F.coalesce(F.sum(F.when(both, x)), F.lit(0.0))
    sums = {"n": F.count(F.when(both, 1)), "abs_e": own(F.abs(y - p)), "sq_e": own((y - p) * (y - p)), "y": own(y), "yy": own(y * y), "p": own(p), "pp": own(p * p), "yp": own(y * p)}
    c = F.col
    spread = lambda a, b, ab: c(ab) - c(a) * c(b) / c("n")
    return Metric(sums, {
        "mae": lambda: _ratio(c("abs_e"), c("n")),
        "rmse": lambda: F.sqrt(_ratio(c("sq_e"), c("n"))),
        "r2": lambda: 1 - _ratio(c("sq_e"), spread("y", "y", "yy")),
        "pearson": lambda: _ratio(spread("y", "p", "yp"), F.sqrt(spread("y", "y", "yy") * spread("p", "p", "pp"))),
    })


def binary_metric(truth: str, predicted: str) -> Metric:
    """accuracy, balanced accuracy (mean of recall and specificity) and f1 of 0/1 rows; other rows do not count."""
    y, p = F.col(truth), F.col(predicted)
    count = lambda a, b: F.count(F.when((y == a) & (p == b), 1))
    c = F.col
    return Metric({"tp": count(1, 1), "fp": count(0, 1), "tn": count(0, 0), "fn": count(1, 0)}, {
        "accuracy": lambda: _ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")),
        "balanced_accuracy": lambda: (_ratio(c("tp"), c("tp") + c("fn")) + _ratio(c("tn"), c("tn") + c("fp"))) / 2,
        "f1": lambda: _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
    })


def moments_metric(value: str) -> Metric:
    """mean and population standard deviation of a whole number; its sums are exact."""
    v = F.col(value).cast("decimal(19,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    c = F.col
    mean = lambda: _ratio(c("s").cast("double"), c("n"))
    return Metric({"n": F.count(value), "s": F.coalesce(F.sum(v).cast("decimal(38,0)"), zero), "q": F.coalesce(F.sum((v * v).cast("decimal(38,0)")).cast("decimal(38,0)"), zero)}, {
        "mean": mean,
        "sd": lambda: F.sqrt(F.greatest(_ratio(c("q").cast("double"), c("n")) - mean() * mean(), F.lit(0.0))),
    })


def update(rows: DataFrame, groups: Sequence[str], metric: Metric) -> DataFrame:
    """The state of these rows, one row a group; partial sums combine before the shuffle."""
    return rows.groupBy(*groups).agg(*[s.alias(n) for n, s in metric.sums.items()])


def merge(states: DataFrame, groups: Sequence[str], metric: Metric) -> DataFrame:
    """The state of all rows together, from states of their parts."""
    kinds = dict(states.dtypes)
    return states.groupBy(*groups).agg(*[F.sum(n).cast(kinds[n]).alias(n) for n in metric.sums])


def compute(state: DataFrame, groups: Sequence[str], metric: Metric) -> DataFrame:
    """groups, the state's columns and its metrics."""
    return state.select("*", *[f().alias(n) for n, f in metric.read.items()])


class StateStore:
    """States by part under a folder. A part that is written again replaces itself, so a repeated micro-batch counts once."""

    def __init__(self, path: str, groups: Sequence[str], metric: Metric):
        self.path, self.groups, self.metric = path, list(groups), metric

    def put(self, rows: DataFrame, part: int) -> None:
        update(rows, self.groups, self.metric).write.mode("overwrite").parquet(f"{self.path}/part={part}")

    def parts(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.path).parquet(self.path)

    def merged(self, spark: SparkSession) -> DataFrame:
        return merge(self.parts(spark), self.groups, self.metric)

    def computed(self, spark: SparkSession) -> DataFrame:
        return compute(self.merged(spark), self.groups, self.metric)

    def reset(self, spark: SparkSession) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
