"""Result files with contracts: what must hold of each file and of all of them together fails the plan where it does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "task string, task_type string, primary_metric string, ckpt string, pretrained map<string,double>"


def _hold(df: DataFrame, problem: Column) -> DataFrame:
    """df, whose plan fails with the problem's text at a row that has one."""
    return df.where(F.assert_true(problem.isNull(), F.concat(F.lit("result files: "), problem)).isNull())


def read_grouped_csv(spark: SparkSession, path: str, row_id: str, group: str, status: str, expected: int, good: str = "ok") -> DataFrame:
    """The rows of (gzip) CSV files with `file`. The plan fails at a row whose status is not the good one, naming row and file,
    and if there are not as many groups as expected. The files are read once for rows and once, only the group, for the count."""
    df = spark.read.option("header", True).csv(path).withColumn("file", F.col("_metadata.file_name"))
    state = F.coalesce(F.col(status), F.lit("none"))
    rows = _hold(df, F.when(state != good, F.concat(F.lit("status of row "), F.coalesce(F.col(row_id), F.lit("without id")), F.lit(" in "), F.col("file"), F.lit(" is "), state)))
    found = df.agg(F.count_distinct(group).alias("__groups"))
    wrong = F.when(F.col("__groups") != expected, F.concat(F.lit(f"expected {expected} groups, found "), F.col("__groups").cast("string")))
    return rows.crossJoin(_hold(found, wrong)).drop("__groups")


def read_results(spark: SparkSession, path: str, expected: int, exclude: tuple[str, ...] = (), pattern: str = "*.json") -> DataFrame:
    """task, task_type, metric, test_mean, test_std, val_mean, val_std, n_seeds and ckpt of JSON result files, one task a file.

    The plan fails, naming files, if one has no task or not its metric's mean, if a task is in two of them, if they come from more
    than one checkpoint, or if there are not as many tasks as expected. Tasks in `exclude` do not count. The contract is a row of
    counts beside the rows, so the files are scanned twice and nothing is collected.
    """
    raw = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path).withColumn("file", F.col("_metadata.file_path"))
    raw = raw.where(~F.coalesce(F.col("task"), F.lit("")).isin(list(exclude)))
    of = lambda part, kind: F.element_at("pretrained", F.concat(F.lit(f"{part}_"), "primary_metric", F.lit(f"_{kind}")))
    values = {f"{p}_{k}": of(p, k) for p in ("test", "val") for k in ("mean", "std")}
    rows = raw.select("file", "task", "task_type", F.col("primary_metric").alias("metric"), *[v.alias(n) for n, v in values.items()], F.element_at("pretrained", F.lit("n_seeds")).cast("long").alias("n_seeds"), "ckpt")
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    rows = _hold(rows, F.when(F.col("task").isNull() | F.col("test_mean").isNull(), F.concat(F.lit("no task or no "), none("metric"), F.lit(" in "), F.col("file"))))
    by_task = raw.groupBy("task").agg(F.count("*").alias("n"), F.min("file").alias("a"), F.max("file").alias("b"), F.min(F.struct(none("ckpt").alias("c"), "file")).alias("low"), F.max(F.struct(none("ckpt").alias("c"), "file")).alias("high"))
    facts = by_task.agg(F.count("*").alias("tasks"), F.max(F.struct("n", "task", "a", "b")).alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    two = lambda a, b: F.concat(F.lit(" in "), a, F.lit(" and "), b)
    problem = (
        F.when(F.col("most.n") > 1, F.concat(F.lit("task "), none("most.task"), two(F.col("most.a"), F.col("most.b"))))
        .when(F.col("low.c") != F.col("high.c"), F.concat(F.lit("two checkpoints, "), F.col("low.c"), F.lit(" and "), F.col("high.c"), two(F.col("low.file"), F.col("high.file"))))
        .when(F.col("tasks") != expected, F.concat(F.lit(f"expected {expected} tasks, found "), F.col("tasks").cast("string")))
    )
    return _beside(rows, _hold(facts, problem)).drop("file")


def _beside(rows: DataFrame, fact: DataFrame) -> DataFrame:
    """rows, joined to a fact of one row, which is thereby computed."""
    return rows.crossJoin(fact.select(F.col("tasks").alias("__tasks"))).where("__tasks is not null").drop("__tasks")


def write_results(df: DataFrame, path: str) -> None:
    """One JSON file for each row (its columns those of RESULT), in a folder named by the task; fails if path exists."""
    own = df.withColumn("of", F.col("task"))
    own.repartition("of").write.mode("errorifexists").partitionBy("of").json(path)
