"""Files that other programs read: small reports, aligned label exports, pinned downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch_path
from .tables import file_digests


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with the keys of every object in order, whole or absent; fails if path exists."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_text(df: DataFrame, column: str, path: str, parts: int | None = None) -> None:
    """One line a row, LF line ends, whole or absent; `parts` sets the number of files for small reports."""
    own = df.select(F.col(column).cast("string").alias("value"))
    (own if parts is None else own.coalesce(parts)).write.mode("errorifexists").option("lineSep", "\n").text(path)


def write_aligned(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """A sparse label table as three aligned outputs under path: `ids` (row, key), `labels` (row, column, label; known ones
    only, so missing ones take no room) and `columns` (column, name). df must hold a dense `row` number."""
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "column int, name string")
    df.select("row", key).write.mode("errorifexists").parquet(f"{path}/ids")
    long = df.select("row", F.posexplode(F.array(*[F.col(c).cast("float") for c in columns])).alias("column", "label")).where("label is not null")
    long.write.mode("errorifexists").parquet(f"{path}/labels")
    names.write.mode("errorifexists").parquet(f"{path}/columns")


def read_aligned(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, name and label of every known label of an aligned export."""
    ids, labels, names = (spark.read.parquet(f"{path}/{part}") for part in ("ids", "labels", "columns"))
    return labels.join(ids, "row").join(names, "column").select(key, "name", "label")


def pinned(spark: SparkSession, path: str, sha256: dict[str, str], pattern: str = "*") -> DataFrame:
    """file, n_bytes, sha256 of the files under path; the plan fails at a file whose digest is not the pinned one."""
    want = spark.createDataFrame(sorted(sha256.items()), "file string, pinned string")
    rows = file_digests(spark, path, pattern).join(want, "file", "left")
    good = F.coalesce(F.col("sha256") == F.col("pinned"), F.lit(False))
    return rows.where(F.assert_true(good, F.concat(F.lit("digest is not the pinned one: "), "file")).isNull()).drop("pinned")


def single_file(df: DataFrame, path: str, kind: str) -> None:
    """A small table as one file of the given name: written beside it and renamed, so it is whole or absent; fails if path
    exists. For reports and hold-outs of stated size only, since one task writes it."""
    spark = df.sparkSession
    hidden = scratch_path(spark, "single")
    df.coalesce(1).write.format(kind).save(hidden)
    name = spark._jvm.org.apache.hadoop.fs.Path
    store = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in store.listStatus(name(hidden)) if f.getPath().getName().startswith("part-")]
    store.mkdirs(name(path).getParent())
    if store.exists(name(path)) or len(parts) != 1 or not store.rename(parts[0], name(path)):
        raise FileExistsError(path)
