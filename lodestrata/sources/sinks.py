"""Writers. Spark's commit protocol makes each of them whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch_path


def with_position(df: DataFrame, *order: Column | str, name: str = "row_index") -> DataFrame:
    """A dense 0-based row id in the given order, without putting all rows in one task.

    Rows are range-partitioned, sorted and written once to the shared folder, so that sizes and rows come from the same
    partitions. A row's id is its place in its partition plus the rows of all before; a partition without a size fails.
    """
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__id", F.monotonically_increasing_id())
    path = scratch_path(spark, "positions")
    dealt.write.parquet(path)
    fixed = spark.read.schema(dealt.schema).parquet(path)
    fixed = fixed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__in", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = fixed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")  # a row for each partition
    joined = fixed.join(sizes.select("__part", before.alias("__before")), "__part", "left")
    found = F.assert_true(F.col("__before").isNotNull(), F.lit("a partition has no size"))
    return joined.withColumn(name, F.when(found.isNull(), F.col("__before") + F.col("__in"))).drop("__id", "__part", "__in", "__before")


def assign_shards(df: DataFrame, *order, val_size: int, shard_size: int, limit: int | None = None) -> DataFrame:
    """split (`val` for the first val_size rows, else `train`) and shard number of every row in order."""
    own = with_position(df, *order)
    if limit is not None:
        own = own.where(F.col("row_index") < limit)
    train = F.col("row_index") >= val_size
    return own.withColumn("split", F.when(train, "train").otherwise("val")).withColumn("shard", F.when(train, F.floor((F.col("row_index") - val_size) / shard_size)))


def write_shards(df: DataFrame, path: str, shard_size: int) -> None:
    """Parquet by split, at most shard_size rows a file; fails if path exists."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", shard_size).partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("errorifexists").options(header=True, compression="gzip" if gzip else "none").csv(path)


def write_conll(df: DataFrame, path: str, doc: str, sentence: str, place: str, fields: list[str]) -> None:
    """Blocks of lines: `-DOCSTART-` before each document, a line of fields with spaces between for each token, a blank line after
    each sentence. Documents are dealt over files, a whole one to each; within them tokens are in order of sentence and place.
    Fails if path exists."""
    cols = [F.col(doc).alias("doc"), F.col(sentence).cast("long").alias("sentence"), F.col(place).cast("long").alias("place")]
    tokens = df.select(*cols, F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]).alias("value"))
    last = F.lit((1 << 63) - 1).alias("place")
    ends = tokens.select("doc", "sentence", last, F.lit("").alias("value")).distinct()
    starts = tokens.select("doc", F.lit(-(1 << 63)).alias("sentence"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit("-DOCSTART- -X- O").alias("value")), F.struct(F.lit(1).cast("long").alias("place"), F.lit("").alias("value")))).alias("x")).select("doc", "sentence", "x.*").distinct()
    lines = tokens.unionByName(ends).unionByName(starts).repartition("doc").sortWithinPartitions("doc", "sentence", "place")
    lines.select("value").write.mode("errorifexists").option("lineSep", "\n").text(path)


def write_once(df: DataFrame, path: str, key: str | None = None, by: list[str] | None = None) -> str:
    """Write df (in folders by the columns `by`) unless path holds other content: the digests of the rows, or only of one key
    column, must agree. Returns the digest."""
    from ..operators.digests import table_digest

    spark, columns = df.sparkSession, [key] if key else sorted(df.columns)
    own = table_digest(df.select(*columns)).first()[0]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        if table_digest(spark.read.schema(df.schema).parquet(path).select(*columns)).first()[0] != own:
            raise RuntimeError(f"{path} holds other rows; it is not overwritten")
    else:
        df.write.partitionBy(*(by or [])).parquet(path)
    return own


def store_splits(df: DataFrame, path: str, key: str, split: str) -> DataFrame:
    """Keep a split for good: `rows` by split and, beside them, the manifest (split, n_rows, digest), which is returned.

    A key in two splits fails before anything is written; a second call with the same rows changes nothing; other rows are
    refused. Digests do not depend on the order of rows and are summed before the shuffle.
    """
    from ..operators.digests import group_digests

    spark = df.sparkSession
    twice = df.select(key, split).distinct().groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} is in more than one split")
    write_once(df, f"{path}/rows", by=[split])
    manifest = group_digests(df, [split])
    write_once(manifest, f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A small result as a table: null as NA, integers with thousands separators, floats to six figures."""

    def cell(x) -> str:
        return "NA" if x is None else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", r"\|")

    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
