"""Structured Streaming: file streams through the same column functions as batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 16, fmt: str = "parquet", schema=None) -> DataFrame:
    """A stream of a file or of the files of a folder, a bounded number at a time, so readers never run ahead of the consumer."""
    schema = schema or spark.read.format(fmt).load(path).schema
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        stream, path = stream.option("pathGlobFilter", where.getName()), str(where.getParent())
    return stream.load(path)


@contextmanager
def disk_state(spark: SparkSession, memory_mb: int = 256) -> Iterator[None]:
    """Streams started within keep their state in RocksDB: on disk, with changes logged in the checkpoint folder, and at most
    `memory_mb` of memory in an executor for all its streams, however many keys there are."""
    prefix = "spark.sql.streaming.stateStore."
    wanted = {
        f"{prefix}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{prefix}rocksdb.changelogCheckpointing.enabled": "true",
        f"{prefix}rocksdb.boundedMemoryUsage": "true",
        f"{prefix}rocksdb.maxMemoryUsageMB": str(memory_mb),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def encode_or_reason(df: DataFrame, text: str, encode: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with tokens, and rows left out with the reason (unparseable or too long): nothing is lost without a trace."""
    own = df.withColumn("tokens", encode(F.col(text)))
    reason = F.when(F.col(text).isNull() | F.col("tokens").isNull(), "unparseable").when(F.size("tokens") > most, "too long")
    return own.where(reason.isNull()), own.withColumn("reason", reason).where("reason is not null").drop("tokens")


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once. With a time and a delay, keys are forgotten when the watermark has passed them, so state stays bounded,
    but rows later than that are lost; without, whatever the order of the rows, all keys are kept in the state: start such a
    stream within `disk_state`, so that it grows on disk and not in memory."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """Count and sum by key and event-time window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = stream.withWatermark(time, delay).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("start"), key, "n", "total")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is and stop; started again with the same checkpoint it goes on where it was, each file once."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand each micro-batch with its number to write, which must be idempotent by that number."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def dealt(df: DataFrame, shards: int, *keys: str) -> DataFrame:
    """Rows dealt over shards by key; the engine's tasks replace worker and rank numbers."""
    return df.repartition(shards, *keys)


def sniffed(columns: list[str], has: str, without: str) -> str:
    """The first column whose name holds `has` but not `without`, in any case."""
    for c in columns:
        if has.lower() in c.lower() and without.lower() not in c.lower():
            return c
    raise ValueError(f"no column holds {has!r} without {without!r}: {columns}")


def own_shard(df: DataFrame, number: Column, workers: int, world: int, rank: int, worker: int) -> DataFrame:
    """The rows of one worker of one rank when rows are dealt by number; for tests, since Spark deals its own tasks."""
    return df.where(F.pmod(number, F.lit(workers * world)) == rank * workers + worker)


def merged(parts: list[DataFrame], position: str, most: int) -> DataFrame:
    """Partial results of all ranks in order of position, cut to `most` rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(position).limit(most)
