"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer single text makes a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests) a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_written: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written() -> None:
    """Delete the tables of all finished operators of this process; also called at its end."""
    while _written:
        spark, path = _written.pop()
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


atexit.register(drop_written)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Where true, the shuffle files of a query go at its end; else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage, and survives the loss of executors.

    What the write shuffled is gone afterwards, so an operator of many steps takes the disk of its largest one.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete results of written() that nothing reads any more, not even a plan that has yet to run."""
    for t in tables:
        path = _paths.pop(t)
        delete_path(t.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


#: Bytes of a batch on its way to a Python worker; a single longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in whose session batches for Python workers are from now on bounded by bytes: texts may be very long, and both sides
    hold whole batches. A smaller bound that is set already stays."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = "".join(c for c in spark.conf.get(key, None) or "" if c.isdigit())
    if not now or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give the memory that numpy and Arrow keep for later back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a C library that has it
        pass


_tables: dict = {}


def worker_table(make):
    """make, whose last two results a worker keeps for its next tasks, until tasks of another kind begin there."""
    _tables[make.__name__] = lru_cache(2)(make)
    return _tables[make.__name__]


def drop_tables(but: str = "") -> None:
    for name, f in _tables.items():
        if name != but:
            f.cache_clear()


def lean(run, table: str = ""):
    """run, a function over batches, that leaves no spare memory behind in its worker. table: the worker table that it uses."""

    def wrapped(batches):
        drop_tables(table)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


class Remembered(dict):
    """A cache bounded by bytes: it starts anew when full, and what would take an eighth of it is not kept."""

    #: Bytes that an entry takes besides its content.
    ENTRY = 180

    def __init__(self, most: int):
        self.most, self.held = most, 0

    def keep(self, key, value, size: int):
        size += self.ENTRY
        if 8 * size <= self.most:
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self[key] = value
            self.held += size
        return value

    def keep_all(self, new: dict[bytes, bytes]) -> None:
        """keep for many at once."""
        size = sum(map(len, new)) + sum(map(len, new.values())) + self.ENTRY * len(new)
        if 8 * size > self.most:
            for key, value in new.items():
                self.keep(key, value, len(key) + len(value))
            return
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        self.update(new)
        self.held += size


def slices(batch: pa.RecordBatch, column: int, step: int = STEP_BYTES):
    """Cut a batch at about `step` bytes of a string column; yields record batches with at least one row."""
    if not batch.num_rows:
        return
    col = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    part = np.cumsum(size) // step
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(col: pa.Array) -> pa.Array:
    return col.cast(pa.int64())


def as_long(df: DataFrame, *names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]
