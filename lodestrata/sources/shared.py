"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset on a local master (tests) a folder of our own; else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table of this run; it is deleted when the process ends."""
    path = f"{shared_folder(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _drop_down_to(kept: int) -> None:
    while len(_scratch) > kept:
        spark, path = _scratch.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return


@contextmanager
def scratch_scope() -> Iterator[None]:
    """The tables that operators write within are deleted at its end, so results must be stored or collected before. Scopes nest."""
    kept = len(_scratch)
    try:
        yield
    finally:
        _drop_down_to(kept)


def drop_scratch() -> None:
    """Delete the tables of all operators of this process; also called at its end."""
    _drop_down_to(0)


atexit.register(drop_scratch)
