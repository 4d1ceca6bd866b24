"""Dense matrices in NumPy's file format, as a data source: row blocks are partitions.

`npy_matrix` reads one .npy file, or a folder of them with a manifest `matrix.json`, and writes such a folder. Shape and type are
checked when the scan is planned, before any task. Rows are (row, values); values are doubles.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "row bigint, values array<double>"
MANIFEST = "matrix.json"
#: Bytes of a partition of a scan, and of a block file; bytes that a reading task makes rows of at once.
BLOCK_BYTES = 64 << 20
STEP_BYTES = 4 << 20


def store_of(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def read_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and the place of the first value of an open .npy file. Python objects and column order are refused."""
    version = np.lib.format.read_magic(f)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"unknown version {version}")
    shape, by_column, dtype = read(f)
    if by_column and len(shape) > 1 and min(shape) > 1:
        raise ValueError("values are in column order")
    return shape, dtype, f.tell()


def checked(shape: tuple[int, ...], dtype: np.dtype, file: str) -> None:
    if len(shape) != 2:
        raise ValueError(f"{file}: a matrix has two dimensions, this has shape {shape}")
    if not all(shape):
        raise ValueError(f"{file}: no dimension may be 0, shape is {shape}")
    if dtype.kind not in "biuf":
        raise ValueError(f"{file}: values must be bool, integer or floating point, not {dtype}")


@dataclass
class Block(InputPartition):
    file: str
    at: int
    row: int
    rows: int
    columns: int
    dtype: str


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes = options["path"].rstrip("/"), int(options.get("blockBytes", BLOCK_BYTES))

    def partitions(self) -> list[Block]:
        store, path = store_of(self.path)
        files, want = [(path, 0, None)], None
        if store.get_file_info(path).type.name == "Directory":
            with store.open_input_stream(posixpath.join(path, MANIFEST)) as f:
                want = json.loads(f.read())
            files = [(posixpath.join(path, b["file"]), b["row"], b["rows"]) for b in sorted(want["blocks"], key=lambda b: b["row"])]
        out, row, kind = [], 0, None
        for file, first, rows in files:
            with store.open_input_file(file) as f:
                try:
                    shape, dtype, at = read_header(f)
                except ValueError as e:
                    raise ValueError(f"{file}: not a readable matrix: {e}") from e
                checked(shape, dtype, file)
                if f.size() != at + shape[0] * shape[1] * dtype.itemsize:
                    raise ValueError(f"{file}: {f.size()} bytes do not hold {shape} values of {dtype}")
            if first != row or rows not in (None, shape[0]) or kind not in (None, (shape[1], dtype)):
                raise ValueError(f"{file}: block of shape {shape}, {dtype} does not go on where the one before ends")
            kind, row = (shape[1], dtype), row + shape[0]
            step = max(1, self.bytes // (shape[1] * dtype.itemsize))
            for a in range(0, shape[0], step):
                out.append(Block(file, at + a * shape[1] * dtype.itemsize, first + a, min(step, shape[0] - a), shape[1], dtype.str))
        if want and [row, kind[0]] != want["shape"]:
            raise ValueError(f"{self.path}: the blocks hold {row} rows of {kind[0]}, the manifest says {want['shape']}")
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        store, file = store_of(partition.file)
        width = np.dtype(partition.dtype).itemsize * partition.columns
        step = max(1, STEP_BYTES // (8 * partition.columns))
        with store.open_input_file(file) as f:
            f.seek(partition.at)
            for a in range(0, partition.rows, step):
                n = min(step, partition.rows - a)
                values = np.frombuffer(f.read(n * width), partition.dtype).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, partition.columns, dtype=np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.row + a), lists], names=["row", "values"])


@dataclass
class Written(WriterCommitMessage):
    blocks: list[tuple[str, int, int]]
    columns: int


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.dtype = options["path"].rstrip("/"), np.dtype(options.get("dtype", "float32"))
        store, path = store_of(self.path)
        if store.get_file_info(posixpath.join(path, MANIFEST)).type.name != "NotFound":
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a task, consecutive and in order, as block files of bounded size under names of their own."""
        store, path = store_of(self.path)
        store.create_dir(path, recursive=True)
        blocks, held, size, columns, after = [], [], 0, 0, None

        def put():
            nonlocal held, size
            values = np.concatenate(held)
            name = f"block-{after - len(values):012d}-{uuid.uuid4().hex}.npy"
            with store.open_output_stream(posixpath.join(path, name)) as f:
                np.lib.format.write_array(f, values, allow_pickle=False)
            blocks.append((name, after - len(values), len(values)))
            held, size = [], 0

        for batch in iterator:
            if not batch.num_rows:
                continue
            rows = np.asarray(batch.column("row"))
            first = rows[0] if after is None else after
            if (rows != first + np.arange(len(rows))).any():
                raise ValueError(f"rows of a task must follow each other; after row {first - 1} comes {rows[:3].tolist()}")
            lists = batch.column("values")
            sizes = np.unique(np.diff(np.asarray(lists.offsets)))
            if len(sizes) != 1 or columns not in (0, sizes[0]) or not sizes[0] or lists.null_count:
                raise ValueError("all rows of a matrix have as many values, at least one")
            columns = int(sizes[0])
            wide = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan")))
            with np.errstate(over="ignore"):
                values = wide.astype(self.dtype) if self.dtype.kind == "f" else self.integers(wide)
            if self.dtype.kind == "f" and (np.isinf(values) & ~np.isinf(wide)).any():
                raise ValueError(f"a value is too large for {self.dtype}")
            held.append(values.reshape(-1, columns))
            after, size = int(rows[-1]) + 1, size + held[-1].nbytes
            if size >= BLOCK_BYTES:
                put()
        if held:
            put()
        return Written(blocks, columns)

    def integers(self, wide: np.ndarray) -> np.ndarray:
        values = wide.astype(self.dtype)
        if not np.array_equal(values.astype(np.float64), wide):
            raise ValueError(f"a value is missing or does not fit {self.dtype}")
        return values

    def commit(self, messages: list[Written]) -> None:
        """The manifest comes last, so the matrix is whole or absent; it names what the tasks that counted have written."""
        blocks = sorted((b for m in messages if m for b in m.blocks), key=lambda b: b[1])
        columns = {m.columns for m in messages if m and m.blocks}
        ends = [0, *(row + n for _, row, n in blocks)]
        if not blocks or len(columns) != 1 or any(b[1] != e for b, e in zip(blocks, ends)):
            self.abort(messages)
            raise ValueError("rows must be numbered from 0 without gaps, and all have as many values")
        store, path = store_of(self.path)
        made = {"shape": [ends[-1], columns.pop()], "dtype": self.dtype.str, "blocks": [{"file": f, "row": r, "rows": n} for f, r, n in blocks]}
        with store.open_output_stream(posixpath.join(path, MANIFEST)) as f:
            f.write(json.dumps(made).encode())

    def abort(self, messages: list[Written]) -> None:
        store, path = store_of(self.path)
        for m in messages:
            for file, _, _ in m.blocks if m else []:
                store.delete_file(posixpath.join(path, file))


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options)


def write_matrix(df: DataFrame, path: str, row: str = "row", values: str = "values", dtype: str = "float32") -> None:
    """df's arrays in order of its dense row number (from 0) as a matrix folder. Nulls become NaN; a value that the type cannot
    hold, arrays of other lengths and gaps fail the write. Rows are range-partitioned, so each task writes one stretch."""
    df.sparkSession.dataSource.register(MatrixSource)
    from pyspark.sql import functions as F

    own = df.select(F.col(row).cast("long").alias("row"), F.col(values).cast("array<double>").alias("values"))
    own.repartitionByRange("row").sortWithinPartitions("row").write.format("npy_matrix").option("dtype", dtype).mode("append").save(path)


def read_matrix(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row and values of a matrix file or folder, a partition for each `block_bytes` of a file."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy_matrix").option("blockBytes", block_bytes).load(path)
