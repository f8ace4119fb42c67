"""S3 on shared storage: NumPy arrays read through Spark's own file access.

A ``.npy`` matrix is dealt in byte ranges by Hadoop's fixed-length input: its record is
the largest size that divides both the header and a row, so ranges begin at whole cells
and each record knows its place in the file.  One range is one task; consecutive records
are taken together.  A member of a ``.npz`` is compressed and has no places to enter it:
its file (up to 2 GB) is read by one task, which inflates the member once, in blocks.
Any path that Spark reads works; nothing is unpickled, and values that are not finite
are refused as in ``archive``.
"""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIXED = "org.apache.spark.input.FixedLengthBinaryInputFormat"
_SPLIT = "mapreduce.input.fileinputformat.split.maxsize"
_TOGETHER = 1 << 20  # bytes of records handed on at once
_CELLS = "row_id long, feature_id long, value double"


def _records(spark: SparkSession, path: str, size: int, split_bytes: int | None = None):
    """(number, bytes) of the file's records of ``size`` bytes."""
    conf = {f"{_FIXED}.recordLength": str(size)} | ({_SPLIT: str(split_bytes)} if split_bytes else {})
    return spark.sparkContext.newAPIHadoopFile(path, _FIXED, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)


def _parsed(stream) -> tuple[tuple, np.dtype, int]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if dtype.hasobject:
        raise ValueError("object arrays need pickle: store them with a fixed-width dtype")
    if len(shape) not in (1, 2) or fortran:
        raise ValueError("expected a C-ordered 1-D or 2-D array")
    return shape, dtype, stream.tell()


def npy_header(spark: SparkSession, path: str) -> tuple[tuple, np.dtype, int]:
    """(shape, dtype, where the cells begin) of a ``.npy`` file."""
    head = lambda n: bytes(b"".join(bytes(x) for _, x in _records(spark, path, 1).take(n)))
    first = head(12)
    size = 10 + int.from_bytes(first[8:10], "little") if first[6] == 1 else 12 + int.from_bytes(first[8:12], "little")
    return _parsed(io.BytesIO(head(size)))


def _batch(values: np.ndarray, at: int, width: int) -> pa.RecordBatch:
    """The non-zero cells of ``values``, the first of which is cell ``at`` of the matrix."""
    values = values.astype(np.float64)
    if not np.isfinite(values).all():
        bad = at + int(np.flatnonzero(~np.isfinite(values))[0])
        raise ValueError(f"non-finite value at row {bad // width}, column {bad % width}")
    cells = np.flatnonzero(values)
    place = cells + at
    return pa.RecordBatch.from_arrays([pa.array(place // width), pa.array(place % width), pa.array(values[cells])], names=["row_id", "feature_id", "value"])


def read_npy(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """The long matrix of a ``.npy`` file, zeros left out; ``split_bytes`` bounds a range."""
    shape, dtype, offset = npy_header(spark, path)
    width = shape[1] if len(shape) == 2 else 1
    if not shape[0] * width:
        return spark.createDataFrame([], _CELLS)
    size, item = math.gcd(offset, width * dtype.itemsize), dtype.itemsize

    def together(records: Iterator[tuple[int, bytearray]]) -> Iterator[tuple[int, bytes]]:
        held, begin = bytearray(), 0
        for number, raw in records:
            if number * size < offset:
                continue
            if not held:
                begin = (number * size - offset) // item
            held += raw
            if len(held) >= _TOGETHER:
                yield begin, bytes(held)
                held = bytearray()
        if held:
            yield begin, bytes(held)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _batch(np.frombuffer(raw.as_py(), dtype=dtype), at, width)

    ranges = spark.createDataFrame(_records(spark, path, size, split_bytes).mapPartitions(together), "at long, raw binary")
    return ranges.mapInArrow(cells, _CELLS)


def _member(content: bytes, path: str, member: str | None):
    if not path.endswith(".npz"):
        return io.BytesIO(content)
    return zipfile.ZipFile(io.BytesIO(content)).open(member if member.endswith(".npy") else f"{member}.npy")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_npz(spark: SparkSession, path: str, member: str) -> DataFrame:
    """The long matrix of a member of a ``.npz`` file, inflated once by one task."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with _member(content.as_py(), name, member) as stream:
                    shape, dtype, _ = _parsed(stream)
                    width, at = shape[1] if len(shape) == 2 else 1, 0
                    while raw := stream.read(max(1, _TOGETHER // dtype.itemsize) * dtype.itemsize):
                        yield _batch(np.frombuffer(raw, dtype=dtype), at, width)
                        at += len(raw) // dtype.itemsize

    return _files(spark, path).mapInArrow(cells, _CELLS)


def read_vector(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """``(position, value string)`` of a 1-D array of numbers or fixed-width strings."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with _member(content.as_py(), name, member) as stream:
                    _, dtype, _ = _parsed(stream)
                    at = 0
                    while raw := stream.read(max(1, _TOGETHER // dtype.itemsize) * dtype.itemsize):
                        found = np.frombuffer(raw, dtype=dtype).tolist()
                        text = [x.decode() if isinstance(x, bytes) else str(x) for x in found]
                        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(text)), pa.int64()), pa.array(text, pa.string())], names=["position", "value"])
                        at += len(text)

    return _files(spark, path).mapInArrow(values, "position long, value string")


def ingest(spark: SparkSession, path: str, out: str, matrix: str = "X_train", labels: str | None = "y_train", ids: str | None = "ids") -> None:
    """An archive as the Parquet store that ``archive.read_matrix`` reads."""
    entries = read_npz(spark, path, matrix) if path.endswith(".npz") else read_npy(spark, path)
    entries.repartitionByRange("feature_id").sortWithinPartitions("feature_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/entries")
    rows = None
    for member, name in ((ids, "id"), (labels, "label")):
        if member and path.endswith(".npz"):
            value = F.col("value").cast("double").cast("int") if name == "label" else F.col("value")
            found = read_vector(spark, path, member).select(F.col("position").alias("row_id"), value.alias(name))
            rows = found if rows is None else rows.join(found, "row_id")
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{out}/rows")
