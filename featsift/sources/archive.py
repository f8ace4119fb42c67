"""S3: ingest NumPy array archives (``.npy`` or members of ``.npz``) as the
long matrix ``(row_id, feature_id, value)``, zeros dropped.

A Python ``DataSource``: the driver reads only the array header (shape, dtype,
order) and plans one ``InputPartition`` per block of rows; each task seeks to
its rows and emits Arrow batches.  Nothing is ever unpickled: object arrays
(which need pickle) are rejected, so string ids must be stored with a
fixed-width dtype.

    spark.dataSource.register(NpyMatrixSource)
    spark.read.format("npy_matrix").option("path", "x.npz").option("member", "X_train").load()
"""

from __future__ import annotations

import zipfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


@dataclass
class _Header:
    shape: tuple
    dtype: np.dtype
    fortran: bool
    offset: int


def _open(path: str, member: str | None):
    if path.endswith(".npz"):
        zf = zipfile.ZipFile(path)
        name = member if member.endswith(".npy") else member + ".npy"
        return zf, zf.open(name)
    return None, open(path, "rb")


def _header(path: str, member: str | None) -> _Header:
    zf, fh = _open(path, member)
    try:
        version = np.lib.format.read_magic(fh)
        if version == (1, 0):
            shape, fortran, dtype = np.lib.format.read_array_header_1_0(fh)
        else:
            shape, fortran, dtype = np.lib.format.read_array_header_2_0(fh)
        if dtype.hasobject:
            raise ValueError("object arrays need pickle: store them with a fixed-width dtype")
        return _Header(tuple(shape), dtype, fortran, fh.tell())
    finally:
        fh.close()
        if zf is not None:
            zf.close()


class _RowBlock(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.member = options.get("member")
        self.rows_per_partition = int(options.get("rows_per_partition", "256"))
        self.h = _header(self.path, self.member)
        if len(self.h.shape) not in (1, 2) or self.h.fortran:
            raise ValueError("expected a C-ordered 1-D or 2-D array")

    def partitions(self):
        n = self.h.shape[0]
        step = max(1, self.rows_per_partition)
        return [_RowBlock(s, min(n, s + step)) for s in range(0, n, step)] or [_RowBlock(0, 0)]

    def read(self, partition: _RowBlock):
        import pyarrow as pa

        d = self.h.shape[1] if len(self.h.shape) == 2 else 1
        item = self.h.dtype.itemsize
        zf, fh = _open(self.path, self.member)
        try:
            fh.seek(self.h.offset + partition.start * d * item)
            # Bounded batches: a few rows at a time.
            batch_rows = max(1, 1_000_000 // max(d, 1))
            for s in range(partition.start, partition.end, batch_rows):
                e = min(partition.end, s + batch_rows)
                raw = fh.read((e - s) * d * item)
                block = np.frombuffer(raw, dtype=self.h.dtype).astype(np.float64).reshape(e - s, d)
                if not np.isfinite(block).all():
                    # Contract: NaN / inf are rejected at ingest (statistics would
                    # otherwise drop or keep such columns by accident).
                    bad = np.argwhere(~np.isfinite(block))[0]
                    raise ValueError(f"non-finite value at row {s + bad[0]}, column {bad[1]}")
                r, c = np.nonzero(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r + s, pa.int64()), pa.array(c, pa.int64()), pa.array(block[r, c], pa.float64())],
                    names=["row_id", "feature_id", "value"],
                )
        finally:
            fh.close()
            if zf is not None:
                zf.close()


class NpyMatrixSource(DataSource):
    """Long-form reader of a 2-D numeric array (zeros omitted)."""

    @classmethod
    def name(cls):
        return "npy_matrix"

    def schema(self):
        return StructType([
            StructField("row_id", LongType(), False),
            StructField("feature_id", LongType(), False),
            StructField("value", DoubleType(), False),
        ])

    def reader(self, schema):
        return _MatrixReader(self.options)


class _VectorReader(_MatrixReader):
    def read(self, partition: _RowBlock):
        import pyarrow as pa

        zf, fh = _open(self.path, self.member)
        item = self.h.dtype.itemsize
        try:
            fh.seek(self.h.offset + partition.start * item)
            raw = fh.read((partition.end - partition.start) * item)
            arr = np.frombuffer(raw, dtype=self.h.dtype)
            pos = np.arange(partition.start, partition.end, dtype=np.int64)
            if arr.dtype.kind in "US":
                vals = pa.array([str(x) if arr.dtype.kind == "U" else x.decode() for x in arr], pa.string())
            else:  # integers stay whole numbers
                vals = pa.array([str(x) for x in arr.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), vals], names=["position", "value"])
        finally:
            fh.close()
            if zf is not None:
                zf.close()


class NpyVectorSource(NpyMatrixSource):
    """1-D arrays (labels, ids) as ``(position, value STRING)``; cast as needed."""

    @classmethod
    def name(cls):
        return "npy_vector"

    def schema(self):
        return StructType([StructField("position", LongType(), False), StructField("value", StringType(), True)])

    def reader(self, schema):
        return _VectorReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(NpyMatrixSource)
    spark.dataSource.register(NpyVectorSource)


def ingest_archive(spark, path: str, matrix: str = "X_train", labels: str | None = "y_train",
                   ids: str | None = "ids", out: str | None = None, rows_per_partition: int = 256):
    """Archive -> (entries, rows) DataFrames; with ``out``, written as Parquet
    (``entries`` sorted by feature_id within files for row-group pruning)."""
    from pyspark.sql import functions as F

    register(spark)
    entries = (
        spark.read.format("npy_matrix").option("path", path).option("member", matrix)
        .option("rows_per_partition", str(rows_per_partition)).load()
    )
    rows = None
    if ids or labels:
        base = None
        for member, col, cast in ((ids, "id", "string"), (labels, "label", "int")):
            if not member:
                continue
            v = spark.read.format("npy_vector").option("path", path).option("member", member).load()
            v = v.select("position", F.col("value").cast("double").cast(cast).alias(col) if cast == "int"
                         else F.col("value").alias(col))
            base = v if base is None else base.join(v, "position")
        rows = base.withColumnRenamed("position", "row_id")
    if out:
        entries.sortWithinPartitions("feature_id").write.mode("overwrite").option("compression", "zstd").parquet(
            f"{out}/entries"
        )
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{out}/rows")
    return entries, rows


def read_matrix(spark, path: str, label: str = "label"):
    """S1 over an ingested store: ``{path}/entries`` and ``{path}/rows`` Parquet
    as a WideMatrix.  Filters on ``feature_id`` (prefix cut, gather by range)
    reach the scan as pushed filters and prune row groups, since the entries
    are written sorted by ``feature_id`` within files."""
    from featsift.operators.matrix import WideMatrix

    entries = spark.read.parquet(f"{path}/entries")
    rows = spark.read.parquet(f"{path}/rows")
    return WideMatrix(entries=entries, rows=rows.select("row_id", *([label] if label in rows.columns else [])),
                      columns=None, label_col=label if label in rows.columns else None)
