"""Session helpers: building a local session for tests/bench, and resolving the
shared checkpoint folder from the session configuration."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINT_FALLBACK: dict[int, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "featsift") -> SparkSession:
    """A local session for tests and the bench.  Cluster jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FEATSIFT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system path); a machine-local
    temporary folder is used only for ``local[...]`` masters, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder (HDFS/S3/...) "
            "so that lineage can be cut safely on a cluster"
        )
    key = id(sc)
    if key not in _LOCAL_CHECKPOINT_FALLBACK:
        _LOCAL_CHECKPOINT_FALLBACK[key] = tempfile.mkdtemp(prefix="featsift-ckpt-")
    sc.setCheckpointDir(_LOCAL_CHECKPOINT_FALLBACK[key])
    return sc.getCheckpointDir() or _LOCAL_CHECKPOINT_FALLBACK[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediates."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/featsift-{name}-{uuid.uuid4().hex[:12]}"


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as it ends; else they stay until the driver
    happens to collect its garbage.  Only for queries that are run to their end at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate, wherever Spark's own file access finds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file access finds the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))
