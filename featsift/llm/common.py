"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featsift.session import scratch_path

# Stands for a null doc_id inside an operator, so that keys compare and join; it
# sorts after every other id and is turned back to null in results.
NULL_ID = 2**63 - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def body(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def real_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def given_id(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared checkpoint folder and
    read back: lineage is cut and a lost executor costs only a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def complete_groups(
    batches: Iterator[pa.RecordBatch], key: str, limit: int, block: int = 200_000,
    block_bytes: int = 2**62, limit_bytes: int = 2**62,
) -> Iterator[tuple[bool, pa.Table]]:
    """Cut a stream of rows sorted by ``key`` into tables of whole groups.

    Yields ``(True, table)`` with complete groups, ``(False, table)`` with rows of
    a group that has more than ``limit`` rows or ``limit_bytes``; a table is cut at
    ``block`` rows or ``block_bytes``.  A group over a limit is never held in
    memory as a whole, its rows pass through for another way of handling.
    """
    held: list[pa.Table] = []
    n_held, bytes_held, passing = 0, 0, None

    def flush(table: pa.Table, last: bool):
        nonlocal passing
        while table.num_rows:
            keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
            if passing is not None:
                n = int(np.argmax(keys != passing)) if (keys != passing).any() else len(keys)
                if n:
                    yield False, table.slice(0, n)
                    table = table.slice(n)
                if n == len(keys):
                    return
                passing = None
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            over = ends - starts > limit
            if table.nbytes > limit_bytes:
                over |= np.array([hi - lo > 1 and table.slice(lo, hi - lo).nbytes > limit_bytes for lo, hi in zip(starts.tolist(), ends.tolist())])
            big = np.flatnonzero(over)
            if len(big):
                s = int(starts[big[0]])
                if s:
                    yield True, table.slice(0, s)
                passing = keys[s]
                table = table.slice(s)
                continue
            cut = len(keys) if last else int(starts[-1])
            if cut:
                yield True, table.slice(0, cut)
            if cut < len(keys):
                held.append(table.slice(cut))
            return

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n_held += batch.num_rows
        bytes_held += batch.nbytes
        if n_held >= block or bytes_held >= block_bytes:
            table = pa.concat_tables(held)
            held.clear()
            yield from flush(table, False)
            n_held, bytes_held = sum(t.num_rows for t in held), sum(t.nbytes for t in held)
    if held:
        table = pa.concat_tables(held)
        held.clear()
        yield from flush(table, True)


def block_pairs(rows: DataFrame, key: str, item: str, block: int, weight: str | None = None, room: int = 1) -> DataFrame:
    """Deal the rows of very large groups to pairs of blocks.

    A group of n rows becomes ceil(n / block) blocks (by hash of ``item``); every
    pair of blocks is one new group ``pair``, so any two rows meet in some group,
    no group has many more than 2 * block rows, and the groups run in parallel.  With
    ``weight`` a block also has about ``room`` of it at most.
    """
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block))
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / F.lit(room)))
    sizes = rows.groupBy(key).agg(blocks.cast("int").alias("__nb"))
    dealt = rows.join(sizes, key)
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64(item), F.col("__nb")).cast("int"))
    other = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    pair = F.xxhash64(F.col(key), F.least("__b", "__o"), F.greatest("__b", "__o"))
    return other.withColumn("pair", pair).drop("__nb", "__b", "__o")


def behind_index(index: DataFrame, probes: DataFrame, salts: int, item: Column, hot: DataFrame | None = None) -> DataFrame:
    """The rows of ``probes(shard, ...)``, sorted behind the row of ``index(shard, ...)``
    of their shard, for ``probed``.  A shard's probes are dealt to ``salts`` groups by
    the hash ``item`` (or as many as the small table ``hot(shard, salts)`` says); its
    index row goes to each."""
    names, wanted = index.columns, probes.columns
    if hot is None:
        index, probes = (df.withColumn("salts", F.lit(salts)) for df in (index, probes))
    else:
        index, probes = (
            df.join(F.broadcast(hot), "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(salts))) for df in (index, probes)
        )
    salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    rows = index.select(*names, salt.alias("salt"), F.lit(False).alias("probe"))
    dealt = probes.select(*wanted, F.pmod(item, F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("probe"))
    both = rows.unionByName(dealt, allowMissingColumns=True)
    return both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "probe")


def probed(batches: Iterator[pa.RecordBatch], ready: Callable[[dict], object]) -> Iterator[tuple[object, pa.RecordBatch]]:
    """``(ready(index row), probes)`` from a stream made by ``behind_index``: never more
    than one index row and one batch are held.  Probes of a shard without index are left out."""
    held, mine = None, None
    for batch in batches:
        shard, probe = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "probe"))
        starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | ~probe[1:]]) if len(shard) else []
        for lo, hi in zip(starts, np.r_[starts[1:], len(shard)].astype(int)):
            if not probe[lo]:
                if mine != shard[lo]:
                    held, mine = ready(batch.slice(lo, 1).to_pylist()[0]), shard[lo]
                lo += 1
            if lo < hi and mine == shard[lo]:
                yield held, batch.slice(lo, hi - lo)


def neighbours(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows that follow each other with equal ``keys``."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        at = list(zip(*columns))
        starts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
        for lo, hi in zip(starts, starts[1:]):
            if held and at[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = at[lo]
    if held:
        yield pa.Table.from_batches(held)
