"""Second-order gradient boosting on the long sparse matrix, with leaf penalties.

Binary logistic loss, trees grown level by level.  A level's histograms are gradient and
hessian sums for each (node, feature, bin) over the stored cells.  Up to ``DRIVER_ROWS``
rows with ids of their own, cells are dealt by feature once: a task finds the best split of
each node among its features without a shuffle and tells which rows go right by it, and the
driver holds each row's margin and node.  Else every task sums its rows'
cells and deals the sums by feature, and the task of a feature finds its best split of
each node.  The trees are the same.  What the cells of a feature leave of a node's sums
belongs to its implicit zeros, which each split sends to the better side (a default
direction, as for missing values).  With G, H the sums of a side, L2 penalty
``reg_lambda`` and L1 penalty ``reg_alpha``:

* score(G, H) = soft(G, reg_alpha)^2 / (H + reg_lambda), soft shrinking |G| by the penalty;
* gain = score(left) + score(right) - score(both); a split needs more than nothing, at
  least ``gamma``, and a hessian of ``min_child_weight`` on both sides;
* leaf weight = -learning_rate * soft(G, reg_alpha) / (H + reg_lambda).

Equal gains (to eight decimals) go to the smaller feature, then the smaller bin, then
zeros to the right.  ``subsample`` draws rows and ``colsample_bytree`` columns by hash
for each tree.

Training is a loop that can be resumed: after each round the tree with its losses (with
cells dealt by row, the margins of train and valid rows before it) is written under ``path``;
a run finds what is there and goes on.  With ``patience`` it stops as soon as the loss on the valid rows has
not improved for so many rounds, so ``best + patience`` rounds are trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featsift.operators import sparse_boosting as SB
from featsift.operators.matrix import WideMatrix
from featsift.operators.ranking import sequence_by
from featsift.session import remove, scratch_path

LEAST_GAIN = 1e-6
TASK_CELLS = 1 << 20  # stored cells of a task's rows, about
DRIVER_ROWS = 1 << 23  # rows whose labels, margins and nodes the driver holds
MAX_DEPTH = 14  # a tree's 2^depth splits are literals of a plan

# Names of the reference's parameters and ours, where they differ.
_RENAMED = {"n_estimators": "rounds"}


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    max_bins: int = 64
    seed: int = 42

    def __post_init__(self):
        if not 1 <= self.max_depth <= MAX_DEPTH:
            raise ValueError(f"depth must lie between 1 and {MAX_DEPTH}")

    @classmethod
    def preset(cls, params: dict, **changes) -> "BoostParams":
        """From a preset of ``models.XGB_PRESETS``; its patience is ``fit``'s argument."""
        given = {_RENAMED.get(k, k): v for k, v in params.items() if k != "early_stopping_rounds"} | changes
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        return cls(**given)


@dataclass
class Tree:
    """Nodes by heap number (root 1, children 2n and 2n + 1): ``splits[n] = (feature
    number, bin, zeros go left)``, ``weights[n]`` of leaves."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    weights: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)

    def depth(self) -> int:
        return max((n.bit_length() for n in self.splits), default=0)


@dataclass
class Boosted:
    params: BoostParams
    trees: list[Tree]
    features: DataFrame  # feature_id, number, cuts
    curve: list[tuple[int, str, float]]
    best_rounds: int
    path: str


# ---------------------------------------------------------------- expressions


def _array(values, kind: str) -> str:
    return f"cast(array({', '.join(values)}) as array<{kind}>)"


def node_of(tree: Tree, depth: int | None = None) -> Column:
    """The node that a row with cells ``f`` (feature numbers) and ``b`` (bins) reaches."""
    depth = max(tree.depth() if depth is None else depth, 1)
    size = range(max([*tree.splits, 1]) + 1)
    split = [tree.splits.get(n, (-1, 0, False)) for n in size]
    feature, cut, left = (_array((str(s[i]).lower() for s in split), k) for i, k in enumerate(("int", "int", "boolean")))
    return F.expr(f"""aggregate(sequence(1, {depth}), 1, (n, i) -> CASE
        WHEN coalesce(get({feature}, n), -1) < 0 THEN n
        WHEN array_position(f, get({feature}, n)) = 0 THEN 2 * n + int(NOT get({left}, n))
        ELSE 2 * n + int(get(b, int(array_position(f, get({feature}, n))) - 1) > get({cut}, n)) END)""")


def weight_of(tree: Tree) -> Column:
    weights = _array((f"{tree.weights.get(n, 0.0)!r}D" for n in range(max(tree.weights) + 1)), "double")
    return F.get(F.expr(weights), node_of(tree))


def _drawn(key: Column, share: float, seed: int, round_: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(round_)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def _leaf_weight(g: float, h: float, p: BoostParams) -> float:
    return -p.learning_rate * (max(abs(g) - p.reg_alpha, 0.0) * (1 if g > 0 else -1)) / (h + p.reg_lambda) if h + p.reg_lambda else 0.0


# ---------------------------------------------------------------- data


def feature_cuts(entries: DataFrame, max_bins: int) -> DataFrame:
    """(feature_id, number, cuts): quantiles of each feature's stored values.  Bin k
    holds the values above cut k - 1 up to cut k."""
    shares = [(i + 1) / max_bins for i in range(max_bins)]
    cuts = entries.groupBy("feature_id").agg(
        F.array_sort(F.array_distinct(F.percentile_approx(F.col("value").cast("double"), shares, 10_000))).alias("cuts")
    )
    return sequence_by(cuts, ["feature_id"], "rn").select("feature_id", (F.col("rn") - 1).cast("int").alias("number"), "cuts")


def binned_rows(m: WideMatrix, features: DataFrame) -> DataFrame:
    """(row_id, f, b) for every row of the spine: its cells' feature numbers and bins.
    A row holds its own stored cells, as any vector of it would."""
    value = F.col("value").cast("double")
    cells = m.entries.select("row_id", "feature_id", value.alias("value")).where("value != 0").join(features, "feature_id").select(
        "row_id", F.struct(F.col("number").alias("f"), F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("b")).alias("cell")
    )
    rows = cells.groupBy("row_id").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    none = F.array().cast("array<int>")
    return m.rows.select("row_id").join(rows, "row_id", "left").select(
        "row_id", F.coalesce("cells.f", none).alias("f"), F.coalesce("cells.b", none).alias("b")
    )


# ---------------------------------------------------------------- one tree


def grow(cells: DataFrame, totals: tuple[float, float], p: BoostParams, round_: int = 0, parts: int = 8) -> Tree:
    """One tree over ``cells(g, h, f, b)`` of the drawn rows; ``totals``: sums of g and h;
    ``parts``: tasks that the features are dealt to."""
    tree, sums = Tree(), {1: totals}
    for depth in range(p.max_depth):
        first = 1 << depth
        here = [n for n in sums if n >= first]
        if not here:
            break
        found = _best_splits(cells, tree, depth, {n: sums[n] for n in here}, p, round_, parts).collect()  # one row a node
        for r in found:
            if -r.best.loss <= LEAST_GAIN or -r.best.loss < p.gamma:
                continue
            g, h = sums[r.node]
            tree.splits[r.node] = (r.best.feature, r.best.bin, r.best.zeros_left)
            tree.gains[r.node] = -r.best.loss
            sums[2 * r.node], sums[2 * r.node + 1] = (r.best.g, r.best.h), (g - r.best.g, h - r.best.h)
    tree.weights = {n: _leaf_weight(*s, p) for n, s in sums.items() if n not in tree.splits}
    return tree


def _nodes(tree: Tree, depth: int, f: np.ndarray, b: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """``node_of`` for ``n`` rows whose cells (feature, bin, row) lie one after another."""
    feature, cut, left = np.full(2 << depth, -1), np.zeros(2 << depth, dtype=np.int64), np.zeros(2 << depth, dtype=bool)
    for k, (j, bin_, zeros_left) in tree.splits.items():
        if k < len(feature):
            feature[k], cut[k], left[k] = j, bin_, zeros_left
    node = np.ones(n, dtype=np.int64)
    for _ in range(depth):
        hit = np.flatnonzero(feature[node][owner] == f)[::-1]
        right = ~left[node]
        right[owner[hit]] = b[hit] > cut[node[owner[hit]]]  # the first of equal features is set last
        node = np.where(feature[node] >= 0, 2 * node + right, node)
    return node


def _summed(keys: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], *(np.add.reduceat(x[order], starts) if len(keys) else x for x in (g, h))


_SUMS = "part int, keys binary, g binary, h binary"


def _histograms(batches: Iterator[pa.RecordBatch], tree: Tree, depth: int, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Sums of g and h for each (feature, node, bin) of a batch of rows, dealt by feature."""
    first = 1 << depth
    for batch in batches:
        f, b, g, h = (batch.column(batch.schema.get_field_index(c)) for c in "fbgh")
        sizes = np.asarray(f.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        f, b = f.flatten().to_numpy().astype(np.int64), b.flatten().to_numpy()
        node = _nodes(tree, depth, f, b, owner, len(sizes))
        used = node[owner] >= first
        at = batch.schema.get_field_index("drawn")
        if at >= 0:
            used &= batch.column(at).flatten().to_numpy(zero_copy_only=False)
        f, b, owner = f[used], b[used].astype(np.int64), owner[used]
        g, h = (pc.fill_null(x, 0.0).to_numpy()[owner] for x in (g, h))
        keys, g, h = _summed(((f << depth | (node[owner] - first)) << bits) | b, g, h)
        part = (keys >> (depth + bits)) % parts
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(part) else [0]
        dealt = [order[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(part[i[0]]) for i in dealt], pa.int32()), *(pa.array([x[i].tobytes() for i in dealt], pa.binary()) for x in (keys, g, h))],
            names=["part", "keys", "g", "h"],
        )


_SPLITS = "node int, loss double, feature int, bin int, zeros_left boolean, g double, h double"


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _chosen(batches: Iterator[pa.RecordBatch], sums: dict, depth: int, bits: int, p: BoostParams) -> Iterator[pa.RecordBatch]:
    """The best split of each node among the features of a task."""
    held = [[], [], []]
    for batch in batches:
        for got, column, kind in zip(held, ("keys", "g", "h"), (np.int64, np.float64, np.float64)):
            raw = batch.column(batch.schema.get_field_index(column))
            got += [np.frombuffer(x.as_buffer(), dtype=kind) for x in raw]
    if not held[0]:
        return
    tried = _tried(*_summed(*map(np.concatenate, held)), sums, depth, bits, p)
    if tried:
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*tried), kinds)], names=[x.split()[0] for x in _SPLITS.split(", ")])


def _tried(keys: np.ndarray, g: np.ndarray, h: np.ndarray, sums: dict, depth: int, bits: int, p: BoostParams) -> list[tuple]:
    """(node, loss, feature, bin, zeros go left, sums of the left) of the best split of each
    node, with the zeros on either side, by the sums of stored cells."""
    first, group = 1 << depth, keys >> bits
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for k in range(1, int(sizes.max(initial=0))):  # running sums over the bins of each (feature, node)
        at = starts[sizes > k] + k
        g[at] += g[at - 1]
        h[at] += h[at - 1]
    last = np.repeat(starts + sizes - 1, sizes)
    node = (group & (first - 1)).astype(np.int64)
    both = np.array([sums.get(n, (0.0, 0.0)) for n in range(first, 2 * first)])[node]
    zero_g, zero_h = both[:, 0] - g[last], both[:, 1] - h[last]
    soft = lambda v: np.sign(v) * np.maximum(np.abs(v) - p.reg_alpha, 0.0)
    score = lambda a, b: soft(a) * soft(a) / (b + p.reg_lambda)
    least, tried = max(p.min_child_weight, 1e-9), []
    for left, a, b in ((False, g, h), (True, g + zero_g, h + zero_h)):
        # Sums in another order differ in their last digits.
        fits = np.flatnonzero((_rounded(b, 9) >= least) & (_rounded(both[:, 1] - b, 9) >= least))
        a, b, all_g, all_h, of = a[fits], b[fits], both[fits, 0], both[fits, 1], node[fits]
        loss = -_rounded(score(a, b) + score(all_g - a, all_h - b) - score(all_g, all_h), 8)
        best = np.full(first, np.inf)
        np.minimum.at(best, of, loss)
        kept = np.flatnonzero(loss == best[of])
        kept = kept[np.unique(of[kept], return_index=True)[1]]  # keys ascend: the smallest feature and bin
        key = keys[fits[kept]]
        tried += zip((of[kept] + first).tolist(), loss[kept].tolist(), (key >> (depth + bits)).tolist(), (key & ((1 << bits) - 1)).tolist(),
                     [left] * len(kept), a[kept].tolist(), b[kept].tolist())
    return tried


def _best_splits(cells: DataFrame, tree: Tree, depth: int, sums: dict, p: BoostParams, round_: int, parts: int) -> DataFrame:
    bits = int(p.max_bins).bit_length()
    if p.colsample_bytree < 1:
        cells = cells.withColumn("drawn", F.transform("f", lambda j: _drawn(j, p.colsample_bytree, p.seed + 1, round_)))
    sent = cells.drop("row_id").mapInArrow(lambda it: _histograms(it, tree, depth, bits, 4 * parts), _SUMS)
    found = sent.repartition(parts, "part").mapInArrow(lambda it: _chosen(it, sums, depth, bits, p), _SPLITS)
    return found.groupBy("node").agg(F.min(F.struct("loss", "feature", "bin", "zeros_left", "g", "h")).alias("best"))


# ---------------------------------------------------------------- whole features in a task


def _hashed(keys: np.ndarray, *more: int | np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(key, *more)`` for ints, from ``xxhash64(key)``."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    x = keys.astype(np.int64).view(np.uint64)
    for k in more:
        x = x + five + np.uint64(4) ^ np.asarray(k, dtype=np.int64).astype(np.uint32).astype(np.uint64) * one
        x = (x << np.uint64(23) | x >> np.uint64(41)) * two + three
        x = (x ^ x >> np.uint64(33)) * two
        x = (x ^ x >> np.uint64(29)) * three
        x = x ^ x >> np.uint64(32)
    return x.view(np.int64)


def _kept(keys: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    """``_drawn`` for rows or columns whose ``xxhash64`` is known."""
    return _hashed(keys, seed, round_) % 1_000_000 < int(share * 1_000_000)


_BLOCKS = "block long, rows int, codes binary, ends binary, owner binary, state binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of a batch of rows sorted by (feature, bin), as in ``sparse_boosting``; with
    them label, margin and hash of each row."""
    part = SB.TaskContext.get().partitionId()
    for made, batch in enumerate(batches):
        f, b, y, margin, key = (batch.column(batch.schema.get_field_index(c)) for c in ("f", "b", "y", "margin", "key"))
        owner = np.repeat(np.arange(len(f), dtype=np.int32), f.value_lengths().to_numpy(zero_copy_only=False))
        code = f.flatten().to_numpy().astype(np.int64) << SB.BITS | b.flatten().to_numpy()
        order = np.argsort(code, kind="stable")
        codes, n = np.unique(code, return_counts=True)
        state = np.r_[y.to_numpy(zero_copy_only=False).astype(np.float64), margin.to_numpy(), key.to_numpy().view(np.float64)]
        packed = (x.tobytes() for x in (codes, np.cumsum(n), owner[order], state))
        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([len(f)], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)],
                                         names=[x.split()[0] for x in _BLOCKS.split(", ")])


@dataclass(frozen=True)
class _Level:
    """``spot``: the place of each row's node in ``nodes``, or -1; ``used``: drawn rows."""

    depth: int
    round: int
    nodes: np.ndarray
    sums: dict
    spot: np.ndarray
    used: np.ndarray
    g: np.ndarray
    h: np.ndarray


def _searched(chunks: Iterator, level: _Level, p: BoostParams) -> Iterator[tuple]:
    """The best split of each node among a chunk's features, and which rows go right by it."""
    for chunk in chunks:
        k, first = len(level.nodes), 1 << level.depth
        of = np.where(level.used, level.spot, -1)[chunk.owner]
        kept = of >= 0
        if p.colsample_bytree < 1:
            drawn = _kept(_hashed(np.full(len(chunk.columns), 42), chunk.columns), p.colsample_bytree, p.seed + 1, level.round)
            kept &= drawn[chunk.column_of][chunk.of]
        kept = np.flatnonzero(kept)
        slot = chunk.of[kept].astype(np.int64) * k + of[kept]
        g, h = (x[chunk.owner[kept]] for x in (level.g, level.h))
        if len(chunk.codes) * k <= 8 * len(slot) + 1024:
            n, g, h = np.bincount(slot), np.bincount(slot, weights=g), np.bincount(slot, weights=h)
            slot = np.flatnonzero(n)
            g, h = g[slot], h[slot]
        else:
            slot, g, h = _summed(slot, g, h)
        keys = SB._level_key(chunk.codes[slot // k], (level.nodes - first)[slot % k], level.depth)
        best: dict[int, tuple] = {}
        for n, *split in _tried(*_summed(keys, g, h), level.sums, level.depth, SB.BITS, p):
            best[n] = min(best.get(n, (np.inf,)), tuple(split))
        if not best:
            continue
        nodes = np.array(sorted(best))
        places = np.searchsorted(level.nodes, nodes).tolist()
        zeros = np.zeros(k, dtype=bool)
        zeros[places] = [not best[n][3] for n in nodes.tolist()]
        right = zeros[level.spot]
        for place, n in zip(places, nodes.tolist()):
            _, feature, bin_, *_ = best[n]
            lo, hi = np.searchsorted(chunk.codes, (feature << SB.BITS, (feature + 1) << SB.BITS))
            cells = slice(int(chunk.ends[lo - 1]) if lo else 0, int(chunk.ends[hi - 1]))
            cells = np.flatnonzero(level.spot[chunk.owner[cells]] == place)[::-1] + cells.start  # the first of equal features is set last
            right[chunk.owner[cells]] = (chunk.codes[chunk.of[cells]] & ((1 << SB.BITS) - 1)) > bin_
        yield best, np.packbits(right)


class _Columns:
    """The rows' state on the driver and their cells in chunks of whole features."""

    def __init__(self, base: DataFrame, rows: DataFrame, trees: list[Tree], p: BoostParams, path: str, stored: int):
        spark, y, margin, key, begins, frames, self.fitted = base.sparkSession, [], [], [], [], [], 0
        moved = F.lit(0.0)
        for tree in trees:
            moved = moved + weight_of(tree)
        for part in ("train", "valid"):
            these = base.join(rows.where(F.col("part") == part), "row_id").select("f", "b", "y", moved.alias("margin"), F.xxhash64("row_id").alias("key"))
            these.mapInArrow(_blocks, _BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks-{part}")
            frames.append(spark.read.schema(_BLOCKS).parquet(f"{path}/blocks-{part}"))
            got = frames[-1].select("block", "rows", "state").toArrow().sort_by("block")  # 24 bytes a row
            begins.append(dict(zip(got["block"].to_pylist(), sum(map(len, y)) + np.cumsum([0, *got["rows"].to_pylist()]))))
            for x in got["state"]:
                for held, values in zip((y, margin, key), np.frombuffer(x.as_buffer(), np.float64).reshape(3, -1)):
                    held.append(values)
            self.fitted = self.fitted or sum(map(len, y))
        self.p, self.y, self.margin, self.key = p, np.concatenate([*y, []]), np.concatenate([*margin, []]), np.concatenate([*key, []]).view(np.int64)
        chunks = max(spark.sparkContext.defaultParallelism, -(-stored // SB.CHUNK_CELLS))
        dealt = [f.select("block", "codes", "ends", "owner").mapInArrow(partial(SB._dealt, begins=b, chunks=chunks), "chunk int, codes binary, sizes binary, owner binary")
                 for f, b in zip(frames, begins)]
        self.pieces = spark.sparkContext.union([d.rdd for d in dealt]).map(lambda r: (r[0], (r[1], r[2], r[3]))).partitionBy(chunks, int)
        # A row's hessian is at most 1/4: fewer cells never reach the least of a child.
        least = max(1, int(np.ceil(4 * p.min_child_weight - 1e-6)))
        self.chunks: RDD = self.pieces.coalesce(chunks).mapPartitions(partial(SB._chunks, fitted=self.fitted, least=least)).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.chunks.unpersist()
        self.pieces._jrdd.rdd().cleanShuffleDependencies(False)

    def round(self, t: int) -> tuple[Tree, dict[str, float]]:
        """The tree of round ``t`` and the losses after it."""
        p, tree = self.p, Tree()
        q = 1.0 / (1.0 + np.exp(np.clip(-self.margin, None, 700)))
        known = ~np.isnan(self.y)  # a null label has no gradient and no loss
        g, h = np.where(known, q - self.y, 0.0), q * (1.0 - q)
        used = np.arange(len(g)) < self.fitted
        if p.subsample < 1:
            used &= _kept(self.key, p.subsample, p.seed, t)
        sums, node = {1: (float(g[used].sum()), float(h[used].sum()))}, np.ones(len(g), dtype=np.int32)
        for depth in range(p.max_depth):
            first = 1 << depth
            nodes = np.array(sorted(n for n in sums if n >= first), dtype=np.int64)
            if not len(nodes):
                break
            place = np.full(2 * first, -1, dtype=np.int32)
            place[nodes] = np.arange(len(nodes))
            spot = place[node]
            level = _Level(depth, t, nodes, {n: sums[n] for n in nodes.tolist()}, spot, used, g, h)
            got = self.chunks.mapPartitions(partial(_searched, level=level, p=p)).collect()  # a row a node and a bit a row from each chunk
            goes = np.full(len(nodes), -1)  # whose bits move the rows of each place
            for n in nodes.tolist():
                best, i = min(((found[n], i) for i, (found, _) in enumerate(got) if n in found), default=((np.inf,), -1))
                if -best[0] <= LEAST_GAIN or -best[0] < p.gamma:
                    continue
                loss, feature, bin_, zeros_left, a, b = best
                tree.splits[n], tree.gains[n], goes[place[n]] = (feature, bin_, zeros_left), -loss, i
                sums[2 * n], sums[2 * n + 1] = (a, b), (sums[n][0] - a, sums[n][1] - b)
            by = np.where(spot >= 0, goes[spot], -1)
            for i in np.unique(by[by >= 0]).tolist():
                mine = by == i
                node[mine] = 2 * node[mine] + np.unpackbits(got[i][1], count=len(node))[mine]
        tree.weights = {n: _leaf_weight(*s, p) for n, s in sums.items() if n not in tree.splits}
        weights = np.zeros(max(tree.weights) + 1)
        weights[list(tree.weights)] = list(tree.weights.values())
        self.margin = self.margin + weights[node]
        loss = np.logaddexp(0.0, self.margin * (1.0 - 2.0 * np.where(known, self.y, 0.0)))
        parts = {"train": slice(self.fitted), "valid": slice(self.fitted, None)}
        return tree, {part: float(loss[at][known[at]].mean()) for part, at in parts.items() if known[at].any()}


# ---------------------------------------------------------------- the loop


def _gradients(margins: DataFrame) -> DataFrame:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return margins.select("row_id", (p - F.col("y")).alias("g"), (p * (F.lit(1.0) - p)).alias("h"))


def _losses(margins: DataFrame) -> dict[str, float]:
    signed = F.col("margin") * (F.lit(1.0) - F.lit(2.0) * F.col("y"))
    loss = F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))
    return {r.part: r.loss for r in margins.groupBy("part").agg(F.avg(loss).alias("loss")).collect()}


_TREES = "node int, feature int, bin int, zeros_left boolean, weight double, gain double, train_loss double, valid_loss double"


def _store_tree(spark: SparkSession, path: str, round_: int, tree: Tree, losses: dict[str, float]) -> None:
    rows = []
    for n in sorted({*tree.splits, *tree.weights}):
        s = tree.splits.get(n, (None, None, None))
        rows.append((n, *s, tree.weights.get(n), tree.gains.get(n), losses.get("train"), losses.get("valid")))
    spark.createDataFrame(rows, _TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees/round={round_:06d}")


def stored_rounds(spark: SparkSession, path: str) -> tuple[list[Tree], list[dict[str, float]]]:
    """The trees and losses of the rounds finished under ``path``, in order."""
    try:
        rows = spark.read.parquet(f"{path}/trees").orderBy("round", "node").collect()  # 2^depth rows a round
    except AnalysisException:
        return [], []
    trees, losses = [], []
    for r in rows:
        if int(r["round"]) > len(trees):
            trees.append(Tree())
            losses.append({k: v for k, v in (("train", r.train_loss), ("valid", r.valid_loss)) if v is not None})
        if r.feature is not None:
            trees[-1].splits[r.node] = (r.feature, r.bin, r.zeros_left)
            trees[-1].gains[r.node] = r.gain
        if r.weight is not None:
            trees[-1].weights[r.node] = r.weight
    return trees, losses


def _waited(losses: list[dict[str, float]]) -> tuple[int, int]:
    """(best round, rounds since) by the loss on the valid rows, to twelve decimals: sums
    in another order differ in their last digits."""
    best, at = float("inf"), 0
    for i, loss in enumerate(losses):
        if round(loss["valid"], 12) < best:
            best, at = round(loss["valid"], 12), i + 1
    return at, len(losses) - at


def fit(m: WideMatrix, params: BoostParams, valid: DataFrame | None = None, patience: int | None = None, path: str | None = None) -> Boosted:
    """Boost on the labelled rows of ``m`` without ``valid(row_id)``.  ``path``: a folder on
    shared storage; a second call with the same arguments goes on after its last round."""
    if patience and valid is None:
        raise ValueError("patience needs valid rows")
    spark, p = m.rows.sparkSession, params
    path = (path or scratch_path(spark, "boost")).rstrip("/")
    y = F.col(m.label_col).cast("double").alias("y")
    if valid is None:
        rows = m.rows.select("row_id", y, F.lit("train").alias("part"))
        seen = m.entries
    else:
        held = valid.select("row_id").distinct()
        rows = m.rows.select("row_id", y).join(held.withColumn("part", F.lit("valid")), "row_id", "left").fillna("train", ["part"])
        seen = m.entries.join(held, "row_id", "left_anti")
    trees, losses = stored_rounds(spark, path)
    if not trees:
        feature_cuts(seen.where("value != 0"), p.max_bins).write.mode("overwrite").parquet(f"{path}/features")
        features = spark.read.parquet(f"{path}/features")
        binned_rows(m, features).write.mode("overwrite").parquet(f"{path}/rows")
        rows.withColumn("margin", F.lit(0.0)).write.mode("overwrite").parquet(f"{path}/margins/round=000000")
    features = spark.read.parquet(f"{path}/features")
    base = spark.read.parquet(f"{path}/rows")
    stored = base.agg(F.sum(F.size("f").cast("long"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-stored // TASK_CELLS))
    n, own = rows.agg(F.count(F.lit(1)), F.count_distinct("row_id")).first()
    if 0 < n <= DRIVER_ROWS and n == own and p.max_bins < 1 << SB.BITS:
        columns = _Columns(base, rows, trees, p, path, stored)
        try:
            while len(trees) < p.rounds and not (patience and losses and _waited(losses)[1] >= patience):
                tree, loss = columns.round(len(trees) + 1)
                _store_tree(spark, path, len(trees) + 1, tree, loss)
                trees.append(tree)
                losses.append(loss)
        finally:
            columns.release()
        return _boosted(p, trees, features, losses, valid, path)
    # Dealt by row and sorted once; each round's margins come to it.
    base = base.repartition(parts, "row_id").sortWithinPartitions("row_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while len(trees) < p.rounds and not (patience and losses and _waited(losses)[1] >= patience):
            t = len(trees) + 1
            margins = spark.read.parquet(f"{path}/margins/round={t - 1:06d}")
            drawn = margins.where("part = 'train'")
            if p.subsample < 1:
                drawn = drawn.where(_drawn(F.col("row_id"), p.subsample, p.seed, t))
            steps = _gradients(drawn)
            totals = steps.agg(F.coalesce(F.sum("g"), F.lit(0.0)), F.coalesce(F.sum("h"), F.lit(0.0))).first()
            tree = grow(base.join(steps, "row_id"), tuple(totals), p, t, parts)
            moved = base.join(margins, "row_id").select("row_id", "y", "part", (F.col("margin") + weight_of(tree)).alias("margin"))
            moved.write.mode("overwrite").parquet(f"{path}/margins/round={t:06d}")
            losses.append(_losses(spark.read.parquet(f"{path}/margins/round={t:06d}")))
            _store_tree(spark, path, t, tree, losses[-1])
            trees.append(tree)
            if t > 1:
                remove(spark, f"{path}/margins/round={t - 2:06d}")
    finally:
        base.unpersist()
    return _boosted(p, trees, features, losses, valid, path)


def _boosted(p: BoostParams, trees: list[Tree], features: DataFrame, losses: list[dict[str, float]], valid: DataFrame | None, path: str) -> Boosted:
    best = _waited(losses)[0] if valid is not None and losses and "valid" in losses[0] else len(trees)
    curve = [(i + 1, part, loss[part]) for i, loss in enumerate(losses) for part in sorted(loss)]
    return Boosted(p, trees, features, curve, best, path)


def predict(model: Boosted, m: WideMatrix, rounds: int | None = None, cut: float = 0.5) -> DataFrame:
    """(row_id, p, label_pred) by the best rounds (or the first ``rounds``) for every row."""
    trees = model.trees[:model.best_rounds if rounds is None else rounds]
    used = sorted({s[0] for t in trees for s in t.splits.values()})
    spark = m.rows.sparkSession
    numbers = spark.createDataFrame([(n,) for n in used], "number int")  # at most the model's splits
    rows = binned_rows(replace(m, scan=None), model.features.join(F.broadcast(numbers), "number"))
    rows = rows.withColumn("margin", F.lit(0.0))
    for tree in trees:
        rows = rows.withColumn("margin", F.col("margin") + weight_of(tree))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return rows.select("row_id", p.alias("p"), (p > F.lit(cut)).cast("int").alias("label_pred"))
