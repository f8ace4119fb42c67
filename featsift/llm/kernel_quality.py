"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text (never its language, source or id) are standardised and mapped
to random Fourier features, whose inner products approximate a Gaussian kernel.
Tasks sum the normal equations of the labelled rows; the sums, a matrix of fixed
size, are added up by rows of the matrix, and the ridge system is solved on the
driver.  Rows set aside from the fit give a histogram of raw scores with label
counts, on which an isotonic curve turns raw scores into probabilities.

Labels of rows with crc32(doc_id) mod 3 = 1 are held out and never read.  Of the
others a quarter, by the same number, calibrates.

Defined cases: null text counts as empty and gets a score like any other; rows
without a label (or with a null one) are scored only; a doc_id that is labelled twice
counts twice if its labels agree and not at all otherwise; without any label the
score is 0.5; empty input gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsift.llm.common import body, stored
from featsift.llm.quality_rules import text_stats

FEATURES = 256
RIDGE = 1e-2  # per labelled row
WIDTH = 3.0  # of the kernel, in standard deviations
SEED = 11
GRID = 1024  # cells of the raw score, from -0.5 to 1.5

_DIGITS = bytes(range(48, 58))


def statistics(raw: bytes) -> list[float]:
    """Ten statistics of a text."""
    n_words, chars, symbols, lines, dup_lines, repeats, upper, marks = text_stats(raw)
    words = raw.split()
    w, c = n_words + 1.0, chars + 5.0
    same = sum(map(bytes.__eq__, words, words[1:]))
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / c
    return [
        math.log(w), math.log(c / w), math.sqrt(symbols / c), math.sqrt(upper / c), math.sqrt(marks / c),
        math.sqrt(share(_DIGITS)), len(set(words)) / w, math.sqrt(same / w), repeats / w + dup_lines / (lines + 1.0),
        math.log1p(w / (lines + 1.0)),
    ]


N = 10


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(text: pa.Array) -> pa.Array:
    return pa.array([statistics(x.as_py() or b"") for x in text], pa.list_(pa.float64()))


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def matrix(column) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, N) if len(rows) else np.zeros((0, N))


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of ``parts(i, v)`` by i; as many rows as the fixed matrix has reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        v = sorted(table.column("v").to_pylist())  # the same sum whatever the order of arrival
        return pa.table({"i": table.column("i")[:1], "v": pa.array([np.sum(np.array(v), axis=0).tolist()], pa.list_(pa.float64()))})

    return {r.i: np.array(r.v) for r in parts.groupBy("i").applyInArrow(add, "i int, v array<double>").collect()}


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # (N, FEATURES)
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * math.sqrt(2 / FEATURES), z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.heights)


def _sums(of):
    """A mapInArrow function that adds ``of(x, y)`` -> matrix over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                if part.num_rows:
                    m = of(matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False).astype(float))
                    total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"]
            )

    return run


_PART = "i int, v array<double>"


def isotonic(total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over cells in order: knots (cell numbers) and heights."""
    blocks: list[list[float]] = []  # rows, ones, sum of rows * cell
    for cell in np.flatnonzero(total):
        blocks.append([total[cell], ones[cell], total[cell] * cell])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    at = np.array([b[2] / b[0] for b in blocks])
    # Half a row of either label keeps the ends off 0 and 1.
    return at, np.maximum.accumulate(np.array([(b[1] + 0.5) / (b[0] + 1.0) for b in blocks]))


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model | None:
    """A model of ``rows(f, y, part)``; part 0 calibrates, the others are fitted."""
    moments = added(rows.select("f", "y").mapInArrow(_sums(lambda x, y: np.vstack([np.full(N, len(x)), x.sum(0), (x * x).sum(0)])), _PART))
    if not moments:
        return None
    n, mean = moments[0][0], moments[1] / moments[0][0]
    scale = np.sqrt(np.maximum(moments[2] / n - mean**2, 0)) + 1e-3
    rng = np.random.Generator(np.random.PCG64(SEED))
    model = Model(mean, scale, rng.normal(size=(N, features)) / WIDTH, rng.uniform(0, 2 * math.pi, features), np.zeros(0), np.zeros(0), np.zeros(0))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return z.T @ np.hstack([z, y[:, None]])

    fitting = rows.where("part <> 0") if n >= 200 else rows  # too few to set any aside
    sums = added(fitting.select("f", "y").mapInArrow(_sums(normal), _PART))
    if not sums:
        return None
    a = np.vstack([sums[i] for i in range(len(sums))])
    weight = a[-1, -2]  # rows fitted: the intercept's square
    penalty = ridge * weight * np.diag([*[1.0 / features] * features, *[1e-3] * N, 0.0])
    model.beta = np.linalg.solve(a[:, :-1] + penalty + 1e-9 * np.eye(len(a)), a[:, -1])

    def cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cell = np.clip(((model.raw(x) + 0.5) * GRID / 2).astype(int), 0, GRID - 1)
        return np.vstack([np.bincount(cell, minlength=GRID), np.bincount(cell, weights=y, minlength=GRID)])

    setting = rows.where("part = 0") if n >= 200 else rows
    counts = added(setting.select("f", "y").mapInArrow(_sums(cells), _PART))
    if not counts:
        return None
    at, heights = isotonic(counts[0], counts[1])
    model.knots, model.heights = (at + 0.5) * 2 / GRID - 0.5, heights
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, learnt from
    ``labels(doc_id, quality)``."""
    crc = remainder()
    stats = stored(docs.select("doc_id", crc.alias("crc"), statistics_of(body()).alias("f")), "statistics")
    y = labels.where(F.col("quality").isNotNull() & (F.pmod(remainder(), F.lit(3)) != 1)).groupBy("doc_id").agg(
        F.min("quality").cast("double").alias("y"), F.max("quality").cast("double").alias("high")
    ).where("y = high").select("doc_id", "y")
    part = (F.floor(F.col("crc") / 3) % 4).cast("int")
    rows = stored(stats.join(y, "doc_id").select("f", "y", part.alias("part")), "labelled")
    model = fit(rows)

    @F.arrow_udf(T.DoubleType())
    def scored(f: pa.Array) -> pa.Array:
        return pa.array(np.clip(model.score(matrix(f)), 0.0, 1.0) if len(f) else [], pa.float64())

    score = scored("f") if model is not None else F.lit(0.5)
    out = stats.select("doc_id", (F.pmod("crc", F.lit(3)) == 1).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
