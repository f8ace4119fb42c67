"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of six transformed statistics.  A minimum-
covariance-determinant estimate (location and scatter of the tightest part of the
rows) is fitted for each (lang, source); documents far from it by Mahalanobis
distance are rejected, besides those that fail the plain base rules.

How the estimate is made: from a median start and a mean start, each C-step takes
the Mahalanobis distance of every row, keeps the closest ``SUBSET`` share of each
group and re-estimates mean and scatter from it.  Distances fall into fine
logarithmic bins, so one grouped aggregate (counts and sums of products per group
and bin, combined before the shuffle) gives the next estimate; a group of any size
is never gathered.  The start with the smaller determinant wins; a reweighted step
follows.  Scatter gets a fixed tolerance on its diagonal (the regularised form of
the estimate), as most rows have no symbols or repeats at all.

Defined cases: null text counts as empty (fails the base rule); null lang or source
is a value of its own; a group under ``MIN_GROUP`` ordinary rows (that pass the base
rules) is judged by the estimate of its whole language, where that has fewer too by
that of all rows, however few; repeated rows are judged alike; empty input gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsift.llm.common import body, fresh, stored

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

P = 6  # statistics in the vector; even, so the chi-square law has a closed form
SUBSET = 0.75
STEPS = 6
MIN_GROUP = 200
REWEIGHT = 0.975
CUTOFF = 1 - 1e-6  # chi-square quantile beyond which a document is an outlier
BINS_PER_DOUBLING = 16
MAX_SENT = 20_000  # rows of estimates (some 250 bytes each) that go to every task
SALTS = 64

_SPACES = b" \t\n\x0b\x0c\r"
_NOT_POINTS = _SPACES + bytes(range(0x80, 0xC0))  # with continuation bytes
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_PLAIN = _NOT_POINTS + _UPPER + _LOWER + _DIGITS + SYMBOLS + bytes(range(0xC0, 0x100))
# Standard deviations that always count as ordinary, one per statistic.
TOLERANCE = (0.10, 0.25, 0.25, 0.10, 0.05, 0.05)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a ``width``-word window that the text holds twice or more."""
    if len(words) < width:
        return 0
    seen: dict[tuple, int] = {}
    again: set[int] = set()
    for i, window in enumerate(zip(*(words[k:] for k in range(width)))):
        first = seen.setdefault(window, i)
        if first != i:
            again.add(first)
            again.add(i)
    covered, reach = 0, 0
    for i in sorted(again):
        covered += i + width - max(i, reach)
        reach = i + width
    return covered


def text_stats(raw: bytes) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    left = lambda drop: len(raw.translate(None, drop))
    return (
        len(words), left(_NOT_POINTS), len(raw) - left(SYMBOLS), len(lines), len(lines) - len(set(lines)),
        repeated_words(words), len(raw) - left(_UPPER), left(_PLAIN),
    )


STATS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")]
)


@F.arrow_udf(STATS)
def stats_of(text: pa.Array) -> pa.Array:
    rows = [text_stats(x.as_py() or b"") for x in text]
    columns = list(zip(*rows)) if rows else [[] for _ in STATS.names]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=STATS.names)


def vector(s: str) -> list[Column]:
    """The six statistics of struct column ``s``, shrunk towards ordinary text so
    that a short document does not stand out by chance, on scales that are about even."""
    c = lambda name: F.col(f"{s}.{name}").cast("double")
    return [
        F.log((c("word_chars") + 250.0) / (c("n_words") + 50.0)),
        F.log1p(100.0 * c("n_symbols") / (c("word_chars") + 250.0)),
        F.log1p(100.0 * c("n_marks") / (c("word_chars") + 250.0)),
        F.sqrt((c("n_upper") + 5.0) / (c("word_chars") + 250.0)),
        c("n_dup_lines") / (c("n_lines") + 5.0),
        c("n_repeat_words") / (c("n_words") + 50.0),
    ]


def base_failed(s: str) -> Column:
    n = F.col(f"{s}.n_words")
    return (n < MIN_WORDS) | (F.col(f"{s}.n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)


# ---------------------------------------------------------------- chi-square, even degrees


def chi2_cdf(x: float, dof: int) -> float:
    if x <= 0:
        return 0.0
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < q else (low, mid)
    return (low + high) / 2


def consistency(share: float) -> float:
    """Scales the scatter of the closest ``share`` of normal rows up to that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


# ---------------------------------------------------------------- the estimate

_X = [f"x{i}" for i in range(P)]
_M = [f"m{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_Q = [f"q{i}{j}" for i, j in _PAIRS]
_SUMS = [f"s{i}" for i in range(P)] + [f"s{i}{j}" for i, j in _PAIRS]


def distance() -> Column:
    """Squared Mahalanobis distance of the columns x* under the columns m*, q*."""
    d = [F.col(x) - F.col(m) for x, m in zip(_X, _M)]
    terms = [F.col(q) * d[i] * d[j] * (1.0 if i == j else 2.0) for q, (i, j) in zip(_Q, _PAIRS)]
    return reduce(lambda a, b: a + b, terms)


_FIT = T.StructType([T.StructField(c, T.DoubleType()) for c in ["logdet", *_M, *_Q]])


def fitted(scale: float):
    """Mean and inverse scatter of summed rows; ``scale``: the consistency factor."""

    @F.arrow_udf(_FIT)
    def fit(n: pa.Array, sums: pa.Array) -> pa.Array:
        rows = []
        for count, values in zip(n.to_pylist(), sums.to_pylist()):
            s, mean = np.array(values), np.zeros(P)
            mean = s[:P] / count
            cov = np.zeros((P, P))
            for (i, j), v in zip(_PAIRS, s[P:]):
                cov[i, j] = cov[j, i] = v / count - mean[i] * mean[j]
            cov = cov * scale + np.diag(np.square(TOLERANCE))
            inv = np.linalg.inv(cov)
            rows.append([np.linalg.slogdet(cov)[1], *mean, *(inv[i, j] for i, j in _PAIRS)])
        arrays = np.array(rows, dtype=float).reshape(-1, len(_FIT.names)).T
        return pa.StructArray.from_arrays([pa.array(a) for a in arrays], names=_FIT.names)

    return fit


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum(x).alias(s) for x, s in zip(_X, _SUMS)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(s) for (i, j), s in zip(_PAIRS, _SUMS[P:])]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def _estimate(summed: DataFrame, by: list[str], scale: float) -> DataFrame:
    """One row of ``by``, logdet, m*, q* for each row of sums."""
    return summed.select(*by, fitted(scale)(F.col("n"), F.array(*_SUMS)).alias("f")).select(*by, "f.*")


def beside(rows: DataFrame, pools: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """``rows`` joined to the stored table ``pools``, a few rows for each pool, by pairs of
    columns, equal with nulls; those of ``pools`` are dropped.  ``pools`` is counted: up to
    ``MAX_SENT`` rows go to every task, more are copied to ``SALTS`` groups each, to which
    the rows of a pool are dealt by their places, as one pool (or one text's copies) may
    hold a third of all rows."""
    kept = rows.columns
    if pools.count() <= MAX_SENT:
        pools = F.broadcast(pools)
    else:
        salt, other = fresh(rows, "salt"), fresh(pools, "salt_of_pool")
        rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        pools = pools.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        on = [*on, (salt, other)]
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in on])
    return rows.join(pools, same, how).select(*kept, *[c for c in pools.columns if c not in {b for _, b in on}])


def _closest(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """The sums of the closest ``share`` of each (g, start), whole bins at a time."""
    level = F.floor(F.log2(F.greatest(distance(), F.lit(1e-6))) * BINS_PER_DOUBLING).cast("int")
    binned = _summed(beside(rows, params.withColumnRenamed("g", "g2"), [("g", "g2")]).withColumn("bin", level), ["g", "start", "bin"])
    # At most a few hundred bins in a window group, whatever the group's size.
    w = Window.partitionBy("g", "start")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = binned.withColumn("all", F.sum("n").over(w)).withColumn("before", F.sum("n").over(upto) - F.col("n"))
    kept = kept.where(F.col("before") < F.col("all") * share)
    return kept.groupBy("g", "start").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in _SUMS])


def _starts(rows: DataFrame) -> DataFrame:
    """Two starting estimates: medians with interquartile scales, and plain moments."""
    grid = [F.percentile(F.round(F.col(x), 2), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i, x in enumerate(_X)]
    quart = rows.groupBy("g").agg(*grid)
    spread = [F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + F.lit(TOLERANCE[i] ** 2) for i in range(P)]
    median = quart.select(
        "g", F.lit(0).alias("start"), F.lit(0.0).alias("logdet"), *[F.col(f"p{i}")[1].alias(_M[i]) for i in range(P)],
        *[(1.0 / spread[i] if i == j else F.lit(0.0)).alias(q) for q, (i, j) in zip(_Q, _PAIRS)],
    )
    moments = _estimate(_summed(rows, ["g"]).withColumn("start", F.lit(1)), ["g", "start"], 1.0)
    return median.unionByName(moments)


def _part(c: str) -> Column:
    """A string for a value of column ``c``, null-safe and without clashes."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))


def group_key(lang: str, source: str) -> Column:
    """One string per (lang, source), null-safe and without clashes."""
    return F.concat(_part(lang), F.lit("/"), _part(source))


def _levels() -> list[Column]:
    """The pools that rows of a (lang, source) can feed: its own, its language's, that of all rows."""
    return [group_key("lang", "source"), F.concat(F.lit("lang "), _part("lang")), F.lit("all")]


def pools(rows: DataFrame) -> DataFrame:
    """``(lang, source, g)``: the pool whose estimate each (lang, source) of
    ``rows(lang, source, bad)`` uses, the narrowest with ``MIN_GROUP`` ordinary rows."""
    sizes = rows.groupBy("lang", "source").agg(F.count_if(~F.col("bad")).alias("n"))
    by_lang = sizes.groupBy(F.col("lang").alias("l2")).agg(F.sum("n").alias("ln"))
    named = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("l2")))
    own, lang, everything = _levels()
    g = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("ln") >= MIN_GROUP, lang).otherwise(everything)
    return named.select("lang", "source", g.alias("g"))


def feeds(pool: DataFrame) -> DataFrame:
    """``(lang, source, g)``: every used pool that the rows of a (lang, source) belong to."""
    every = pool.select("lang", "source", F.explode(F.array(*_levels())).alias("g"))
    return every.join(pool.select("g").distinct(), "g", "left_semi").select("lang", "source", "g")


def robust_estimates(rows: DataFrame, share: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of each ``g`` of
    ``rows(g, x0..x5)``: columns g, logdet, m*, q*."""
    params = stored(_starts(rows), "mcd")
    for _ in range(steps):
        params = stored(_estimate(_closest(rows, params, share), ["g", "start"], consistency(share)), "mcd")
    first = Window.partitionBy("g").orderBy("logdet", "start")  # two rows each
    best = params.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "start", "logdet")
    near = beside(rows, stored(best.withColumnRenamed("g", "g2"), "mcd"), [("g", "g2")]).where(distance() <= chi2_quantile(REWEIGHT, P))
    return stored(_estimate(_summed(near, ["g"]), ["g"], consistency(REWEIGHT)), "mcd")


def rejecting(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Adds distance2 (null: no ordinary row at all) and kept to rows that carry lang, source
    and the struct column ``stats``."""
    docs = stats.select("lang", "source", *[x.alias(n) for x, n in zip(vector("stats"), _X)], base_failed("stats").alias("bad"))
    pool = stored(pools(docs), "pools")
    same = [("lang", "l2"), ("source", "s2")]
    renamed = [F.col("lang").alias("l2"), F.col("source").alias("s2"), "g"]
    # Rows that fail the base rules do not shape the estimate of ordinary text.
    fed = stored(feeds(pool).select(*renamed), "feeds")
    rows = beside(docs.where(~F.col("bad")), fed, same).select("g", *_X)
    best = robust_estimates(rows)
    judge = stored(pool.select(*renamed).join(best, "g", "left").drop("g", "logdet"), "judge")
    out = beside(stats, judge, same, "left").withColumns({n: x for x, n in zip(vector("stats"), _X)})
    far = F.when(F.col(_Q[0]).isNotNull(), distance())
    out = out.withColumn("distance2", far).drop(*_X, *_M, *_Q)
    fine = F.coalesce(F.col("distance2") <= chi2_quantile(cutoff, P), F.lit(True))
    return out.withColumn("kept", ~base_failed("stats") & fine)


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, stats, distance2, kept for each row of ``docs``."""
    stats = stored(docs.select("doc_id", "lang", "source", stats_of(body()).alias("stats")), "stats")
    return rejecting(stats, cutoff)


def keep_clean(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the rejected documents, columns unchanged.

    The verdict is a function of lang, source and the text's statistics, so equal
    rows fare alike; only verdicts (a hash of those columns) travel, not texts.
    """
    tag = F.xxhash64(group_key("lang", "source"), body(), F.length(body()))
    stats = stored(docs.select(tag.alias("tag"), "lang", "source", stats_of(body()).alias("stats")), "stats")
    bad = rejecting(stats, cutoff).where(~F.col("kept")).select("tag").distinct()
    name = fresh(docs, "tag")
    return docs.withColumn(name, tag).join(bad.withColumnRenamed("tag", name), name, "left_anti").drop(name)
