"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / size of its source times.  Along
the source's documents, ordered by size, these expectations are summed up; with one
random offset per source, a document is taken once for each whole number that the
running sum crosses in it.  As the order is by size, a source's taken words differ
from its target by no more than its largest document, and no document is taken
more often than the expectation rounded up (twice at most under the default cap).

The running sum is a distributed one: a range-partitioned sort and per-partition
offsets, so a source that holds most rows is spread over many tasks.

Defined cases: null text has size 0; null source is a source of its own, last in
order; a source without words is taken as nothing; ties and repeated rows are
ordered by id and then by a hash of the text; empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featsift.llm.common import body, fresh, stored
from featsift.operators.ranking import sequence_by

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5  # of all words
CAP = 2.0  # times a source's words
SEED = 42


def n_words(text: str = "text") -> Column:
    # Spaces of every kind become one space, so that words are split by it alone.
    plain = F.btrim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     "), F.lit(" "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``.

    Weights repeat along the sources in code point order.  What exceeds a cap is
    shared out again by weight until no target is above its cap.
    """
    ordered = sequence_by(sizes, [F.col("source").asc_nulls_last()], "rn")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(ordered.select("source", "source_size", w.alias("w"), (F.col("source_size") * cap).alias("top")), "sources")
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, want = 0.0, total * share
    # Each pass settles which sources are full at the present level; the level only rises.
    while True:
        full = F.col("top") <= F.col("w") * level
        spent, open_w = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("top"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)),
        ).first()
        new = (want - spent) / open_w if open_w > 0 else level
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("top"), F.col("w") * F.lit(level)).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A uniform number in [0, 1) for each source, the same on every run."""
    tag = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(tag, 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, tag for each row of ``docs``;
    rows with equal doc_id, source, size and tag are interchangeable."""
    tag = F.xxhash64(body(), F.length(body()))
    rows = stored(docs.select("doc_id", "source", n_words().alias("size"), tag.alias("tag")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("tag")]
    ranked = sequence_by(rows, order, "place")
    starts = ranked.groupBy("source").agg(F.min("place").alias("start"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    facts = targets.withColumnRenamed("source", "s2").join(starts.withColumnRenamed("source", "s3"), same("s2", "s3")).drop("s3")
    out = ranked.join(facts, same("source", "s2")).drop("s2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    i = F.col("place") - F.col("start")
    upto = lambda k: F.floor(offset(F.col("source"), seed) + rate * k)
    return out.withColumn("copies", upto(i + 1) - upto(i)).drop("place", "start")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    plan = copies(docs, weights, share, cap, seed)
    # Interchangeable rows share their copies out by running number.
    key = ["doc_id", "source", "size", "tag"]
    per = plan.groupBy(*key).agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("m"))
    name = fresh(docs, "row")
    rows = docs.select(F.struct(*docs.columns).alias(name))
    same = (
        F.col(f"{name}.doc_id").eqNullSafe(F.col("doc_id")) & F.col(f"{name}.source").eqNullSafe(F.col("source"))
        & (F.xxhash64(body(f"{name}.text"), F.length(body(f"{name}.text"))) == F.col("tag"))
    )
    dealt = rows.join(per.where("c > 0"), same)
    twin = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(name)))
    lone = dealt.where("m = 1").withColumn("take", F.col("c"))
    # Only rows repeated in id, source and text come here, a group at a time.
    shared = dealt.where("m > 1").withColumn("k", twin).withColumn(
        "take", F.floor(F.col("c") * F.col("k") / F.col("m")) - F.floor(F.col("c") * (F.col("k") - 1) / F.col("m"))
    ).drop("k")
    taken = lone.unionByName(shared).where("take > 0")
    return taken.withColumn("take", F.explode(F.sequence(F.lit(1).cast("long"), F.col("take").cast("long")))).select(f"{name}.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  text FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             source_size * {CAP}::DOUBLE AS top FROM s),
o AS (SELECT *, coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS spent,
             (sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open_w,
             (sum(source_size) OVER ())::DOUBLE AS total FROM w),
l AS (SELECT arg_min(level, place) AS level
      FROM (SELECT *, (total * {SHARE}::DOUBLE - spent) / open_w AS level, row_number() OVER (ORDER BY top / w, source NULLS LAST) AS place FROM o)
      WHERE top > w * level),
t AS (SELECT source, source_size, least(top, w * coalesce(level, 0.0)) AS target FROM o, l),
r AS (SELECT d.doc_id, d.source, size, source_size, target,
             row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) AS k,
             ('0x' || substr(md5('{SEED}/' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(u + rate * k) - floor(u + rate * (k - 1))))::BIGINT AS taken FROM r
"""
