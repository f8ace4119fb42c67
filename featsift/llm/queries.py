"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsift.llm import (
    alignment, byte_bpe, conversations, exact_dedup, kernel_quality, line_dedup, mixing, packing, paragraphs, quality_rules, sharding, simhash, suffix_dedup,
)
from featsift.llm.common import documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACKING_VOCABULARY = "word_bpe_49k.json"
ALIGNED_VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(documents(spark, sf_dir))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        "doc_id", *[F.col(f"stats.{c}").alias(c) for c in stats], quality_rules.base_failed("stats").alias("base_failed"), "kept", "distance2"
    )


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.near_paragraphs(documents(spark, sf_dir))


def op3_line_mph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).drop("text")


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(documents(spark, sf_dir))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", taken)


def op5_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op6_exact_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_table(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return byte_bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, full=False)


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return kernel_quality.score_quality(documents(spark, sf_dir), labels)


def op10_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), "map_version",
    )


def op11_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(documents(spark, sf_dir), public_tokenizers.path(PACKING_VOCABULARY))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ALIGNED_VOCABULARIES)
    return alignment.align(documents(spark, sf_dir), *paths, full=False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_mcd, op2_paragraph_minhash, op3_line_mph, op4_systematic_mix, op5_simhash_grid,
        op6_exact_fuse, op7_byte_bpe, op8_suffix_repeats, op9_fourier_quality, op10_slot_sharding,
        op11_cost_packing, op12_token_alignment, op13_conversation_repair,
    )
}

# Written for the driver's tables, whose doc_id is unique and not null.
ORACLES: dict[str, str] = {
    "op3_line_mph": """
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, k.k, k.line, coalesce(m.first < k.doc_id, false) AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op4_systematic_mix": mixing.ORACLE,
    "op6_exact_fuse": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op13_conversation_repair": conversations.ORACLE,
}
