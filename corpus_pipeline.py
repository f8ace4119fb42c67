"""The corpus pipeline: five stages over ``documents``, each written and read again.

Quality rules drop rejected documents, line dedup takes repeated lines out of the
texts, SimHash near-dedup keeps one document of each group, mixing repeats or drops
documents towards the source targets, and byte-level BPE turns the mix into tokens.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from featsift.llm import byte_bpe, line_dedup, mixing, quality_rules, simhash
from featsift.llm.common import documents, stored
from featsift.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
    ("mixing", mixed), ("byte_bpe", tokens),
]

# The fingerprints and the tokens are beyond SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
