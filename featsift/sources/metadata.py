"""Metadata CSV source: header, all columns read as strings, NA tokens nulled.

One file is read by many tasks although a quoted field may hold line breaks.  Spark's
text source deals byte ranges and finds lines in them; a line starts a record if the
quotes before it in its file are even in number.  Quotes are counted in each range and
summed over the ranges before (one row a range), so each range knows how it starts
without reading another.  The lines of a record are joined again, also over range
borders, and each record is parsed by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsift.functions.exprs import normalize_na

_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, text)``: the records of the CSV files under ``path``, numbered
    from 1 in each file, without their line end; blank lines are records of no text."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    quotes = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).alias("quotes")
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    # Of each range: the quotes before it, then the records that begin before it.
    ranges = lines.select("file", "block", quotes).groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    ranges = ranges.select("file", "block", total("quotes").alias("quotes_before"))
    begins = ((F.col("quotes_before") + F.sum("quotes").over(inside) - F.col("quotes")) % 2 == 0).cast("long").alias("begins")
    marked = lines.select("*", quotes).join(ranges, ["file", "block"]).select("file", "block", "at", "line", begins)
    counts = marked.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    counts = counts.select("file", "block", total("n").alias("records_before"))
    numbered = marked.join(counts, ["file", "block"]).select(
        "file", (F.col("records_before") + F.sum("begins").over(inside)).alias("record"), F.struct("block", "at", "line").alias("part")
    )
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]))
    return numbered.groupBy("file", "record").agg(F.regexp_replace(text, "\r\\z", "").alias("text"))


def read_metadata_csv(spark: SparkSession, path: str, key: str | None = "ID", key_type: str = "string") -> DataFrame:
    """``pd.read_csv`` semantics for categorical metadata.

    No schema inference pass over the data (a second full scan at scale): every
    column is a string, the 19 NA tokens become null, the key is cast.  Doubled quotes
    and line breaks inside quotes are read as pandas does; blank lines are skipped; lines
    end in a line feed, with or without a carriage return.  The files of a folder have
    the same header, which is each one's first record.
    """
    # Reads the first record only.
    names = spark.read.options(**_OPTIONS).option("header", True).csv(path).columns
    rows = csv_records(spark, path).where((F.col("record") > 1) & (F.col("text") != ""))
    df = rows.select(F.from_csv("text", _ddl(names), _OPTIONS).alias("r")).select("r.*")
    cols = [c for c in df.columns if c != key]
    df = normalize_na(df, cols)
    if key and key in df.columns:
        df = df.withColumn(key, F.col(key).cast(key_type))
    return df


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
