"""Score a stream of documents with a fitted screening pipeline.

The reference scores new rows in chunks; the Structured Streaming form is a
``readStream`` of document files and ``foreachBatch``: each micro-batch runs the
same batch replay (tokens -> gather -> vectors -> scale -> predict) and writes
its ``(id, label)`` rows under ``batch_id=<n>``, overwriting that batch only, so
a replayed batch after a failure yields the same files (idempotent sink).
No state is kept between batches: the fitted tables are the only state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from featsift.operators.matrix import WideMatrix
from featsift.plans.pipelines import FittedScreening, submission_frame, transform_screening
from featsift.sources.tables import doc_tokens

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def _batch_matrix(batch: DataFrame) -> WideMatrix:
    docs = batch.select("doc_id", "text")
    entries = doc_tokens(docs).select(
        F.col("doc_id").alias("row_id"), F.col("token").alias("feature_id"), F.lit(1.0).alias("value")
    )
    return WideMatrix(entries=entries, rows=docs.select(F.col("doc_id").alias("row_id")), label_col=None)


def score_documents_stream(spark: SparkSession, fitted: FittedScreening, source_dir: str, out_dir: str,
                           checkpoint: str | None = None, available_now: bool = True,
                           max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(DOC_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        scored = submission_frame(transform_screening(fitted, _batch_matrix(batch)))
        scored.write.mode("overwrite").option("header", True).csv(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    # The offsets lie beside the output unless told otherwise: the same path in every run.
    ckpt = checkpoint or f"{out_dir.rstrip('/')}-offsets"
    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
