"""Notes as a stream: the same expressions on arriving files; each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contexts import extract_contexts


def note_stream(spark: SparkSession, folder: str) -> DataFrame:
    """patient_id, pdf_source, arrived and markdown_text of Parquet notes as they arrive in folder."""
    notes = spark.readStream.schema("patient_id string, pdf_source string, arrived timestamp, markdown_text string").parquet(folder)
    return notes.withWatermark("arrived", "1 hour").dropDuplicatesWithinWatermark(["patient_id", "pdf_source"])


def stream_contexts(notes: DataFrame, features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the snippets of arriving notes to path; stops when all that has arrived is done."""
    found = extract_contexts(notes.withColumn("reference", F.regexp_replace("pdf_source", r"\.pdf$", "")), features)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
