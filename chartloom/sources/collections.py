"""Named collections of contexts, as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import retrieval_query
from ..providers import Embedder
from ..schemas import CONTEXTS


def open_collection(spark: SparkSession, name: str, reset: bool = False) -> DataFrame:
    """The collection; made empty from its schema where it isn't there, or with reset."""
    if reset:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], CONTEXTS).write.format("parquet").saveAsTable(name)
    return spark.table(name)


def with_ids(contexts: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """contexts with an id made of what they are, so that ties rank alike in every run, and an embedding."""
    parts = ["patient_id", "reference", "pdf_source", "feature_pos", "pattern_no", "match_no"]
    made = contexts.withColumn("context_id", F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256))
    return made.withColumn("embedding", embedder.column(F.col("context")) if embedder else F.lit(None).cast("array<float>"))


def add_contexts(contexts: DataFrame, name: str) -> None:
    """Append; one write for all patients."""
    fields = [F.col(f.name).cast(f.dataType) for f in CONTEXTS]
    have = contexts.select(fields)
    order = [c for c in contexts.sparkSession.table(name).columns]
    have.select(order).write.mode("append").insertInto(name)


def query_embeddings(features: DataFrame, embedder: Embedder) -> DataFrame:
    """features with the embedding of the text they are searched by."""
    return features.withColumn("query_embedding", embedder.column(retrieval_query(F.col("description"), F.col("input_prompt"))))
