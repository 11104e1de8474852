"""Which file of a patient stands for which reference label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_references(features: DataFrame, default_reference: str = "") -> DataFrame:
    """reference and ref_pos: the labels of all features, by first appearance.

    A missing primary label counts as default_reference; empty fallbacks are left out, an empty primary isn't.
    """
    slots = F.array(
        F.struct(F.lit(0).alias("slot"), F.coalesce("reference", F.lit(default_reference)).alias("reference")),
        F.struct(F.lit(1).alias("slot"), F.col("fallback_category_1").alias("reference")),
        F.struct(F.lit(2).alias("slot"), F.col("fallback_category_2").alias("reference")),
    )
    rows = features.select("pos", F.explode(slots).alias("x")).select("pos", "x.*")
    kept = rows.where((F.col("slot") == 0) | (F.coalesce("reference", F.lit("")) != ""))
    first = kept.groupBy("reference").agg(F.min(F.struct("pos", "slot")).alias("at"))
    # labels of definitions: few rows, so one ordered window is enough
    return first.select("reference", (F.row_number().over(Window.orderBy("at")) - 1).alias("ref_pos"))


def resolve_references(files: DataFrame, references: DataFrame) -> DataFrame:
    """patient_id, reference, ref_pos and pdf_source: the file that each label stands for.

    The exact name label.pdf comes first, then a name that begins with the label in any case,
    then any file; of equals the first by name.  Only names ending in .pdf count.  A label of "" begins every name.
    """
    named = files.where(F.col("pdf_source").endswith(".pdf"))
    labels = references.select("reference", "ref_pos")
    exact = F.col("pdf_source") == F.concat("reference", F.lit(".pdf"))
    prefix = F.startswith(F.lower("pdf_source"), F.lower("reference"))
    # a handful of labels meets each file once; the best file of each label is kept by a partial aggregate
    pairs = named.crossJoin(F.broadcast(labels)).withColumn("prio", F.when(exact, 0).when(prefix, 1).otherwise(2))
    best = pairs.groupBy("patient_id", "reference", "ref_pos").agg(F.min(F.struct("prio", "pdf_source")).alias("best"))
    return best.select("patient_id", "reference", "ref_pos", F.col("best.pdf_source").alias("pdf_source"))


def claim_once(resolved: DataFrame) -> DataFrame:
    """Each file for one label only: the one that appears first."""
    first = resolved.groupBy("patient_id", "pdf_source").agg(F.min(F.struct("ref_pos", "reference")).alias("first"))
    return first.select("patient_id", "pdf_source", "first.reference", "first.ref_pos")
