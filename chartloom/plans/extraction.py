"""The whole extraction: notes and definitions in, one wide row for each patient out."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cascade import answer_cascade, cascade_prompts
from ..operators.chat import answer_questions, detect_entity, entity_ids
from ..operators.contexts import extract_contexts
from ..operators.matrix import result_grid, wide_rows, with_clean_values
from ..operators.redaction import redact_notes
from ..operators.resolution import claim_once, distinct_references, resolve_references
from ..providers import Answerer, Embedder, HashingEmbedder, NameFinder, PdfParser, SnippetAnswerer, pdf_library
from ..sources import collections, sinks
from ..sources.features import load_features
from ..sources.notes import converted_notes, pdf_files, with_patients

log = logging.getLogger(__name__)


@dataclass
class Extraction:
    """Settings of an extraction.  Inputs are never changed; results go where the caller says."""

    spark: SparkSession
    features: str | list[dict]
    collection: str = "patient_contexts"
    reset: bool = True
    embedder: Embedder = field(default_factory=HashingEmbedder)
    answerer: Answerer = field(default_factory=SnippetAnswerer)
    finder: NameFinder | None = None
    parser: PdfParser | None = None
    second_parser: PdfParser | None = None
    notes_table: str | None = None
    default_reference: str = ""
    search_reference: str = "summary"

    def __post_init__(self) -> None:
        self.definitions = load_features(self.spark, self.features)

    def referenced_notes(self, notes: DataFrame, redacted: bool = False) -> DataFrame:
        """Redacted notes that a reference stands for, each under the first one; redacted: they are already."""
        labels = distinct_references(self.definitions, self.default_reference)
        claimed = claim_once(resolve_references(notes.select("patient_id", "pdf_source").distinct(), labels))
        used = notes.join(claimed, ["patient_id", "pdf_source"])
        return used if redacted else redact_notes(used, finder=self.finder)

    def ingest(self, notes: DataFrame, context_csv: str | None = None, raw_csv: str | None = None, redacted: bool = False) -> DataFrame:
        """Snippets of all patients into the collection, before any answer is asked for."""
        referenced = self.referenced_notes(notes, redacted)
        found = collections.with_ids(extract_contexts(referenced.select("patient_id", "pdf_source", "reference", "markdown_text"), self.definitions), self.embedder)
        collections.open_collection(self.spark, self.collection, self.reset)
        collections.add_contexts(found, self.collection)
        stored = self.spark.table(self.collection)
        if context_csv:
            sinks.save_contexts(stored, context_csv, "overwrite")
        if raw_csv:
            sinks.save_raw_notes(referenced, raw_csv, "overwrite")
        return stored

    def answers(self, patients: DataFrame) -> DataFrame:
        """patient_id, feature_name, pos, value_raw, value and clean_error for every patient and feature."""
        grid = result_grid(patients, self.definitions)
        asked = cascade_prompts(grid, self.spark.table(self.collection), self.embedder, self.search_reference)
        return with_clean_values(answer_cascade(asked, self.answerer)).select("patient_id", "feature_name", "pos", "value_raw", "value", "clean_error")

    def run_notes(self, notes: DataFrame, output_csv: str | None = None, context_csv: str | None = None, raw_csv: str | None = None, redacted: bool = False) -> DataFrame:
        """The wide table of all patients in notes; values as the CSV has them."""
        self.ingest(notes, context_csv, raw_csv, redacted)
        names = [r["name"] for r in self.definitions.orderBy("pos").select("name").collect()]
        wide = wide_rows(self.answers(notes.select("patient_id").distinct()), names)
        if output_csv:
            sinks.save_results(wide, output_csv, "overwrite")
        return wide

    def run_folder(self, folder: str, output_csv: str | None = None, context_csv: str | None = None, raw_csv: str | None = None, use_cache: bool = True) -> DataFrame:
        """As run_notes, for the PDF files below a folder.

        With notes_table, redacted notes are kept there, and only files that are new or changed are
        parsed; without use_cache, all are parsed again, and the new notes count from then on.
        """
        parser = self.parser or pdf_library()
        if parser is None:
            raise RuntimeError("reading PDF files needs a parser; none is installed or given")
        files = with_patients(pdf_files(self.spark, folder), folder)
        notes = converted_notes(files, parser, self.second_parser, self.finder, self.notes_table, use_cache)
        return self.run_notes(notes, output_csv, context_csv, raw_csv, redacted=True)

    def clear_notes(self) -> None:
        """Forget the notes that were kept."""
        if self.notes_table:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.notes_table}`")

    def chat(self, questions: DataFrame, extracted: DataFrame) -> DataFrame:
        """Answers to question_id and question; patients are found by their ids in the questions."""
        found = detect_entity(questions, entity_ids(extracted))
        return answer_questions(found, self.spark.table(self.collection), self.embedder, self.answerer)


def context_count(stored: DataFrame) -> DataFrame:
    """Snippets by patient and by file."""
    return stored.groupBy("patient_id", "pdf_source").agg(F.count("*").alias("n_contexts"))
