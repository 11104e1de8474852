"""Name redaction of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_candidates, redact
from ..providers import NameFinder


def redact_notes(notes: DataFrame, text: str = "markdown_text", mode: str = "compat", finder: NameFinder | None = None) -> DataFrame:
    """notes with their candidate names replaced; further names from finder, if there is one."""
    extra = finder.column(F.col(text)) if finder else None
    return notes.withColumn(text, redact(F.col(text), name_candidates(F.col(text), mode, extra)))
