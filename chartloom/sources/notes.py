"""Notes from folders of PDF or Markdown files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_table
from ..operators.redaction import redact_notes
from ..providers import NameFinder, PdfParser
from ..schemas import CONVERTED


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def pdf_files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """path, modificationTime, length (and content) of every PDF below folder; the ending counts in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files if content else files.drop("content")


def with_patients(files: DataFrame, folder: str) -> DataFrame:
    """files with patient_id and pdf_source.

    A folder with any PDF directly in it is one patient, by its own name; otherwise each folder in it is one.
    """
    root = folder.rstrip("/").split("/")[-1]
    inside = F.regexp_extract("path", rf".*?/\Q{root}\E/(.*)$", 1)
    rows = files.withColumn("_inside", inside)
    flat = rows.agg(F.coalesce(F.bool_or(~F.contains("_inside", F.lit("/"))), F.lit(False)).alias("_flat"))
    rows = rows.crossJoin(F.broadcast(flat))  # one row
    patient = F.when(F.col("_flat"), F.lit(root)).otherwise(F.split_part("_inside", F.lit("/"), F.lit(1)))
    return rows.withColumn("patient_id", patient).withColumn("pdf_source", _name(F.col("path"))).drop("_inside", "_flat")


def pdf_to_markdown(files: DataFrame, parser: PdfParser, second: PdfParser | None = None) -> DataFrame:
    """files (without content) with markdown_text and error.

    A heading of the file's name, then each page's heading, text and tables.  A failing parser is followed by the second,
    if there is one; a file that no parser reads has an error and no text.
    """

    @F.pandas_udf("error string, pages array<struct<text:string,tables:array<array<array<string>>>>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            errors, found = [], []
            for content in contents:
                error, pages = None, None
                for p in (x for x in (parser, second) if x is not None):
                    try:
                        pages, error = [{"text": t, "tables": tables} for t, tables in p.pages(bytes(content))], None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                errors.append(error), found.append(pages)
            yield pd.DataFrame({"error": errors, "pages": found})

    # a filter on error would be pushed below and parse every file a second time
    parsed = files.withColumn("_p", parse.asNondeterministic()("content")).drop("content")
    stem = F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", "")
    tables = lambda page: F.array_join(F.transform(F.filter(F.transform(page["tables"], markdown_table), lambda t: t.isNotNull()), lambda t: F.concat(t, F.lit("\n\n"))), "")
    body = lambda page: F.when(F.coalesce(page["text"], F.lit("")) != "", F.concat(page["text"], F.lit("\n\n"))).otherwise("")
    pages = F.transform("_p.pages", lambda page, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), body(page), F.coalesce(tables(page), F.lit(""))))
    return parsed.select(*[c for c in parsed.columns if c != "_p"], F.concat(F.lit("# "), stem, F.lit("\n\n"), F.array_join(pages, "")).alias("markdown_text"), F.col("_p.error").alias("error"))


def readable(notes: DataFrame) -> DataFrame:
    """Notes that were read; one unreadable file costs only itself."""
    return notes.where(F.col("error").isNull()).drop("error")


def not_yet_converted(files: DataFrame, converted: DataFrame) -> DataFrame:
    """Files whose path and modification time aren't among the notes at hand."""
    return files.join(converted.select("path", "modificationTime").distinct(), ["path", "modificationTime"], "left_anti")


def converted_notes(files: DataFrame, parser: PdfParser, second: PdfParser | None = None, finder: NameFinder | None = None, table: str | None = None, use_cache: bool = True) -> DataFrame:
    """The redacted notes of files that could be read: patient_id, pdf_source and markdown_text.

    With a table, notes are appended to it, and those of files whose path and modification time it holds are reused;
    without use_cache all files are converted again.  Of a file's notes, those of the last run count.
    """
    spark = files.sparkSession
    fields = ["path", "modificationTime", "patient_id", "pdf_source", "markdown_text"]
    key = fields[:2]
    if table is None:
        return redact_notes(readable(pdf_to_markdown(files, parser, second)), finder=finder).select(fields[2:])
    if not spark.catalog.tableExists(table):
        spark.createDataFrame([], CONVERTED).write.format("parquet").saveAsTable(table)
    new = not_yet_converted(files, spark.table(table)) if use_cache else files
    made = redact_notes(readable(pdf_to_markdown(new, parser, second)), finder=finder)
    made.select(*fields, F.current_timestamp().alias("converted")).write.mode("append").insertInto(table)
    kept = spark.table(table)
    last = kept.groupBy(*key).agg(F.max("converted").alias("converted")).join(files.select(key), key, "left_semi")
    return kept.join(last, [*key, "converted"], "left_semi").select(fields[2:])


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path and markdown_text of every .md file below folder."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown_text"))


def notes_from_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """patient_id, pdf_source and markdown_text, each .md file standing for the PDF of its name."""
    rows = with_patients(read_markdown(spark, folder), folder)
    return rows.select("patient_id", F.regexp_replace("pdf_source", r"\.md$", ".pdf").alias("pdf_source"), "markdown_text")
