"""python -m chartloom.cli extract|chat|features|notes: the engine from a command line."""

from __future__ import annotations

import argparse
import glob
import os
import tempfile

from pyspark.sql import SparkSession

from .config import configure_logging
from .operators.definitions import config_name
from .plans.authoring import Authoring
from .plans.extraction import Extraction
from .providers import Generator, entity_library, second_pdf_library
from .sources.sinks import read_csv
from .sources.synthetic import synthetic_notes, write_synthetic_notes


def has_pdf(folder: str) -> bool:
    """Whether a PDF stands in folder or below it; folders without get the synthetic notes, and stay as they are."""
    return os.path.isdir(folder) and any(x.lower().endswith(".pdf") for x in glob.iglob(os.path.join(folder, "**"), recursive=True))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--log-level", default="INFO")
    parser.add_argument("--log-file")
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="extract all features of all patients")
    extract.add_argument("--data-dir", help="a folder of PDF files; without it, synthetic notes are used")
    extract.add_argument("--features", required=True)
    extract.add_argument("--output", default="extracted_data")
    extract.add_argument("--contexts", default="context_data")
    extract.add_argument("--raw", default="raw_context_data")
    extract.add_argument("--collection", default="patient_contexts")
    extract.add_argument("--reset", action="store_true")
    extract.add_argument("--notes-table", help="a table in which converted notes are kept and reused")
    extract.add_argument("--no-cache", action="store_true", help="convert all notes again")
    chat = commands.add_parser("chat", help="answer questions until 'exit'")
    chat.add_argument("--features", required=True)
    chat.add_argument("--collection", default="patient_contexts")
    chat.add_argument("--extracted", default="extracted_data")
    chat.add_argument("--verbose", action="store_true")
    features = commands.add_parser("features", help="propose and save the features of an entity")
    features.add_argument("--base", required=True, help="the JSON file of the features that every entity has")
    features.add_argument("--entity", required=True)
    features.add_argument("--areas", default="")
    features.add_argument("--replies", nargs="+", required=True, help="files that each hold one proposal of a model")
    features.add_argument("--output-dir", default="config")
    notes = commands.add_parser("notes", help="write the synthetic notes")
    notes.add_argument("--output", default=os.path.join(tempfile.gettempdir(), "synthetic-notes"))
    notes.add_argument("--markdown", action="store_true")
    args = parser.parse_args(argv)
    configure_logging(args.log_level, args.log_file)
    spark = SparkSession.builder.appName("chartloom").getOrCreate()
    if args.command == "notes":
        print(write_synthetic_notes(spark, args.output, not args.markdown))
    elif args.command == "extract":
        engine = Extraction(spark, args.features, args.collection, args.reset, finder=entity_library(), second_parser=second_pdf_library(), notes_table=args.notes_table)
        if args.data_dir and has_pdf(args.data_dir):
            wide = engine.run_folder(args.data_dir, args.output, args.contexts, args.raw, use_cache=not args.no_cache)
        else:
            wide = engine.run_notes(synthetic_notes(spark), args.output, args.contexts, args.raw)
        wide.show(truncate=False)
    elif args.command == "features":
        author(Authoring(spark, args.base, FileGenerator(args.replies)), args.entity, args.areas, args.output_dir)
    else:
        converse(spark, Extraction(spark, args.features, args.collection, reset=False), args.extracted, args.verbose)


class FileGenerator(Generator):
    """Proposals from files, one after another."""

    def __init__(self, paths: list[str]):
        self.paths = iter(paths)

    def generate(self, prompt: str) -> str:
        path = next(self.paths, None)
        if path is None:
            raise LookupError("no more proposals")
        with open(path, encoding="utf-8") as file:
            return file.read()


def author(authoring: Authoring, entity: str, areas: str, folder: str, ask=input, say=print) -> str:
    """Batch after batch while "yes" is the answer, then the definitions into the entity's file; its path."""
    batch_number = 0
    while True:
        batch_number += 1
        row = authoring.propose(entity, areas, batch_number).first()
        say(row["error"] or authoring.show())
        if row["error"] or ask("More features? ").strip().lower() not in ("y", "yes"):
            break
    path = os.path.join(folder, config_name(entity))
    say(path if authoring.save(path) else f"{path} couldn't be written")
    return path


def converse(spark: SparkSession, engine: Extraction, extracted: str, verbose: bool, ask=input, say=print) -> None:
    """One question after another, until "exit"."""
    known = read_csv(spark, extracted)
    known = known if known is not None else spark.createDataFrame([], "patient_id string")
    while (question := ask("> ").strip()).lower() != "exit":
        if not question:
            continue
        row = engine.chat(spark.createDataFrame([(0, question)], "question_id int, question string"), known).first()
        say(row["answer"])
        for hit in (row["hits"] or []) if verbose else []:
            say(f"Result {hit['rank']} (score: {hit['score']:.4f})\n{hit['context']}")


if __name__ == "__main__":
    main()
