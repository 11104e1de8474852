"""Token counts with ``sentencepiece`` over Arrow batches, returning lengths only.

The model marks a space as the first character of a piece and has no piece with that
mark after another character, so a text is cut before every space that follows
something else; the parts are encoded apart, in batches of about equal bytes, and the
lengths of frequent parts stay in a bounded memo of the worker.

Defined results: null text counts as empty, empty text has no tokens and no bytes,
repeated rows give repeated results, null ids are passed on, the longest texts are counted whole in
parts, an empty table gives an empty one; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textops

MODEL = "piece_bpe_32k.model"
#: Memo entries a worker keeps; this bounds memory only.
MEMO_ENTRIES = 400_000
SPACE_MARK = "▁"
_SAFE_CUT = re.compile(f"(?<=[^ {SPACE_MARK}]) ")
_counters: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts tokens with one model in one process."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            if SPACE_MARK in self.model.id_to_piece(i).lstrip(SPACE_MARK):
                raise ValueError(f"piece {i} of {path} crosses a space, so texts can't be cut there")
        self.memo: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "PieceCounter":
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text between safe cuts; each part stands for itself after one space."""
        if "  " in text or SPACE_MARK in text or text[:1] == " " or text[-1:] == " ":
            return _SAFE_CUT.split(text)
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        split = [self.parts(x) if x else [] for x in texts]
        found = [list(map(self.memo.get, x)) for x in split]
        missing = list({part for x, got in zip(split, found, strict=True) if None in got for part, n in zip(x, got, strict=True) if n is None})
        # an empty part stands for a single space at the end of a text
        fresh = {part: len(ids) if part else 1 for part, ids in zip(missing, self.model.encode(missing, num_threads=1), strict=True)}
        if len(self.memo) + len(fresh) <= MEMO_ENTRIES:
            self.memo.update(fresh)
        return [sum(got) if None not in got else sum(fresh[part] if n is None else n for part, n in zip(x, got, strict=True)) for x, got in zip(split, found, strict=True)]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default doc_id) with n_bytes, n_tokens and over_limit of each whole text."""
    store.ship(docs.sparkSession)
    path, keep = path or public_tokenizers.path(MODEL), keep if keep is not None else ["doc_id"]
    inner = [f"_{i}" for i in range(len(keep))]
    made = ["n_bytes", "n_tokens", "over_limit"]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    source = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, inner, strict=True)), size.alias("n_bytes"), F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(path)
        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                counts = counter.count([x or "" for x in part.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], schema.names)
        textops.settle()

    counted = source.mapInArrow(run, schema)
    return counted.select(*(F.col(x).alias(c) for c, x in zip(keep, inner, strict=True)), *made)
