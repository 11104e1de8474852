"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file becomes a BPE model of that library through the usual byte-to-character
table.  Text is cut before each single space that follows a non-space: no match of
the pre-splitting pattern crosses such a place, so the parts are encoded apart.  The distinct
parts of a lot of texts are found by Arrow and encoded once; a bounded memo in each worker serves the
frequent ones.  Texts with runs of white space at a cut go to the library whole.

Defined results: null text counts as empty, empty text has no ids, repeated rows give
repeated results, null ids are passed on, the longest texts are encoded whole, further columns are
left alone (only the named ones are read, whatever their names), an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, textops

#: Memo entries a worker keeps; later parts are encoded anew, so this bounds memory only.
MEMO_ENTRIES = 200_000
#: Stands for a part that the library must see with its surroundings.
UNSAFE = (0, b"", b"")
#: Parts that one call of the library encodes together.
JOINED = 4096
#: Bytes of text whose distinct parts are encoded once.
LOT = 2 << 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_codecs: dict[tuple[str, str], "ByteCodec"] = {}
textops.KEEPERS.append(_codecs.clear)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def library_tokenizer(ranks: dict[bytes, int], pattern: str):
    """The ranks as a BPE model: every split of a token into two tokens is a merge of its rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    name = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [(name[token[:k]], name[token[k:]]) for token in sorted(ranks, key=ranks.get) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class ByteCodec:
    """Encoder and decoder of one rank file in one process."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.tokenizer = library_tokenizer(ranks, pattern)
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.width = np.array([len(x) for x in self.token_bytes], dtype=np.int64)
        self.decimal = pa.array([b"%d" % i for i in range(len(self.token_bytes))], pa.large_binary())
        self.bytes = pa.array(self.token_bytes, pa.large_binary())
        # by part after a space: number of ids, the ids in decimal, and the bytes they decode to; UNSAFE with none
        self.memo: dict[str, tuple[int, bytes, bytes]] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "ByteCodec":
        """The codec of this process, made once."""
        if (path, pattern) not in _codecs:
            _codecs[path, pattern] = cls(path, pattern)
        return _codecs[path, pattern]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as one call of the library gives them."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of ids; characters split over several ids come together again."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def _finished(self, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """Of each run of ids their number, decimal form and bytes."""
        at, ids = pa.array(offsets.astype(np.int32)), pa.array(ids)
        joined = lambda kept, mark: pc.binary_join(pa.ListArray.from_arrays(at, kept.take(ids)), pa.scalar(mark, pa.large_binary())).to_pylist()
        return list(zip(np.diff(offsets).tolist(), joined(self.decimal, b","), joined(self.bytes, b""), strict=True))

    def _apart(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """As _finished, of texts that are encoded each for itself."""
        found = self.ids(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
        return self._finished(np.fromiter(chain.from_iterable(found), np.int64, int(offsets[-1])), offsets)

    def _spaced(self, parts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """As _finished, of parts that stand after a space; joined they are cut at the same places as alone."""
        out = []
        for a in range(0, len(parts), JOINED):
            some = parts[a : a + JOINED]
            ids = np.array(self.ids(["".join([" " + x for x in some])])[0], dtype=np.int64)
            done = np.cumsum(self.width[ids])
            sizes = np.cumsum([1 + len(x.encode()) for x in some])
            ends = np.searchsorted(done, sizes) + 1
            if (done[np.minimum(ends, len(done)) - 1] != sizes).any():
                raise RuntimeError("an id crosses two parts")
            out += self._finished(ids, np.concatenate([[0], ends]))
        return out

    def _parts(self, parts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """What distinct parts give after a space; UNSAFE where the library must see their surroundings."""
        found = list(map(self.memo.get, parts))
        new = [i for i, x in enumerate(found) if x is None]
        good = [i for i in new if parts[i] and not parts[i][-1].isspace()]
        for i in new:
            found[i] = UNSAFE
        for i, x in zip(good, self._spaced([parts[i] for i in good]), strict=True):
            found[i] = x
        room = MEMO_ENTRIES - len(self.memo)
        self.memo.update((parts[i], found[i]) for i in new[: max(room, 0)])
        return found

    def round_trip(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Of each text the number of ids, the ids in decimal joined by commas, and the bytes they decode to."""
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        at = np.asarray(split.offsets).astype(np.int64)
        at -= at[0]
        coded = split.flatten().dictionary_encode()
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        heads = code[at[:-1]]
        rests = np.ones(len(code), dtype=bool)
        rests[at[:-1]] = False
        # only parts that stand after a space are encoded as such
        used = np.bincount(code[rests], minlength=len(distinct)).nonzero()[0].tolist()
        values = [UNSAFE] * len(distinct)
        for i, x in zip(used, self._parts([distinct[i] for i in used]), strict=True):
            values[i] = x
        first = np.unique(heads)
        values += self._apart([distinct[i] for i in first.tolist()])
        ends_open = np.array([not distinct[i] or distinct[i][-1].isspace() for i in first.tolist()], dtype=bool)
        code[at[:-1]] = len(distinct) + np.searchsorted(first, heads)
        n = np.fromiter((x[0] for x in values), np.int64, len(values))
        unsafe = rests & (n[code] == 0)
        whole = np.add.reduceat(unsafe, at[:-1]) > 0
        # a head that is empty or ends in white space makes the first cut unsafe, if there is one
        whole |= (np.diff(at) > 1) & ends_open[np.searchsorted(first, heads)]
        counts = np.add.reduceat(n[code], at[:-1])
        offsets, take = pa.array(at.astype(np.int32)), pa.array(code)
        joined = lambda kept, mark: pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(kept, pa.large_binary()).take(take)), pa.scalar(mark, pa.large_binary())).to_pylist()
        decimal, decoded = joined([x[1] for x in values], b","), joined([x[2] for x in values], b"")
        seen = np.flatnonzero(whole).tolist()
        for r, x in zip(seen, self._apart([texts[r].as_py() or "" for r in seen]), strict=True):
            counts[r], decimal[r], decoded[r] = x
        return counts, decimal, decoded


def _codec_path(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "token_ids", offsets: str = "byte_offsets") -> DataFrame:
    """docs with the ids of the whole text and the byte at which each id begins; a column of either name is replaced."""
    store.ship(docs.sparkSession)
    path, kept = _codec_path(path), [c for c in docs.columns if c not in (ids, offsets)]
    inner = [f"_{i}" for i in range(len(kept))]
    source = docs.select(*(F.col(c).alias(x) for c, x in zip(kept, inner, strict=True)), F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("_ids", T.ArrayType(T.IntegerType())).add("_begins", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec.of(path, pattern)
        width = codec.width
        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                found = codec.ids([x or "" for x in part.column("_text").to_pylist()])
                begins = [np.cumsum(width[x]) - width[x] if x else [] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int32()))], schema.names)

    coded = source.mapInArrow(run, schema)
    return coded.select(*(F.col(x).alias(c) for c, x in zip(kept, inner, strict=True)), F.col("_ids").alias(ids), F.col("_begins").alias(offsets))


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of its ids; bytes that form no character become U+FFFD, null ids give null."""
    store.ship(encoded.sparkSession)
    path, kept = _codec_path(path), [c for c in encoded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec.of(path, pattern)
        for batch in batches:
            texts = [None if x is None else codec.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, out])

    return encoded.select(kept).mapInArrow(run, encoded.select(kept).schema.add(out, "string"))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return counts and digests.

    keep: the columns that are passed on (default doc_id).  Adds n_tokens, ids_sha256
    (of the decimal ids joined by commas) and decoded_sha256 (of the decoded bytes).
    """
    store.ship(docs.sparkSession)
    path, keep = _codec_path(path), keep if keep is not None else ["doc_id"]
    inner = [f"_{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, inner, strict=True)), F.col(text).alias("_text"))
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    schema = source.drop("_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec.of(path, pattern)
        for batch in batches:
            for part in textops.pieces(batch, "_text", LOT):
                counts, decimal, decoded = codec.round_trip(part.column("_text"))
                sha = lambda found: pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts), sha(decimal), sha(decoded)], schema.names)
        textops.settle()

    coded = source.mapInArrow(run, schema)
    return coded.select(*(F.col(x).alias(c) for c, x in zip(keep, inner, strict=True)), *made)
