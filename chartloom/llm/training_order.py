"""Token ids in training order: a keyed permutation of all sequences, written as fixed-stride shards.

Every text becomes its byte-level BPE ids and an end id, cut into sequences of ``length`` ids (the last
one padded).  A scan writes the ids of each text with the number of its first sequence in its
partition; the partitions' running sum then numbers all sequences 0..N-1.  A Feistel network over the next even
power of two, walked until the value is below N, gives each its global slot.  Slots
are dealt to shards by ranges of ``shard_rows``; each shard is one sorted file, made in an array of bounded
size, of records of the same number of bytes, so slot s is at byte (s % shard_rows) * stride of shard s // shard_rows,
and reading goes on from any slot.

The text writer stores the records: it copies a string's bytes as they are and ends each with
one byte, so any store that Spark writes to will do, and its committer sees to lost executors.

Defined results: null and empty texts give one sequence that holds the end id; repeated
rows give sequences of their own; a null id is written as the least long and read as null; a text's
ids, two bytes each, are held by one row, however many; an empty table gives no shard; columns
of docs other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, store, textops
from .textops import U64

LENGTH = 256
SHARD_ROWS = 1 << 15
END_ID = 50256
KEY = 0x5EED0FC0DE
MEMO_PARTS = 100_000
#: Rounds in which shards are made: what a shuffle takes of the disk is divided by it.
ROUNDS = 2
#: Bytes of ids whose records are placed together.
LOT = 4 << 20
_NULL_ID = -(1 << 63)
_NAME = r"from-(\d+)/part-(\d+)-"
_HEADER = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("sequence", "<i4"), ("n_tokens", "<i4")])


class Feistel:
    """A keyed permutation of 0..n-1: four rounds on halves, and cycle-walking into the range."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = textops.mix(np.arange(1, rounds + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) ^ U64(key & (1 << 64) - 1))

    def _once(self, x: np.ndarray) -> np.ndarray:
        mask = U64((1 << self.half) - 1)
        left, right = x >> U64(self.half), x & mask
        for key in self.keys:
            left, right = right, left ^ (textops.mix(right ^ key) & mask)
        return left << U64(self.half) | right

    def slots(self, x: np.ndarray) -> np.ndarray:
        x = self._once(x.astype(np.uint64))
        out = np.flatnonzero(x >= U64(self.n))
        while len(out):
            x[out] = self._once(x[out])
            out = out[x[out] >= U64(self.n)]
        return x.astype(np.int64)


class FlatEncoder:
    """Byte-level BPE ids of a whole Arrow column at once.

    Parts between single spaces are made distinct by Arrow, encoded once, and gathered back.
    """

    _made: dict[tuple[str, str], "FlatEncoder"] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = bpe.read_ranks(path)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.width[list(ranks.values())] = [len(token) for token in ranks]
        # by what stands before a part: its ids, two bytes each
        self.memos: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    @classmethod
    def of(cls, path: str, pattern: str) -> "FlatEncoder":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def _ids(self, parts: list[str], before: str, sizes: np.ndarray | None = None) -> list[bytes]:
        """Ids of parts that stand after ``before``, two bytes each; none where the cut after a part isn't safe.

        sizes: bytes of each part, where there is something before.
        """
        memo = self.memos[before]
        found = list(map(memo.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        good = []
        for i in new:
            part = parts[i]
            if part and not part[-1].isspace():
                good.append(i)
            else:
                found[i] = b""
        if before:
            # joined, the parts are cut at the same places as alone, so one call serves them all
            ids = np.array(self.library.encode_ordinary("".join([before + parts[i] for i in good])), dtype="<u2")
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes[good] + len(before)), side="left") + 1
            held, a = ids.tobytes(), 0
            for i, z in zip(good, (2 * ends).tolist(), strict=True):
                found[i] = held[a:z]
                a = z
        else:
            for i in good:
                found[i] = np.array(self.library.encode_ordinary(parts[i]), dtype="<u2").tobytes()
        if len(memo) < MEMO_PARTS:
            memo.update((parts[i], found[i]) for i in new[: MEMO_PARTS - len(memo)])
        return found

    def _split(self, texts: pa.Array):
        """Parts of all texts: distinct parts' ids, each part's place among them, offsets by text, heads' ids, and which texts the library must see whole."""
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        at = np.asarray(split.offsets).astype(np.int64)
        at -= at[0]
        coded = split.flatten().dictionary_encode()
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        heads = self._ids([distinct[c] for c in code[at[:-1]]], "")
        rests = self._ids(distinct, " ", pc.binary_length(coded.dictionary).to_numpy().astype(np.int64))
        lens = np.fromiter(map(len, rests), np.int64, len(rests)) // 2
        use = lens[code]
        use[at[:-1]] = 0
        unsafe = use == 0
        unsafe[at[:-1]] = False
        whole = np.add.reduceat(unsafe, at[:-1]) > 0
        # a head that ends in white space, or is empty, makes the first cut unsafe, or isn't encoded
        whole |= np.fromiter(map(len, heads), np.int64, len(heads)) == 0
        return rests, lens, code, use, at, heads, whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of the texts."""
        rests, lens, code, use, at, heads, whole = self._split(texts)
        flat = np.frombuffer(b"".join(rests), dtype="<u2")
        starts = np.cumsum(lens) - lens
        ends = np.cumsum(use)
        gathered = flat[np.repeat(starts[code] - (ends - use), use) + np.arange(ends[-1])]
        edge = np.concatenate([[0], ends])[at]
        pieces = []
        for r, head in enumerate(heads):
            if whole[r]:
                pieces.append(np.array(self.library.encode_ordinary(texts[r].as_py() or ""), dtype="<u2").tobytes())
            else:
                pieces.append(head + gathered[edge[r] : edge[r + 1]].tobytes())
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
        return np.frombuffer(b"".join(pieces), dtype="<u2"), np.concatenate([[0], np.cumsum(sizes)])


def stride(length: int = LENGTH) -> int:
    """Bytes of a record: header, ids of two bytes, and the byte that the writer adds."""
    return _HEADER.itemsize + 2 * length + 1


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> int:
    """Write all sequences of docs under path; the number of sequences.

    docs is scanned once; its ids are kept in the shared folder until the shards are written.  The
    shards are made in so many rounds, each of which shuffles only its part of the records.
    """
    spark = docs.sparkSession
    store.ship(spark)
    ranks = ranks or public_tokenizers.path(bpe.VOCABULARY)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, partition, number = FlatEncoder.of(ranks, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in textops.pieces(batch, "_text", 1 << 20):
                ids, at = encoder.encode(part.column("_text"))
                n = (np.diff(at) + length) // length  # ids and one end, rounded up
                first = number + np.cumsum(n) - n
                number += int(n.sum())
                held = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(2 * at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, partition)), pa.array(first), pa.array(n), part.column("doc_id"), held.cast(pa.binary())], ["partition", "first", "n", "doc_id", "ids"])
        textops.settle()

    # texts are encoded once; a partition's rows are numbered as they are written, so a repeated task changes nothing
    encoded = store.materialise(source.mapInArrow(encode, "partition long, first long, n long, doc_id long, ids binary"), "encoded", "zstd")
    found = {r["partition"]: r["n"] for r in encoded.groupBy("partition").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    total, begins = 0, {}
    for partition in sorted(found):
        begins[partition] = total
        total += found[partition]
    if not total:
        return 0
    order = Feistel(total, key)

    def records_of(from_shard: int, to_shard: int):
        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = pa.Codec("zstd", compression_level=1)
            for batch in batches:
                for part in textops.pieces(batch, "ids", LOT):
                    ids, at = textops.text_buffer(part.column("ids"))
                    ids, at = np.frombuffer(ids, dtype="<u2"), at // 2
                    n = part.column("n").to_numpy()
                    row = np.repeat(np.arange(part.num_rows), n)
                    sequence = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                    begin = np.array([begins[x] for x in part.column("partition").to_pylist()], dtype=np.int64) + part.column("first").to_numpy()
                    slot = order.slots(begin[row] + sequence)
                    shard = slot // shard_rows
                    # records by shard; a shard's records of this lot travel together, compressed
                    by = np.argsort(shard, kind="stable")
                    by = by[(shard[by] >= from_shard) & (shard[by] < to_shard)]
                    shard, row, sequence = shard[by], row[by], sequence[by]
                    left = np.diff(at)[row] - sequence * length  # ids from the record's first on; the end follows the last
                    used = np.minimum(left, length)
                    body = np.zeros((len(by), length), dtype="<u2")
                    here = np.arange(length) < used[:, None]
                    place = np.repeat(at[:-1][row] + sequence * length - (np.cumsum(used) - used), used) + np.arange(int(used.sum()))
                    body[here] = ids[place]
                    last = np.flatnonzero(left < length)
                    body[last, left[last]] = END_ID
                    header = np.zeros(len(by), dtype=_HEADER)
                    header["slot"] = slot[by]
                    header["doc_id"] = part.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)[row]
                    header["sequence"] = sequence
                    header["n_tokens"] = np.minimum(left + 1, length)
                    out = np.concatenate([header.view(np.uint8).reshape(len(by), -1), body.view(np.uint8).reshape(len(by), -1)], axis=1)
                    cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                    packs = [out[a:z].tobytes() for a, z in zip(cuts, [*cuts[1:], len(by)], strict=True)]
                    sizes = pa.array([len(x) for x in packs], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(shard[cuts]), sizes, pa.array([codec.compress(x, asbytes=True) for x in packs], pa.binary())], ["shard", "size", "pack"])
            textops.settle()

        return records

    def shard_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, grid, held, first = pa.Codec("zstd"), None, 0, 0
        for batch in batches:
            for shard, size, pack in zip(batch.column("shard").to_pylist(), batch.column("size").to_pylist(), batch.column("pack"), strict=True):
                if grid is None:
                    first = shard * shard_rows
                    grid = np.zeros((min(shard_rows, total - first), stride(length) - 1), dtype=np.uint8)
                rows = np.frombuffer(codec.decompress(pack.as_buffer(), size), np.uint8).reshape(-1, grid.shape[1])
                slots = np.ascontiguousarray(rows[:, : _HEADER.itemsize]).view(_HEADER)["slot"][:, 0]
                grid[slots - first] = rows
                held += len(rows)
        if grid is None or held != len(grid):
            raise RuntimeError("a shard lacks records")
        data = pa.py_buffer(grid.reshape(-1))
        for a in range(0, len(grid), 4096):
            n = min(4096, len(grid) - a)
            fixed = pa.Array.from_buffers(pa.binary(grid.shape[1]), n, [None, data], offset=a)
            yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary())], ["record"])
        textops.settle()

    shards = (total + shard_rows - 1) // shard_rows
    for a in range(0, shards, -(-shards // rounds)):
        z = min(shards, a + -(-shards // rounds))
        placed = encoded.mapInArrow(records_of(a, z), "shard long, size long, pack binary").repartitionById(z - a, (F.col("shard") - a).cast("int"))
        placed.mapInArrow(shard_file, "record binary").select(F.col("record").cast("string")).write.text(f"{path}/from-{a}")
        store.release(spark)
    store.remove(spark, encoded)
    return total


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, from_slot: int = 0, with_ids: bool = True) -> DataFrame:
    """slot, shard, byte_offset, doc_id, sequence, n_tokens, ids_crc32 (and token_ids) from from_slot on, in file order.

    Files of shards that end before from_slot aren't read; within its own shard, reading begins at the slot's byte.
    """
    store.ship(spark)
    schema = "slot long, shard long, byte_offset long, doc_id long, sequence int, n_tokens int, ids_crc32 long" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                grid = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride(length))
                first = max(0, from_slot - shard * shard_rows)
                for a in range(first, len(grid), 8192):
                    rows = grid[a : a + 8192]
                    header = np.ascontiguousarray(rows[:, : _HEADER.itemsize]).view(_HEADER)[:, 0]
                    ids = np.ascontiguousarray(rows[:, _HEADER.itemsize : -1]).view("<u2")
                    n = header["n_tokens"]
                    sums = [zlib.crc32(x[:m].tobytes()) for x, m in zip(ids, n, strict=True)]
                    known = pa.array(header["doc_id"], mask=header["doc_id"] == _NULL_ID)
                    columns = [pa.array(header["slot"]), pa.array(np.full(len(rows), shard)), pa.array((np.arange(len(rows)) + a) * stride(length)), known, pa.array(header["sequence"]), pa.array(n), pa.array(sums, pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x[:m].astype(np.int32) for x, m in zip(ids, n, strict=True)], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "doc_id", "sequence", "n_tokens", "ids_crc32", "token_ids"][: len(columns)])

    wanted = shard_files(spark, path, from_slot // shard_rows)
    if not wanted:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(wanted)
    shard = F.regexp_extract("path", _NAME, 1).cast("long") + F.regexp_extract("path", _NAME, 2).cast("long")
    return files.select(shard.alias("shard"), "content").mapInArrow(run, schema)


def shard_files(spark: SparkSession, path: str, from_shard: int = 0) -> list[str]:
    """The shards under path from from_shard on, in order, by their names alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().toString() for part in files.listStatus(folder) for x in files.listStatus(part.getPath())] if files.exists(folder) else []
    numbered = sorted((int(m[1]) + int(m[2]), x) for x in names if (m := re.search(_NAME, x)))
    return [x for i, x in numbered if i >= from_shard]


def materialise(docs: DataFrame, **more) -> DataFrame:
    """Write the shards to the shared folder and return what they hold, a row for each sequence."""
    spark = docs.sparkSession
    path = store.new_path(spark, "training-order")
    if not write_shards(docs, path, **more):
        return spark.createDataFrame([], "slot long, shard long, byte_offset long, doc_id long, sequence int, n_tokens int, ids_crc32 long")
    kept = {k: more[k] for k in ("length", "shard_rows") if k in more}
    return read_shards(spark, path, with_ids=False, **kept)
