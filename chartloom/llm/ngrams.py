"""n-gram keys, counts by key, and sums of weights over the n-grams of each text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import blooms, store, textops
from .textops import U64

BEGIN, END = U64(0x7C0FFEE123456789), U64(0x1EAF5EED98765431)
_NEXT = U64(0xD1342543DE82EF95)
#: Tokens that a task combines before it sends counts on; a bound on its memory.
COMBINE = 1_500_000
#: What a lot of texts asks of a shard: arrays as bytes, of the text of each ask, its key, level and, for level 0, its word.
ASKS = T.StructType().add("shard", "integer").add("at", "binary").add("key", "binary").add("level", "binary").add("word", "binary")
#: Keys whose weights every worker holds; the rest meet theirs in a join.
HOT_KEYS = 1 << 20


def chain(tokens: list[np.ndarray]) -> np.ndarray:
    """The key of n-grams by their tokens, the last one first."""
    key = tokens[0]
    for token in tokens[1:]:
        key = textops.mix(key * _NEXT + token)
    return key


@dataclass
class Stream:
    """The predicted tokens of some texts: words, then one end for each text."""

    padded: np.ndarray
    at: np.ndarray  # of each predicted token in padded
    rows: np.ndarray  # offsets by text

    def grams(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """The key of the n tokens that end at each predicted one, or at the places ``at``."""
        at = self.at if at is None else at
        return chain([self.padded[at - i] for i in range(n)])

    def events(self, n: int) -> np.ndarray:
        return self.grams(n)


def stream(texts: pa.Array, order: int) -> Stream:
    words, rows = textops.word_hashes(*textops.text_buffer(texts))
    n_rows = len(rows) - 1
    padded = np.full(len(words) + n_rows * order, BEGIN, dtype=np.uint64)
    word_at = np.arange(len(words)) + textops.spread(rows) * order + order - 1
    end_at = rows[1:] + np.arange(n_rows) * order + order - 1
    padded[word_at], padded[end_at] = words, END
    at = np.empty(len(words) + n_rows, dtype=np.int64)
    at[np.arange(len(words)) + textops.spread(rows)] = word_at
    at[rows[1:] + np.arange(n_rows)] = end_at
    return Stream(padded, at, rows + np.arange(n_rows + 1))


def combined(batches: Iterator[pa.RecordBatch], column: str, order: int, columns: Callable[[Stream], list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` of each distinct key, with its number ``n`` of tokens, by task-sized lots.

    columns(stream): the keys, then what else is named; without further names the keys themselves are given.
    """
    lots, held = [], 0

    def flush() -> pa.RecordBatch:
        all_of = [np.concatenate(x) for x in zip(*lots, strict=True)]
        lots.clear()
        if len(all_of) == 1:  # sorted in place
            keys = all_of.pop()
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            out, n = [keys[first]], np.diff(first, append=len(keys))
        else:
            _, first, n = np.unique(all_of[0], return_index=True, return_counts=True)
            out = [x[first] for x in all_of[1:]]
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in out), pa.array(n.astype(np.int64))], [*names, "n"])

    try:
        for batch in batches:
            for part in textops.pieces(batch, column):
                lots.append(columns(stream(part.column(column), order)))
                held += len(lots[-1][0])
                if held >= COMBINE:
                    yield flush()
                    held = 0
        if held:
            yield flush()
    finally:
        textops.settle()


def count_keys(docs: DataFrame, columns: Callable[[Stream], list[np.ndarray]], order: int = 1, text: str = "text") -> DataFrame:
    """key and n of the n-grams that columns(stream) names, over all docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return combined(batches, "_text", order, columns, ["key"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


#: n-grams that a group of keys has about, and rows that are summed at once; bounds on a task's memory.
GROUP, SUM_AT = 1 << 20, 1 << 22
#: Keys in a cell of bytes, and cells in a batch: large ones cost the JVM's heap more than they hold.
CELL, CELLS = 1 << 13, 32
#: Tasks that groups are dealt to; a task takes one group after another.
MOST_TASKS = 20_000


def count_keys_packed(docs: DataFrame, columns: Callable[[Stream], list[np.ndarray]], order: int, text: str, n_grams: int) -> DataFrame:
    """As count_keys, for about n_grams n-grams of which most are rare.

    Each lot's keys, sorted as they are, travel as bytes, cut by group, and are summed group by group: no row for each key.
    """
    groups = max(1, n_grams // GROUP)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in combined(batches, "_text", order, columns, ["key"]):
            for at in range(0, lot.num_rows, CELL * CELLS):
                some = lot.slice(at, CELL * CELLS)
                keys, n = some.column("key").to_numpy().view(np.uint64), some.column("n").to_numpy().astype(np.uint32)
                group = (((keys >> U64(32)) * U64(groups)) >> U64(32)).astype(np.int64)
                cuts = np.union1d(np.flatnonzero(np.diff(group, prepend=-1)), np.arange(0, len(group), CELL))
                ranges = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)], strict=True))
                cut = lambda x: pa.array([x[a:z].tobytes() for a, z in ranges], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(group[cuts].astype(np.int32)), cut(keys), cut(n)], ["group", "key", "n"])

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(keys)
        keys, n = keys[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = -1, [], 0

        def give() -> Iterator[pa.RecordBatch]:
            keys, n = summed(parts)
            parts.clear()
            for a in range(0, len(keys), CELL * CELLS):
                z = a + CELL * CELLS
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:z].view(np.int64)), pa.array(n[a:z])], ["key", "n"])

        for batch in batches:
            for group, key, n in zip(*(batch.column(c) for c in ("group", "key", "n")), strict=True):
                if group.as_py() != now:
                    if parts:
                        yield from give()
                    now, parts, held = group.as_py(), [], 0
                parts.append((np.frombuffer(key.as_py(), np.uint64), np.frombuffer(n.as_py(), np.uint32).astype(np.int64)))
                held += len(parts[-1][0])
                if held > SUM_AT:
                    parts, held = [summed(parts)], 0
        if parts:
            yield from give()
        textops.settle()

    packed = docs.select(F.col(text).alias("_text")).mapInArrow(pack, "group int, key binary, n binary")
    return packed.repartition(min(groups, MOST_TASKS), "group").sortWithinPartitions("group").mapInArrow(merge, "key long, n long")


#: Steps in which a class of equally common keys is taken in part.
SHARE = 1 << 20


def share(key: Column | np.ndarray):
    """A number below SHARE that a key is dealt, from its middle bits; of a column or an array."""
    if isinstance(key, Column):
        return F.shiftrightunsigned(key, 22).bitwiseAND(SHARE - 1)
    return (key.view(np.uint64) >> U64(22)) & U64(SHARE - 1)


@dataclass
class Common:
    """The commonest rows of a table of counts."""

    chosen: Column  # over key and n
    all: bool
    least: int  # of a class taken in part, or of the last one taken whole: its least count
    below: int  # keys of that class with a share below this are taken

    @property
    def settles_absent(self) -> Callable[[np.ndarray], np.ndarray]:
        """Tells of each key whether it can't be in the table at all if it isn't among the chosen."""
        below = U64(SHARE if self.all else self.below if self.least == 1 else 0)
        return lambda keys: share(keys) < below


def commonest(counts: DataFrame, most: int, cost: Callable[[int], int] = lambda n: 1) -> Common:
    """The commonest rows (key, n) of counts that cost at most ``most`` together.

    Found from a histogram with four steps an octave, so its size doesn't grow with the keys; of the
    last step, the keys with a low enough share.
    """
    step = F.floor(F.log2("n") * 4).cast("int")
    room, chosen = most, F.lit(False)
    for row in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("n").alias("n")).collect(), key=lambda r: -r["s"]):
        need = row["k"] * cost(row["n"])
        if need > room:
            below = SHARE * room // need * 97 // 100  # shares aren't dealt quite evenly
            return Common(chosen | ((step == row["s"]) & (share(F.col("key")) < below)), False, row["least"], below)
        room -= need
        chosen = step >= row["s"]
    return Common(F.lit(True), True, 1, SHARE)


def additive_scores(docs: DataFrame, table: DataFrame, order: int, keys: Callable[[Stream], list[tuple[np.ndarray, np.ndarray]]], text: str, keep: list[str], hot_keys: int = HOT_KEYS, extra: Callable[[Stream], tuple[np.ndarray, list[dict]]] | None = None, answer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """keep with n_tokens, total and found (and extra) of each text of docs.

    table: key, n (how common it is) and w, distinct by key.  keys(stream) gives arrays of keys with their offsets by text.
    total sums w, and found counts, over those keys of the text that are in table.  The weights
    of the commonest keys, hot_keys at most, are broadcast; other keys that a bit array of bounded size
    can't rule out are written with their row and meet their weights in a join, each key being
    rare there.

    extra gives a number for each text and, by shard, what it had to leave open (ASKS, with ``at`` the texts);
    answer makes of the open (_row and ASKS) the numbers (_row, t) that are added to it.
    """
    spark = docs.sparkSession
    common = commonest(table, hot_keys).chosen
    hot = table.where(common).select("key", "w").toArrow()
    rest = table.where(~common)
    width = blooms.bit_width(rest.count())
    bits = blooms.fill(rest, width, ["key"])
    index_id = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((hot.column("key").to_numpy().view(np.uint64), hot.column("w").to_numpy(), bits))
    # numbers and what else the scan itself adds must not depend on the names in docs
    source = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("_row", "long").add("n_tokens", "long").add("_total", "double").add("_found", "long").add("_rest", T.ArrayType(T.LongType()))
    if extra:
        schema = schema.add("_extra", "double").add("_asks", T.ArrayType(ASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, weights, bits = sent.value
        index, row = textops.KeyIndex.once(index_id, hot_keys), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                s = stream(part.column("_text"), order)
                total, found = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                left: list[np.ndarray] = []
                for key, rows in keys(s):
                    at = index.find(key)
                    total += textops.by_row(np.where(at >= 0, weights[at] if len(weights) else 0.0, 0.0), rows)
                    found += textops.by_row((at >= 0).astype(np.int64), rows)
                    other = np.flatnonzero(at < 0)
                    other = other[blooms.contains(bits, key[other], width)]
                    left.append(np.stack([np.searchsorted(rows, other, side="right") - 1, key[other].view(np.int64)]))
                left_all = np.concatenate(left, axis=1)
                by = np.argsort(left_all[0], kind="stable")
                offsets = np.searchsorted(left_all[0][by], np.arange(part.num_rows + 1))
                rest_keys = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(left_all[1][by]))
                numbers = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                columns = [*part.columns[:-1], numbers, pa.array(np.diff(s.rows)), pa.array(total), pa.array(found), rest_keys]
                if extra:
                    more, asks = extra(s)
                    # a part's first text carries what all of them ask
                    columns += [pa.array(more), pa.array([asks] + [None] * (part.num_rows - 1), pa.list_(to_arrow_type(ASKS)))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        textops.settle()

    scanned = store.materialise(source.mapInArrow(run, schema), "scores")
    sent.destroy()
    store.release(spark)
    late = scanned.select("_row", F.explode("_rest").alias("key")).join(rest.select("key", "w"), "key")
    late = late.groupBy("_row").agg(F.sum("w").alias("_w"), F.count("*").alias("_k"))
    if answer:
        open_asks = scanned.where("_asks is not null").select("_row", F.explode("_asks").alias("_ask")).select("_row", "_ask.*")
        late = late.join(answer(open_asks).groupBy("_row").agg(F.sum("t").alias("_t")), "_row", "full")
    names = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    total, found = F.col("_total") + F.coalesce("_w", F.lit(0.0)), F.col("_found") + F.coalesce("_k", F.lit(0))
    out = [*names, "n_tokens", total.alias("total"), found.alias("found")]
    if extra:
        out.append((F.col("_extra") + F.coalesce("_t", F.lit(0.0)) if answer else F.col("_extra")).alias("extra"))
    return scanned.drop("_rest", "_asks").join(late, "_row", "left").select(*out)
