"""Interpolated modified Kneser-Ney models of up to three words, counted and asked in groups of packed n-grams.

An n-gram is dealt by its last word but one, its middle word: then its count, its context and the pair it backs off
to stand in one group, and only the probabilities of single words come from elsewhere.  n-grams travel in cells:
the hashes of a cell's words once, each word of an n-gram as its number among them, compressed.  No row of a
table stands for one n-gram, and a group is counted and asked by array arithmetic.

A text's log-probability is that of its words alone, known to the scan or by a join (ngrams.additive_scores), plus
what the groups add for each predicted word, summed by text:

    log p(w | u v) - log p(w)        if the model holds u v w
    log backoff(u v) + ...           else, if it holds the context u v
    ... log p(w | v) - log p(w)      if it holds v w
    ... log backoff(v)               else, if it holds the context v
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams, store, textops
from .textops import U64

#: Bytes of the model's texts for each group, and the groups that smaller models have, of SMALL_BYTES at least.
GROUP_BYTES, SMALL_GROUPS, SMALL_BYTES = 6 << 20, 48, 1 << 18
#: n-grams that a task packs at a time, of a cell at most, and that are held before a group's are summed; bounds on memory.
LOT, CELL, SUM_AT = 1 << 20, 1 << 17, 1 << 22
#: n-grams of a group that are worked on at a time, and more where one middle word has more.
SLICE = 1 << 17
#: Tasks that groups are dealt to; a task takes one group after another.
MOST_TASKS = 20_000
#: Kinds of rows, in the order in which a group reads them.
PROBABILITY, MODEL, ASKS, WORDS, COUNTS = range(5)
PACKED = "group int, kind int, at int, data binary"


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Integer arrays in as few bytes each as they need, byte by byte of all numbers, compressed."""
    head, body = [len(arrays)], []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
        head += [len(x), width]
        body.append(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())
    body = b"".join(body)
    return np.array([len(body), *head], np.int64).tobytes() + pa.compress(body, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    size, n = np.frombuffer(data, np.int64, 2).tolist()
    sizes = np.frombuffer(data, np.int64, 2 * n, 16).reshape(-1, 2).tolist()
    body, at, out = pa.decompress(data[16 + 16 * n :], size, "zstd", asbytes=True), 0, []
    for length, width in sizes:
        planes = np.frombuffer(body, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += length * width
    return out


@dataclass
class Grams:
    """n-grams by the numbers of their words in ``words``, sorted hashes: the middle one, the one before, the predicted one."""

    words: np.ndarray
    middle: np.ndarray
    before: np.ndarray
    last: np.ndarray

    def packed(self, *more: np.ndarray) -> bytes:
        """A cell of these n-grams, sorted by their middle word, and arrays beside."""
        steps = np.diff(self.words, prepend=U64(0))
        return _pack([steps, np.diff(self.middle, prepend=self.middle.dtype.type(0)), self.before, self.last, *more])

    @staticmethod
    def unpacked(data: bytes) -> tuple["Grams", list[np.ndarray]]:
        steps, middle, before, last, *more = _unpack(data)
        ids = lambda x: x.astype(np.uint32)
        return Grams(np.cumsum(steps, dtype=np.uint64), np.cumsum(middle, dtype=np.uint32), ids(before), ids(last)), more

    def part(self, at: slice | np.ndarray) -> "Grams":
        """Those at some places, with their words alone."""
        three = [x[at] for x in (self.middle, self.before, self.last)]
        used, ids = np.unique(np.concatenate(three), return_inverse=True)
        return Grams(self.words[used], *(x.astype(np.uint32) for x in np.split(ids.reshape(-1), 3)))

    def sorted_by(self) -> np.ndarray:
        """The order by middle word, word before and last word."""
        bits = len(self.words).bit_length()
        if 3 * bits > 64:
            return np.lexsort((self.last, self.before, self.middle))
        wide = self.middle.astype(np.uint64)
        for x in (self.before, self.last):
            wide <<= U64(bits)
            wide |= x
        return np.argsort(wide)

    def take(self, by: slice | np.ndarray) -> "Grams":
        return Grams(self.words, self.middle[by], self.before[by], self.last[by])

    def __len__(self) -> int:
        return len(self.last)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_changes(x)]


def _of_hashes(three: list[np.ndarray]) -> Grams:
    """three: hashes by n-gram; the list is emptied, since a lot's arrays fill most of a worker's memory."""
    words = _distinct(np.concatenate([_distinct(x) for x in three]))
    return Grams(words, *(np.searchsorted(words, three.pop(0)).astype(np.uint32) for _ in range(3)))


def _joined(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Each column's arrays as one; those held are let go, column by column."""
    out = []
    for x in held:
        out.append(np.concatenate(x))
        x.clear()
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _together(parts: list[Grams]) -> Grams:
    """The n-grams of all parts, one after the other."""
    if len(parts) == 1:
        return parts[0]
    words = np.unique(np.concatenate([x.words for x in parts]))
    ids = [np.searchsorted(words, x.words).astype(np.uint32) for x in parts]
    return Grams(words, *(np.concatenate([i[getattr(x, name)] for i, x in zip(ids, parts, strict=True)]) for name in ("middle", "before", "last")))


def _counted(parts: list[tuple[Grams, np.ndarray]]) -> tuple[Grams, np.ndarray]:
    """Each distinct n-gram of all parts, sorted, and the sum of its counts; parts is emptied."""
    grams, n = _together([g for g, _ in parts]), np.concatenate([n for _, n in parts])
    parts.clear()
    by = grams.sorted_by()
    grams, n = grams.take(by), n[by]
    first = _changes(grams.middle, grams.before, grams.last)
    return grams.take(first), np.add.reduceat(n, first) if len(first) else n


def _slices(middle: np.ndarray) -> Iterator[slice]:
    """Ranges of sorted middle words of about SLICE n-grams that part no word."""
    first, at = _changes(middle), 0
    while at < len(middle):
        next_ = int(np.searchsorted(first, at + SLICE))
        to = int(first[next_]) if next_ < len(first) else len(middle)
        yield slice(at, to)
        at = to


def _group_of(words: np.ndarray, groups: int) -> np.ndarray:
    """The group of a middle word, which doesn't fall as its hash rises."""
    return (((words >> U64(32)) * U64(groups)) >> U64(32)).astype(np.int32)


def _cells(grams: Grams, groups: int) -> Iterator[tuple[int, slice]]:
    """The groups that sorted n-grams belong to, and their places there, in bounded ranges."""
    of = _group_of(grams.words, groups)[grams.middle]
    cuts = [*_changes(of).tolist(), len(of)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        for at in range(a, z, CELL):
            yield int(of[at]), slice(at, min(at + CELL, z))


def _hashes(s: ngrams.Stream, order: int) -> list[np.ndarray]:
    """Middle word, word before and predicted word at each place; a model of pairs has no word before."""
    before = s.padded[s.at - 2] if order > 2 else np.full(len(s.at), ngrams.BEGIN)
    return [s.padded[s.at - 1], before, s.padded[s.at]]


def _row(group: int, kind: int, at: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([kind], pa.int32()), pa.array([at], pa.int32()), pa.array([data], pa.binary())], ["group", "kind", "at", "data"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Slices of batches that are of one group and kind."""
    for batch in batches:
        if batch.num_rows:
            group, kind = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            cuts = [*_changes(group, kind).tolist(), batch.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(group[a]), int(kind[a]), batch.slice(a, z - a)


@dataclass
class Pairs:
    """The distinct pairs (middle, last) of a group, sorted, and their adjusted counts."""

    of: np.ndarray  # the pair of each n-gram
    middle: np.ndarray
    last: np.ndarray
    a: np.ndarray

    @staticmethod
    def under(grams: Grams, n: np.ndarray, order: int) -> "Pairs":
        keys, of, kinds = np.unique((grams.middle.astype(np.uint64) << U64(32)) | grams.last, return_inverse=True, return_counts=True)
        of, middle, last = of.reshape(-1), (keys >> U64(32)).astype(np.uint32), keys.astype(np.uint32)
        plain = np.bincount(of, n, len(keys)).astype(np.int64)
        # continuation counts, but plain counts for what follows a text's begin: nothing stands before that
        return Pairs(of, middle, last, plain if order == 2 else np.where(grams.words[middle] == ngrams.BEGIN, plain, kinds))


def _of_small(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def count(trusted: DataFrame, order: int, text: str, groups: int) -> DataFrame:
    """The counts of the model by group: cells of n-grams with counts, words (continuation and plain counts), counts of counts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[], [], []], 0
        textops.lighten()

        def flush() -> Iterator[pa.RecordBatch]:
            grams = _of_hashes(_joined(held))
            grams = grams.take(grams.sorted_by())
            first = _changes(grams.middle, grams.before, grams.last)
            grams, n = grams.take(first), np.diff(first, append=len(grams))
            for group, at in _cells(grams, groups):
                yield _row(group, MODEL, 0, grams.part(at).packed(n[at]))

        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                for column, x in zip(held, _hashes(ngrams.stream(part.column("_text"), order), order), strict=True):
                    column.append(x)
                size += len(held[0][-1])
                if size >= LOT:
                    yield from flush()
                    size = 0
        if held[0]:
            yield from flush()
        textops.settle()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = -1, [], 0

        def give() -> Iterator[pa.RecordBatch]:
            grams, n = _counted(parts)
            for i, (_, at) in enumerate(_cells(grams, groups)):
                yield _row(now, MODEL, i, grams.part(at).packed(n[at]))
            kinds, plain = (np.zeros(len(grams.words), np.int64) for _ in range(2))
            small = np.zeros(4, np.int64)
            for at in _slices(grams.middle):
                pairs = Pairs.under(grams.take(at), n[at], order)
                kinds += np.bincount(pairs.last, minlength=len(kinds))
                plain += np.bincount(grams.last[at], n[at], len(plain)).astype(np.int64)
                small += _of_small(pairs.a)
            here = np.flatnonzero(kinds)
            for a in range(0, len(here), CELL):
                some = here[a : a + CELL]
                yield _row(now, WORDS, a // CELL, _pack([grams.words[some], kinds[some], plain[some]]))
            yield _row(now, COUNTS, 0, _pack([np.array([*small, *_of_small(n)])]))

        for group, _, rows in _runs(batches):
            if group != now:
                if parts:
                    yield from give()
                now, held = group, 0
            for data in rows.column("data"):
                grams, (n,) = Grams.unpacked(data.as_py())
                parts.append((grams, n.astype(np.int64)))
                held += len(n)
                if held > SUM_AT:
                    parts[:] = [_counted(parts)]
                    held = 0
        if parts:
            yield from give()
        textops.settle()

    packed = trusted.select(F.col(text).alias("_text")).mapInArrow(pack, PACKED)
    return packed.repartition(min(2 * groups, MOST_TASKS), "group").sortWithinPartitions("group").mapInArrow(merge, PACKED)


def _discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the counts of counts; 0.5, 1 and 1.5 where these are too few."""
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(m - (m + 1) * y * n[m] / n[m - 1], 0.05), m - 0.05) for m in (1, 2, 3)]


def _kept(d: list[float], a: Column | np.ndarray):
    """What is taken off counts; of a column or an array."""
    if isinstance(a, Column):
        return F.when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])
    return np.array([0.0, *d])[np.minimum(a, 3)]


@dataclass
class Model:
    """What a model is asked by; made by fit, and gone with remove."""

    order: int
    groups: int
    cells: DataFrame | None  # PACKED; a model of single words has none
    words: DataFrame  # key, n and w: log10 of a word's probability above that of an unknown one
    unknown: float  # log10 of that
    discounts: dict[int, list[float]]

    def remove(self) -> None:
        store.remove(self.words.sparkSession, *([self.cells] if self.cells else []), self.words)


def _rows_of_words(cells: DataFrame, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """group, key, a and n of the words in cells, those that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, data in zip(batch.column("group").to_pylist(), batch.column("data"), strict=True):
                words, a, n = _unpack(data.as_py())
                at = wanted(words) if wanted else np.arange(len(words))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group, np.int32)), pa.array(words[at].astype(np.uint64).view(np.int64)), pa.array(a[at].astype(np.int64)), pa.array(n[at].astype(np.int64))], ["group", "key", "a", "n"])

    return cells.where(F.col("kind") == WORDS).select("group", "data").mapInArrow(run, "group int, key long, a long, n long")


def fit(trusted: DataFrame, order: int, text: str, size: int | None = None) -> Model:
    """A model of all texts of trusted, of up to three words.  size: their bytes, where known."""
    if order not in (1, 2, 3):
        raise ValueError(f"a model of 1 to 3 words, not {order}")
    spark = trusted.sparkSession
    if size is None:
        size = bytes_of(trusted, text)
    groups, cells, discounts = max(min(SMALL_GROUPS, 1 + size // SMALL_BYTES), size // GROUP_BYTES), None, {}
    if order == 1:
        counts = ngrams.count_keys(trusted, lambda s: [s.grams(1)], 1, text).withColumn("a", F.col("n"))
    else:
        cells = store.materialise(count(trusted, order, text, groups), "grams")
        store.release(spark)
        found = [_unpack(r["data"])[0] for r in cells.where(F.col("kind") == COUNTS).select("data").collect()]
        small = np.sum([np.asarray(x, np.int64) for x in found] or [np.zeros(8, np.int64)], axis=0).tolist()
        discounts = {2: _discounts(small[:4]), 3: _discounts(small[4:])}
        counts = _rows_of_words(cells).groupBy("key").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    first = store.materialise(counts, "counts")
    small = {r["a"]: r["k"] for r in first.where("a <= 4").groupBy("a").agg(F.count("*").alias("k")).collect()}
    d = discounts[1] = _discounts([small.get(i, 0) for i in range(1, 5)])
    sums = first.agg(F.count("*").alias("v"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum(_kept(d, F.col("a"))), F.lit(0.0)).alias("d")).first()
    unknown = (sums["d"] / sums["a"] if sums["a"] else 1.0) / (sums["v"] + 1)
    p = F.log10((F.col("a") - _kept(d, F.col("a"))) / float(sums["a"] or 1) + unknown)
    words = store.materialise(first.select("key", "n", (p - math.log10(unknown)).alias("w")), "words")
    store.remove(spark, first)
    store.release(spark)
    return Model(order, groups, cells, words, math.log10(unknown), discounts)


def bytes_of(texts: DataFrame, text: str) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of what is asked for in sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _both(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << U64(32)) | low.astype(np.uint64)


class Group:
    """What the n-grams of a group add to the probabilities of single words."""

    def __init__(self, grams: Grams, n: np.ndarray, order: int, discounts: dict[int, list[float]], log_p: Callable[[np.ndarray], np.ndarray]):
        """grams: distinct and sorted; log_p gives log10 of the probabilities of words."""
        self.words, self.order, size = grams.words, order, len(grams.words)
        single, self.backoff, predicted = np.zeros(size), np.zeros(size + 1), np.zeros(size, bool)
        predicted[grams.last] = True
        single[predicted] = log_p(grams.words[predicted])
        # slice by slice, since what leads to the numbers is several times as large as they are
        made, contexts = [[] for _ in range(6 if order == 3 else 2)], 0
        for at in _slices(grams.middle):
            columns = self._adds(grams.take(at), n[at], discounts, single, contexts)
            for x, column in zip(made, columns, strict=True):
                x.append(column)
            contexts += len(columns[2]) if order == 3 else 0
        self.pairs, self.pair_adds, *more = _joined(made)
        if order == 3:
            self.contexts, self.context_backoff, self.grams, self.adds = more

    def _adds(self, grams: Grams, n: np.ndarray, discounts: dict[int, list[float]], single: np.ndarray, contexts: int) -> list[np.ndarray]:
        """Of n-grams with all those of their middle words: pairs and what they add, contexts and their backoff, n-grams and what they add.  contexts: how many there are before."""
        pairs = Pairs.under(grams, n, self.order)
        # pairs are sorted by their middle word, so each of these has one range of them
        first = _changes(pairs.middle)
        of = np.repeat(np.arange(len(first)), np.diff(first, append=len(pairs.a)))
        kept = _kept(discounts[2], pairs.a)
        total, left = np.add.reduceat(pairs.a, first), np.add.reduceat(kept, first)
        p = (pairs.a - kept) / total[of] + (left / total)[of] * 10.0 ** single[pairs.last]
        self.backoff[pairs.middle[first]] = np.log10(left / total)
        out = [_both(pairs.middle, pairs.last), np.log10(p) - single[pairs.last]]
        if self.order == 3:
            first = _changes(grams.middle, grams.before)
            of = np.repeat(np.arange(len(first)), np.diff(first, append=len(n)))
            kept = _kept(discounts[3], n)
            total, left = np.add.reduceat(n, first), np.add.reduceat(kept, first)
            p = (n - kept) / total[of] + (left / total)[of] * p[pairs.of]
            out += [_both(grams.middle[first], grams.before[first]), np.log10(left / total), _both(of + contexts, grams.last), np.log10(p) - single[grams.last]]
        return out

    def ask(self, asked: Grams) -> np.ndarray:
        """What is added for each n-gram."""
        own = _find(self.words, asked.words)
        own = np.where(own < 0, len(self.words), own)  # no n-gram of the group holds that number
        middle, before, last = (own[x] for x in (asked.middle, asked.before, asked.last))
        at = _find(self.pairs, _both(middle, last))
        added = np.where(at >= 0, self.pair_adds[at], self.backoff[middle])
        if self.order == 3:
            context = _find(self.contexts, _both(middle, before))
            at = _find(self.grams, _both(np.maximum(context, 0), last))
            added = np.where(context < 0, added, np.where(at >= 0, self.adds[at], self.context_backoff[context] + added))
        return added


def _asks(docs: DataFrame, order: int, groups: int, blocks: int, block: int) -> DataFrame:
    """The n-grams of all texts that a block's groups are asked for, with the texts' keys: of (_key, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_lots = [[], [], [], []], 0, 0
        textops.lighten()

        def flush() -> Iterator[pa.RecordBatch]:
            *three, key = _joined(held)
            grams = _of_hashes(three)
            by = grams.sorted_by()
            grams, key = grams.take(by), key[by]
            for group, at in _cells(grams, groups):
                texts, of = np.unique(key[at], return_inverse=True)
                yield _row(group, ASKS, n_lots, grams.part(at).packed(np.diff(texts, prepend=U64(0)), of.reshape(-1)))

        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                s = ngrams.stream(part.column("_text"), order)
                key = np.repeat(part.column("_key").to_numpy().view(np.uint64), np.diff(s.rows))
                columns = [*_hashes(s, order), key]
                if blocks > 1:
                    mine = _group_of(columns[0], groups) % blocks == block
                    columns = [x[mine] for x in columns]
                for column, x in zip(held, columns, strict=True):
                    column.append(x)
                size += len(columns[0])
                if size >= LOT:
                    yield from flush()
                    size, n_lots = 0, n_lots + 1
        if size:
            yield from flush()
        textops.settle()

    return docs.select("_key", "_text").mapInArrow(run, PACKED)


def _answers(rows: DataFrame, model: Model, hot: Broadcast) -> DataFrame:
    """_key and t: what the groups add for the texts that ask; rows: PACKED, and word and p of PROBABILITY."""
    order, discounts, unknown = model.order, model.discounts, model.unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rare, parts, group_of_now = -1, [], [], None

        def log_p(words: np.ndarray) -> np.ndarray:
            keys, w = hot.value
            at = _find(keys, words)
            out = np.where(at >= 0, w[at], np.nan) if len(w) else np.full(len(words), np.nan)
            if rare:
                keys, w = (np.concatenate(x) for x in zip(*rare, strict=True))
                by = np.argsort(keys)
                at = _find(keys[by], words)
                out = np.where(at >= 0, w[by][at], out)
            return out + unknown

        for group, kind, some in _runs(batches):
            if group != now:
                now, rare, parts, group_of_now = group, [], [], None
            if kind == PROBABILITY:
                rare.append((some.column("word").to_numpy().view(np.uint64), some.column("p").to_numpy()))
            for data in some.column("data") if kind != PROBABILITY else []:
                grams, more = Grams.unpacked(data.as_py())
                if kind == MODEL:
                    parts.append((grams, more[0].astype(np.int64)))
                    continue
                if parts and group_of_now is None:
                    grams_of_now, n = _together([g for g, _ in parts]), np.concatenate([n for _, n in parts])
                    parts.clear()
                    group_of_now = Group(grams_of_now, n, order, discounts, log_p)
                    del grams_of_now, n
                if group_of_now is not None:
                    key, of = np.cumsum(more[0], dtype=np.uint64), more[1]
                    added = np.bincount(of, group_of_now.ask(grams), len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(added)], ["_key", "t"])
        rare, parts, group_of_now = [], [], None
        textops.settle()

    return rows.mapInArrow(run, "_key long, t double")


def log_probabilities(docs: DataFrame, model: Model, keep: list[str], key: str, text: str, hot_keys: int, blocks: int) -> DataFrame:
    """keep with n_tokens and log10_prob of each whole text; rows of one key (a long) have one text.

    blocks: asked one after the other, so that what the texts ask doesn't stand on disk at once; each reads the texts again.
    """
    spark, groups, order = docs.sparkSession, model.groups, model.order
    inner = [f"_k{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, inner, strict=True)), F.col(key).alias("_key"), F.col(text).alias("_text"))
    asked = ngrams.additive_scores(source, model.words, 1, lambda s: [(s.grams(1), s.rows)], "_text", [*inner, "_key"], hot_keys=hot_keys)
    single = store.materialise(asked.select(*inner, "_key", "n_tokens", (F.col("total") + F.col("n_tokens") * model.unknown).alias("total")), "singles")
    store.remove(spark, asked, but=model.words)
    store.release(spark)
    out = [F.col(x).alias(c) for x, c in zip(inner, keep, strict=True)]
    if model.cells is None:
        return single.select(*out, "n_tokens", F.col("total").alias("log10_prob"))

    common = ngrams.commonest(model.words, hot_keys)
    table = model.words.where(common.chosen).select("key", "w").toArrow()
    keys, w = table.column("key").to_numpy().view(np.uint64), table.column("w").to_numpy()
    by = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[by], w[by]))
    given = model.cells.where(F.col("kind") == MODEL).select("group", "kind", "at", "data", F.lit(None).cast("long").alias("word"), F.lit(None).cast("double").alias("p"))
    rare = None
    if not common.all:  # words that not every worker holds meet the groups in a join
        wanted = _rows_of_words(model.cells, lambda words: np.flatnonzero(_find(hot.value[0], words) < 0)).select("group", "key")
        rare = wanted.join(model.words.where(~common.chosen).select("key", "w"), "key")
        rare = store.materialise(rare.select("group", F.lit(PROBABILITY).alias("kind"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("data"), F.col("key").alias("word"), F.col("w").alias("p")), "rare")
        given = given.unionByName(rare)
    added = []
    for block in range(blocks):
        asks = _asks(source, order, groups, blocks, block).select("*", F.lit(None).cast("long").alias("word"), F.lit(None).cast("double").alias("p"))
        rows = given.where(F.col("group") % blocks == block).unionByName(asks) if blocks > 1 else given.unionByName(asks)
        rows = rows.repartition(min(2 * groups // blocks + 1, MOST_TASKS), "group").sortWithinPartitions("group", "kind", "at")
        added.append(store.materialise(_answers(rows, model, hot).groupBy("_key").agg(F.sum("t").alias("t")), "added"))
        store.release(spark)
    hot.destroy()
    # rows of one key have asked as often as there are of them
    totals = single.select("_key", F.col("total").alias("t"), F.lit(1).alias("c"))
    for more in added:
        totals = totals.unionByName(more.select("_key", "t", F.lit(0).alias("c")))
    totals = totals.groupBy("_key").agg((F.sum("t") / F.sum("c")).alias("log10_prob"))
    scored = store.materialise(single.join(totals, "_key").select(*out, "n_tokens", "log10_prob"), "perplexities")
    store.remove(spark, single, *added, *([rare] if rare else []))
    store.release(spark)
    return scored
