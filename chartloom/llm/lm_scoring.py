"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and of pairs of words are quantised to powers of two and put
into bit arrays: an n-gram of level q = 1 + floor(log2 count) sets three bits of its block for each of
the levels 1..q.  A worker reads a count back by probing level after level until one is missing.
The filter that every worker holds is bounded by ``most_bits``; where the corpus has more n-grams than
fit, it holds the commonest, and the others fill filters sharded by key.  What a worker can't
read is sent to its shard and read there, packed by lot and shard, so every counted n-gram is found at
any size.

P(w | v) = (c(vw) + mu * P(w)) / (c(v) + mu) and
P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), with counts from the filters.  The logarithm of P(w | v) is the
sum of log(P(w) + c(vw) / mu), asked where vw is, and of log(mu / (c(v) + mu)), asked where v is.
As counts are read in powers of two, the probabilities of all words after v add up to about 1 only.

The exact unigram base of the contract comes from whole counts: those of common words
are broadcast, the rest join the rows that need them.

Defined results: null and empty texts consist of the end token alone; repeated rows, repeated ids and null
ids are scored each for itself; the longest texts are read whole, their bytes in bounded steps;
without training rows every base term is log10(1) = 0; an empty table gives an empty table; columns
of docs other than those named aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blooms, ngrams, store, textops
from .ngrams import Stream
from .textops import U64

MU = 400.0
#: Words whose levels every worker holds apart, so that a shard gets few pairs of the same word.
COMMON_WORDS = 1 << 16
#: Words whose exact counts every worker holds; the rest meet theirs in a join.
HOT_WORDS = 1 << 18
#: log2 of the bits of a shard's filter.
SHARD_BITS = 24
#: Bits of a filter for each level of an n-gram, and how many of them it sets.
PER_LEVEL, BITS_OF_LEVEL = 10, 3
#: Parts in which the broadcast filter is built.
SEGMENTS = 64
#: Rows that a task packs together.
PACK = 400_000
_SHARD = U64(0xFFFFF)
_LEVEL = 0x8CB92BA72F3D8DD7
_MOST_LEVELS = 48


class CountFilter:
    """Quantised counts in a bit array, probed by whole arrays.  All bits of a key stand in one block of 512."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    @staticmethod
    def places(keys: np.ndarray, level: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word and bit of each place of a level, one place after another."""
        h = textops.mix(keys + U64(level * _LEVEL & (1 << 64) - 1))
        block = (keys >> U64(64 - (width - 9))).astype(np.int64) << 3
        for i in range(BITS_OF_LEVEL):
            at = (h >> U64(9 * i)) & U64(511)
            yield block + (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 where level 1 is missing."""
        keys, back = np.unique(keys, return_inverse=True)
        level, going = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        for q in range(1, _MOST_LEVELS + 1):
            held = np.ones(len(going), dtype=bool)
            for word, bit in self.places(keys[going], q, self.width):
                held &= self.bits[word] & bit != 0
            going = going[held]
            level[going] = q
            if not len(going):
                break
        return level[back]

    def add(self, keys: np.ndarray, levels: np.ndarray, from_word: int = 0) -> None:
        """Set the bits of keys; from_word: the place of self.bits in the whole array."""
        for q in range(1, int(levels.max(initial=0)) + 1):
            for word, bit in self.places(keys[levels >= q], q, self.width):
                word, bit = blooms.combine(word, bit)
                self.bits[word - from_word] |= bit

    @staticmethod
    def middle(level: np.ndarray) -> np.ndarray:
        """An estimate for each level: its middle, 0 for level 0."""
        return np.where(level > 0, 0.75 * 2.0**level, 0.0) - 0.5 * (level == 1)

    @staticmethod
    def of(keys: np.ndarray, levels: np.ndarray) -> "CountFilter":
        """The filter of so many keys as one worker holds."""
        width = blooms.bit_width(int(levels.sum(dtype=np.int64)), per_entry=PER_LEVEL, most=40)
        made = CountFilter(np.zeros(1 << (width - 6), dtype=np.uint64), width)
        made.add(keys, levels)
        return made


def packed(counts: DataFrame, group_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Keys and levels of counts (key, n) by group, many in a row: group, key and level, the latter as bytes of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, levels = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            group = group_of(keys)
            by = np.argsort(group, kind="stable")
            group, keys, levels = group[by], keys[by], levels[by]
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            ends = [*cuts[1:].tolist(), len(group)]
            cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(cuts.tolist(), ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(group[cuts].astype(np.int32)), cut(keys), cut(levels)], ["group", "key", "level"])

        for batch in batches:
            levels = np.frexp(batch.column("n").to_numpy().astype(np.float64))[1]  # 1 + floor(log2 n)
            held.append((batch.column("key").to_numpy().view(np.uint64), levels.astype(np.uint8)))
            if sum(len(x[0]) for x in held) >= PACK:
                yield flush()
        if held:
            yield flush()
        textops.settle()

    return counts.select("key", "n").mapInArrow(run, "group int, key binary, level binary")


def fill_filter(counts: DataFrame, width: int) -> np.ndarray:
    """The bits for all levels of all counts: 2**width / 8 bytes reach the driver, in SEGMENTS parts."""
    words = (1 << (width - 6)) // SEGMENTS
    shift = U64(64 - SEGMENTS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = -1, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part.bits.tobytes()], pa.binary())], ["group", "bits"])
        for batch in batches:
            for group, key, level in zip(*(batch.column(c) for c in ("group", "key", "level")), strict=True):
                if group.as_py() != now:
                    if part is not None:
                        yield give()
                    now, part = group.as_py(), CountFilter(np.zeros(words, dtype=np.uint64), width)
                part.add(np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(level.as_buffer(), np.uint8), now * words)
        if part is not None:
            yield give()

    sorted_parts = packed(counts, lambda keys: (keys >> shift).astype(np.int64)).repartition("group").sortWithinPartitions("group")
    bits = np.zeros(1 << (width - 6), dtype=np.uint64)
    made = store.materialise(sorted_parts.mapInArrow(run, "group int, bits binary"), "filter")
    got = made.toArrow()
    store.remove(counts.sparkSession, made)
    for group, part in zip(got.column("group").to_pylist(), got.column("bits"), strict=True):
        bits[group * words : (group + 1) * words] = np.frombuffer(part.as_buffer(), np.uint64)
    return bits


def _shard_terms(asked: DataFrame, rest: DataFrame, shards: int, p_word: Callable[[np.ndarray], np.ndarray], mu: float) -> DataFrame:
    """_row and t, the sum of a text's terms, of what is asked (_row and ASKS), from filters of the counts packed in rest.

    level is that of the predicted word, 0 if it must be read by ``word``, 255 if key is a
    context.  Of each shard the counts come first, then what is asked of them streams by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, levels, known = -1, [], [], None
        for batch in batches:
            for shard, row, at, key, level, word in zip(*(batch.column(c) for c in ("shard", "_row", "at", "key", "level", "word")), strict=True):
                if shard.as_py() != now:
                    now, keys, levels, known = shard.as_py(), [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], None
                key, level = np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(level.as_buffer(), np.uint8)
                if row.as_py() < 0:
                    keys.append(key.copy())
                    levels.append(level.copy())
                    continue
                if known is None:
                    known = CountFilter.of(np.concatenate(keys), np.concatenate(levels))
                    keys, levels = [], []
                seen, context = level.astype(np.int64), level == 255
                count = CountFilter.middle(known.levels(key))
                seen[seen == 0] = known.levels(np.frombuffer(word.as_buffer(), np.uint64))
                seen[context] = 0
                of_word = CountFilter.middle(seen)
                t = np.where(context, np.log10(mu / (count + mu)), np.log10(p_word(of_word) + np.minimum(count, of_word) / mu))
                texts, first = np.unique(np.frombuffer(at.as_buffer(), np.uint32), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(texts.astype(np.int64) + row.as_py()), pa.array(np.add.reduceat(t, first))], ["_row", "t"])
        textops.settle()

    nothing = F.lit(None).cast("binary")
    counts = rest.select(F.col("group").alias("shard"), F.lit(-1).cast("long").alias("_row"), nothing.alias("at"), "key", "level", nothing.alias("word"))
    both = counts.unionByName(asked).repartition(min(shards, ngrams.MOST_TASKS), "shard")
    return both.sortWithinPartitions("shard", F.col("_row") >= 0).mapInArrow(run, "_row long, t double")


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys & _SHARD) * U64(shards)) >> U64(20)).astype(np.int64)


def lm_scores(docs: DataFrame, in_training: Column, text: str = "text", keep: list[str] | None = None, most_bits: int = 28, mu: float = MU, hot_keys: int = HOT_WORDS, shard_bits: int = SHARD_BITS) -> DataFrame:
    """keep (default doc_id), n_tokens, n_known, train_tokens, base_score and score of each text.

    in_training: over docs' columns, the rows to learn from.  All words and pairs of them are counted.
    """
    spark = docs.sparkSession
    store.ship(spark)
    keep = keep if keep is not None else ["doc_id"]
    training = docs.where(in_training)
    words = store.materialise(ngrams.count_keys(training, lambda s: [s.events(1)], 1, text), "words")
    store.release(spark)
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_words = sums["n"], sums["v"]

    levels_of = lambda n: np.frexp(n.astype(np.float64))[1]
    listed = words.where(ngrams.commonest(words, COMMON_WORDS).chosen).select("key", "n").toArrow()
    common_keys, common_levels = listed.column("key").to_numpy().view(np.uint64), levels_of(listed.column("n").to_numpy())
    sent_common = spark.sparkContext.broadcast((textops.KeyIndex(common_keys), np.append(common_levels, 0)))  # COMMON_WORDS at most

    def previous_of(s: Stream) -> np.ndarray:
        # the end of the text before stands before a first word
        previous = s.padded[s.at - 1]
        previous[previous == ngrams.BEGIN] = ngrams.END
        return previous

    def keys_of(word: np.ndarray, previous: np.ndarray, is_common: np.ndarray) -> np.ndarray:
        """A pair's key; that of a word that isn't common has the word's shard."""
        key = textops.mix(word * U64(0xD1342543DE82EF95) + previous)
        return np.where(is_common, key, key & ~_SHARD | word & _SHARD)

    def pair_keys(s: Stream) -> list[np.ndarray]:
        word = s.events(1)
        return [keys_of(word, previous_of(s), sent_common.value[0].find(word) >= 0)]

    pairs = store.materialise(ngrams.count_keys_packed(training, pair_keys, 2, text, n_all), "pairs")
    store.release(spark)
    both = words.unionByName(pairs)
    common = ngrams.commonest(both, (1 << most_bits) // PER_LEVEL, lambda n: n.bit_length())
    stored, rest = both.where(common.chosen), both.where(~common.chosen)
    size = F.coalesce(F.sum(F.floor(F.log2("n")) + 1), F.lit(0)).alias("e")
    entries, others = (int(x.agg(size).first()["e"]) for x in (stored, rest))
    width = blooms.bit_width(entries, per_entry=PER_LEVEL, most=max(16, most_bits))  # SEGMENTS parts of whole blocks
    sent = spark.sparkContext.broadcast(fill_filter(stored, width))
    store.release(spark)
    # a lower level is no n-gram of this filter
    least = 1 if common.all else int(common.least).bit_length()
    settles, shards = common.settles_absent, max(1, -(-others * PER_LEVEL >> shard_bits))
    if others:
        rest = store.materialise(packed(rest, lambda keys: _shard_of(keys, shards)), "rest")
    store.remove(spark, pairs)

    def p_word(count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (n_all + 0.5 * (n_words + 1))

    def model(s: Stream) -> tuple[np.ndarray, list[dict]]:
        known, (index, listed_levels) = CountFilter(sent.value, width), sent_common.value
        word, previous = s.events(1), previous_of(s)

        def read(keys: np.ndarray) -> np.ndarray:
            level = known.levels(keys)
            return np.where(level >= least, level, 0)

        of_common = listed_levels[index.find(word)]
        of_word = np.where(of_common > 0, of_common, 0)
        of_word[of_common == 0] = read(word[of_common == 0])
        of_previous = listed_levels[index.find(previous)]
        of_previous[of_previous == 0] = read(previous[of_previous == 0])
        pair = keys_of(word, previous, of_common > 0)
        of_pair = read(pair)
        count = CountFilter.middle(of_word)
        first = np.log10(p_word(count) + np.minimum(CountFilter.middle(of_pair), count) / mu)
        second = np.log10(mu / (CountFilter.middle(of_previous) + mu))
        open_word = (of_word == 0) & ~settles(word)
        open_pair, open_previous = open_word | (of_pair == 0) & ~settles(pair), (of_previous == 0) & ~settles(previous)
        total = textops.by_row(np.where(open_pair, 0.0, first) + np.where(open_previous, 0.0, second), s.rows)
        at, of = np.flatnonzero(open_pair), np.flatnonzero(open_previous)
        if not len(at) + len(of):
            return total, []
        # a word that is known to be absent has level 0 as well, and is read as absent by its shard
        key = np.concatenate([pair[at], previous[of]])
        level = np.concatenate([of_word[at], np.full(len(of), 255)]).astype(np.uint8)
        unread = np.concatenate([word[at], np.zeros(len(of), np.uint64)])
        row = (np.searchsorted(s.rows, np.concatenate([at, of]), side="right") - 1).astype(np.uint32)
        shard = _shard_of(key, shards)
        by = np.lexsort((row, shard))
        key, level, unread, row, shard = key[by], level[by], unread[by], row[by], shard[by]
        asks = []
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
            asks.append({"shard": int(shard[a]), "at": row[a:z].tobytes(), "key": key[a:z].tobytes(), "level": level[a:z].tobytes(), "word": unread[a:z][level[a:z] == 0].tobytes()})
        return total, asks

    def answer(asked: DataFrame) -> DataFrame:
        return _shard_terms(asked, rest, shards, p_word, mu)

    table = words.select("key", "n", F.log10((F.col("n") + 0.5) / 0.5).alias("w"))
    scored = ngrams.additive_scores(docs, table, 2, lambda s: [(s.events(1), s.rows)], text, keep, hot_keys, model, answer if others else None)
    for spent in (sent, sent_common):  # the texts have been scanned
        spent.destroy()
    absent = float(np.log10(0.5 / (n_all + 0.5 * (n_words + 1))))
    return scored.select(*keep, "n_tokens", F.col("found").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("total") + F.col("n_tokens") * absent).alias("base_score"), F.col("extra").alias("score"))
