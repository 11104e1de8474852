"""Bit arrays of a stated size, filled by DataFrame aggregation and probed by numpy.

All bits of a key stand in one word of 64, so a probe reads one word, and a key costs one
row when the array is filled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .textops import U64, mix

#: Keys that a task gathers before it combines their words; a bound on its memory.
COMBINE = 1_000_000
BITS_OF_KEY = 4


def bit_width(entries: int, per_entry: int = 16, least: int = 16, most: int = 28) -> int:
    """log2 of the number of bits for so many entries; never above most (2**28 bits are 32 MB)."""
    return min(most, max(least, int(max(1, entries) * per_entry - 1).bit_length()))


def places(keys: np.ndarray, width: int, bits: int = BITS_OF_KEY) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key, which is itself a hash, and its bits in there."""
    keys = keys.view(np.uint64)
    more = mix(keys)
    mask = U64(1) << (more & U64(63))
    for i in range(1, bits):
        mask |= U64(1) << ((more >> U64(6 * i)) & U64(63))
    return (keys >> U64(70 - width)).astype(np.int64), mask


def combine(word: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, with all its bits."""
    by = np.argsort(word, kind="stable")
    word, mask = word[by], mask[by]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    return word[first], np.bitwise_or.reduceat(mask, first) if len(first) else mask


def fill(df: DataFrame, width: int, columns: list[str], places_of: Callable[..., tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """The bit array with all bits set that places_of(columns as arrays) names, by default those of keys.

    Words are combined within tasks, then by bit_or; at most 2**(width - 6) of them,
    2**width / 8 bytes, reach the driver.
    """
    places_of = places_of or (lambda keys: places(keys, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            word, mask = combine(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], ["w", "b"])

        for batch in batches:
            held.append(places_of(*(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)))
            if sum(len(x[0]) for x in held) > COMBINE:
                yield flush()
        if held:
            yield flush()

    made = store.materialise(df.select(*columns).mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")), "bits")
    got = made.toArrow()
    store.remove(df.sparkSession, made)
    bits = np.zeros(1 << (width - 6), dtype=np.uint64)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return bits


def contains(bits: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Whether all bits of each key are set."""
    word, mask = places(keys, width)
    return bits[word] & mask == mask
