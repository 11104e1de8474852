"""Vectorised tokenisation and hashing of Arrow text columns.

Words are hashed where they lie in the Arrow buffer, without a Python object
for each: a polynomial over random byte values, taken as a difference of prefix
sums modulo 2**64 and moved to position 0 with the inverse power.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that are hashed at a time.
CHUNK = 1 << 17
_STEP = 0x9E3779B97F4A7C15 | 1
_UNSTEP = pow(_STEP, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown in each process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about max_bytes of text each; one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def settle() -> None:
    """Give memory that a task no longer needs back to the system; idle workers then hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What empties the stores that modules keep in a worker from task to task.
KEEPERS: list[Callable[[], None]] = []


def lighten() -> None:
    """Let go of what earlier tasks left in this worker, before work that needs its memory; later ones make it anew."""
    for clear in KEEPERS:
        clear()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _chunks(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about size bytes that begin at white space, so that no word is cut."""
    a, n = 0, len(data)
    while a < n:
        b = a + size
        while b < n:
            white = np.flatnonzero(_WHITE[data[b : b + 4096]])
            if len(white):
                b += int(white[0])
                break
            b += 4096
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and word offsets by row.

    Word i of row r stands at ``row_offsets[r] + i``.  Bytes are taken CHUNK at a time, whatever
    the length of a row, so that only the hashes grow with a text.
    """
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _chunks(data, CHUNK):
        part, n = data[a:b], b - a
        solid = ~_WHITE[part]
        cut = np.ones(n + 1, dtype=bool)
        cut[1:n] = ~solid[:-1]
        rows = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)]
        cut[rows - a] = True  # a row's first byte begins a word
        starts = np.flatnonzero(solid & cut[:-1])
        last = np.ones(n, dtype=bool)
        last[:-1] = ~solid[1:] | cut[1:-1]
        ends = np.flatnonzero(solid & last)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUES[_LOWER[part]] * _power_table(_STEP, n), out=sums[1:])
        hashes.append(mix((sums[ends + 1] - sums[starts]) * _power_table(_UNSTEP, n)[starts]))
        begins.append(starts + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def spread(row_offsets: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(row_offsets) - 1), np.diff(row_offsets))


def by_row(values: np.ndarray, row_offsets: np.ndarray) -> np.ndarray:
    """Sums of values by row, 0 for rows without any."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)]) if values.dtype.kind == "f" else np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[row_offsets[1:]] - sums[row_offsets[:-1]]


class KeyIndex:
    """An open-addressing hash table from 64-bit keys to positions, probed by whole arrays."""

    _latest: tuple[object, "KeyIndex"] | None = None

    @classmethod
    def once(cls, of: object, keys: np.ndarray) -> "KeyIndex":
        """The index of keys that ``of`` (an id) stands for: a worker builds it once and keeps the latest."""
        if cls._latest is None or cls._latest[0] != of:
            cls._latest = None
            cls._latest = (of, cls(keys))
        return cls._latest[1]

    @classmethod
    def forget(cls) -> None:
        cls._latest = None

    def __init__(self, keys: np.ndarray):
        """keys: distinct."""
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.table = np.zeros(1 << self.bits, dtype=np.uint64)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.at[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.at[slot[put]] = waiting[put]
            self.table[slot[put]] = keys[waiting[put]]
            left = np.ones(len(waiting), dtype=bool)
            left[put] = False
            waiting, slot = waiting[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where absent."""
        slot = self._slot(keys)
        found = self.at[slot]
        going = np.flatnonzero((found >= 0) & (self.table[slot] != keys))
        slot = slot[going]
        while len(going):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found[going] = self.at[slot]
            keep = (found[going] >= 0) & (self.table[slot] != keys[going])
            going, slot = going[keep], slot[keep]
        return found


KEEPERS.append(KeyIndex.forget)
