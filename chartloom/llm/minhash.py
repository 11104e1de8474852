"""Near-duplicates by MinHash, banding, verification and connected components.

1. A scan gives each document the key of its set of word shingles, its signature of universal-hash
   minima and the keys of the signature's bands.  Equal sets form one class.
2. In each band bucket every class is tied to the least one (minima are combined before
   the shuffle, and the rows of a large bucket are dealt out); components of these ties are
   clusters, outside which no pair shares a band.
3. Within a cluster, classes are dealt into cells of bounded number and bytes by set size, and cells
   into units of two; sizes that can't reach the threshold never meet.  A unit first
   compares signatures alone.  Only classes that may reach the threshold with another bring their
   sets; the unit then confirms on the full sets what isn't joined already, and returns a
   spanning forest of links.
4. Components of the links, again by large-star and small-star.

With ``PERMUTATIONS`` minima, band lengths are chosen so that a pair at the threshold
shares no band with a probability below 1e-6.  Sets and classes go by 64-bit hashes.

Defined results: null and empty texts have no shingles and are linked with nothing;
rows that repeat an id and text share a class; where one id comes with several texts,
each row is judged by its own; a null id takes no part, gets a null component and isn't kept; the longest texts
are taken whole, with a few bytes of memory for each of theirs; an empty table gives an
empty table; columns of docs other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blooms, store, textops
from .components import connected_components, join_facts
from .textops import U64

PERMUTATIONS = 384
#: Classes in a cell, and about as many bytes of their sets; a unit holds two cells.
CELL = 512
CELL_BYTES = 8 << 20
_RNG = np.random.default_rng(8191)
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_SHINGLE = U64(0x2545F4914F6CDD1D)
_UNIT = ["component", "a", "i", "b", "j"]
_CELLS = "array<struct<a:int,i:int,b:int,j:int,second:boolean>>"


def band_rows(percent: int) -> int:
    """The longest bands with which a pair at the threshold is missed by all with p < 1e-6."""
    t = percent / 100
    return max((r for r in range(1, 17) if (1 - t**r) ** (PERMUTATIONS // r) < 1e-6), default=1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles (all its words, where fewer)."""
    words, rows = textops.word_hashes(*textops.text_buffer(texts))
    n = max(0, len(words) - k + 1)
    long = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        long = long * _SHINGLE + words[i : i + n]
    long = textops.mix(long)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(long[a : b - k + 1]))
        elif b > a:
            short = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                short = short * _SHINGLE + w
            out.append(textops.mix(short + U64(b - a)))
        else:
            out.append(words[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes a * x + b modulo 2**32 over the set's upper words."""
    x = (shingles >> U64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature (one signature a row)."""
    bands = PERMUTATIONS // rows
    cells = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cells.shape[:2])
    for j in range(rows):
        key = textops.mix(key * _SHINGLE + cells[:, :, j])
    return key


def _set_key(shingles: np.ndarray) -> int | None:
    """A 64-bit key of a set; null for the empty one."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def _scan(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """_id, n_shingles, set (its key), signature (the minima's lowest bytes) and bands of docs' _id and _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.pieces(batch, "_text"):
                sets = shingle_sets(part.column("_text"), k)
                signs = np.array([signature(s) for s in sets]).reshape(-1, PERMUTATIONS)
                bands = [y if len(s) else [] for s, y in zip(sets, band_keys(signs, rows).view(np.int64), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in signs.astype(np.uint8)], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["_id", "n_shingles", "set", "signature", "bands"])
        textops.settle()

    return docs.select("_id", "_text").mapInArrow(run, "_id long, n_shingles long, set long, signature binary, bands array<long>")


def _sets_of(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """set and shingles of members (first, an id, and set) from a second scan.

    The scan leaves out what a bit array of bounded size shows to be no member, and an
    exact join on id and set the rest.
    """
    spark = docs.sparkSession
    width = blooms.bit_width(members.count())
    hashed = members.select(F.xxhash64("first").alias("h"))
    sent = spark.sparkContext.broadcast(blooms.fill(hashed, width, ["h"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = blooms.contains(sent.value, batch.column("_hash").to_numpy(zero_copy_only=False).astype(np.int64), width)
            for part in textops.pieces(batch.filter(pa.array(may)), "_text"):
                sets = shingle_sets(part.column("_text"), k)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["first", "set", "shingles"])
        textops.settle()

    found = docs.where("_id is not null").select("_id", F.xxhash64("_id").alias("_hash"), "_text").mapInArrow(run, "first long, set long, shingles binary")
    return members.select("first", "set").join(found, ["first", "set"]).dropDuplicates(["set"]).select("set", "shingles")


def _fixed(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Binary values of one length as the rows of an array."""
    return np.array([np.frombuffer(x.as_buffer(), dtype) for x in column])


def _alike(signs: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """Pairs of a unit whose signatures may belong to sets that reach the threshold: minus equal minima, and two places."""
    t = percent / 100
    least = PERMUTATIONS * (t - 5 * math.sqrt(t * (1 - t) / PERMUTATIONS))
    across, found = second.any() and not second.all(), []
    others_of = np.flatnonzero(second)
    for i in range(len(signs)):
        others = others_of if across and not second[i] else np.arange(i + 1, len(signs)) if not across else ()
        if len(others):
            same = (signs[others] == signs[i]).sum(axis=1)
            found += [(-int(s), i, int(j)) for s, j in zip(same[same >= least], others[same >= least], strict=True)]
    return found


def _candidates_in_unit(percent: int):
    """The rows of a unit that may be linked with another of it."""

    def run(unit: pa.Table) -> pa.Table:
        found = _alike(_fixed(unit.column("signature"), np.uint8), unit.column("second").to_numpy(), percent)
        return unit.take(pa.array(sorted({x for pair in found for x in pair[1:]}), pa.int64()))

    return run


def _links_in_unit(percent: int):
    """A spanning forest of a unit's links, confirmed on full sets."""

    def run(unit: pa.Table) -> pa.Table:
        ids = unit.column("set").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit.column("shingles")]
        root = list(range(len(ids)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for _, i, j in sorted(_alike(_fixed(unit.column("signature"), np.uint8), unit.column("second").to_numpy(), percent)):
            a, b = top(i), top(j)
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    root[a] = b
                    links.append((ids[i], ids[j]))
        ends = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": ends[:, 0], "v": ends[:, 1]})

    return run


def _units(members: DataFrame, percent: int) -> DataFrame:
    """members (set, n, component and more) with a row for each unit they stand in."""
    ratio = math.log(100 / percent)
    sized = members.withColumn("size", F.floor(F.log("n") / ratio + 1e-9).cast("int"))
    # by cluster and size of sets: how many cells; a cluster has as many sizes as the longest text allows
    held = sized.groupBy("component", "size").agg(F.count("*").alias("members")).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("size", "members"))).alias("held"))

    def number(shift: int) -> Column:
        have = F.coalesce(F.try_element_at("held", F.col("size") + shift), F.lit(0))
        by_bytes = 8 * F.exp((F.col("size") + shift + 1) * ratio) / CELL_BYTES
        return F.least(have, F.ceil(have * F.greatest(F.lit(1 / CELL), by_bytes))).cast("int")

    # members of a cluster of a third of all are dealt by their own keys: the map of sizes is joined as a fact
    placed = members_with(sized, held).withColumn("cell", F.pmod(F.xxhash64("set"), F.greatest(number(0), F.lit(1))).cast("int"))
    none = F.array().cast(_CELLS)
    alone = F.try_element_at("held", F.col("size")) == 1
    own = F.when(alone, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(number(0), F.lit(1)) - 1), lambda j: F.struct(F.col("size").alias("a"), F.least("cell", j).alias("i"), F.col("size").alias("b"), F.greatest("cell", j).alias("j"), (F.col("cell") > j).alias("second"))))

    def beside(shift: int) -> Column:
        ours, theirs = F.col("size"), F.col("size") + shift
        pair = lambda j: F.struct(ours.alias("a"), F.col("cell").alias("i"), theirs.alias("b"), j.alias("j"), F.lit(False).alias("second")) if shift > 0 else F.struct(theirs.alias("a"), j.alias("i"), ours.alias("b"), F.col("cell").alias("j"), F.lit(True).alias("second"))
        return F.when(number(shift) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(number(shift), F.lit(1)) - 1), pair))

    return placed.select(*members.columns, F.explode(F.concat(own, beside(1), beside(-1))).alias("_unit")).select(*members.columns, "_unit.*")


def members_with(sized: DataFrame, held: DataFrame) -> DataFrame:
    """sized with ``held`` of its component."""
    counted = sized.groupBy("component").agg(F.count("*").alias("k")).join(held, "component")
    return join_facts(sized, counted, "component", "held", sized.count(), "set")


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The scan of docs (_id and _text): _id, n_shingles and set; and set, root and k (rows) of every set that repeats or is linked."""
    spark = docs.sparkSession
    scanned = store.materialise(_scan(docs, k, band_rows(percent)), "signatures")
    taking = scanned.where("set is not null and _id is not null")
    classes = taking.groupBy("set").agg(F.min("_id").alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    classes = store.materialise(classes, "classes")
    # copies repeat their class's bands; those ties count once
    bands = taking.select("_id", "set", F.explode("bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("set").alias("m"), F.max("set").alias("top"), F.count("*").alias("k")).where("m < top")
    ties = join_facts(bands, least, "band", "m", bands.count(), "_id").where("set > m").select(F.col("set").alias("u"), F.col("m").alias("v"))
    clusters = connected_components(ties).withColumnRenamed("node", "set")
    of_first = taking.select(F.col("_id").alias("first"), "set", "signature")
    members = classes.select("set", "first", "n").join(clusters, "set").join(of_first, ["set", "first"]).dropDuplicates(["set"])
    members = store.materialise(members, "members")
    store.release(spark)
    unit_row = "set long, first long, signature binary, component long, a int, i int, b int, j int, second boolean"
    asked = _units(members, percent).select("set", "first", "signature", *_UNIT, "second")
    candidates = store.materialise(asked.groupBy(*_UNIT).applyInArrow(_candidates_in_unit(percent), unit_row), "candidates")
    sets = _sets_of(docs, candidates.select("first", "set").distinct(), k)
    links = candidates.drop("first").join(sets, "set").groupBy(*_UNIT).applyInArrow(_links_in_unit(percent), "u long, v long")
    joined = connected_components(links).withColumnRenamed("node", "set")
    roots = classes.select("set", "first", F.col("copies").alias("k")).join(joined, "set", "left").where("k > 1 or component is not null")
    roots = store.materialise(roots.select("set", "first", F.coalesce("component", "set").alias("root"), "k"), "roots")
    store.remove(spark, classes, members, candidates)
    store.release(spark)
    return scanned.select("_id", "n_shingles", "set"), roots


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Documents whose shingle sets have a Jaccard similarity of percent / 100 or more are
    linked; component_id is the smallest doc_id reachable, kept says that it's one's own.
    """
    store.ship(docs.sparkSession)
    scanned, roots = _components(docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")), k, percent)
    least = roots.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("k"))
    named = join_facts(roots.select("set", "root", F.col("k").alias("copies")), least, "root", "least", roots.count(), "set")
    named = named.select("set", "least", F.col("copies").alias("k"))
    out = join_facts(scanned, named, "set", "least", scanned.count(), "_id")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("least", "_id"))
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: the one of the smallest id.

    Rows are told apart by a hash of id and text, so that those sharing an id, or without one, go only
    as copies.  Of a group without any id, the one of the smallest hash stays; of rows equal in id and text, one.
    """
    spark = docs.sparkSession
    store.ship(spark)
    row = F.xxhash64(doc_id, F.col(text))
    scanned, roots = _components(docs.select(row.alias("_id"), F.col(text).alias("_text")), k, percent)
    # rows without words repeat only themselves; a set without a root stands alone
    found = join_facts(scanned, roots.select("set", "root", "k"), "set", "root", scanned.count(), "_id")
    ids = docs.select(row.alias("_id"), F.col(doc_id).alias("_own"))
    grouped = found.where("root is not null").select("_id", "root").distinct().join(ids.distinct(), "_id")
    stays = grouped.groupBy("root").agg(F.min(F.struct(F.col("_own").isNull().alias("none"), "_own", "_id")).alias("x")).select("x._id")
    goes = store.materialise(grouped.select("_id").join(stays, "_id", "left_anti"), "dropped")
    # a document travels as one struct, so its columns' names can't clash with ours
    held = docs.select(F.struct(*docs.columns).alias("_doc"), row.alias("_id"))
    left = held.join(goes, "_id", "left_anti")
    repeats = scanned.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id")
    if repeats.isEmpty():
        return left.select("_doc.*")
    repeats = store.materialise(repeats, "repeats")
    once = left.join(repeats, "_id", "left_anti").unionByName(left.join(repeats, "_id", "left_semi").dropDuplicates(["_id"]))
    return once.select("_doc.*")
