"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased characters, with a
space before and after.  Each is scaled by r = log of (its smoothed share among toxic
training rows / its share among the others), and a logistic regression is fitted to the
scaled features, all of them.

The classifier is fitted on a bounded sample of labelled rows: at most ``per_class`` of
each label, those first in the order of a hash of their id.  Scoring reads every text in full,
a bounded number of characters at a time.

Defined results: null and empty texts have no n-gram but the pad, so they get the score
of the bias; labels other than 0 and 1, and null ids, train nothing, but rows with a null id are
scored; where an id has several labels, the greatest counts; where it has several texts, one of them
trains; repeated rows give repeated results; an empty table gives an empty table; further columns are
passed on by score(), one of the result's name is replaced.  Without labels of both kinds every score
is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, textops

BITS = 18
ORDERS = (3, 4, 5)
#: Bound of the fitted sample: labelled rows of each class.
PER_CLASS = 4000
#: Characters hashed, and features of the fit handled, at a time.
CHARACTERS, ENTRIES = 1 << 16, 1 << 21
#: Stands for a step of so many buckets without a feature.
_SKIP = 0xFFFF
_C1, _C2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@dataclass(frozen=True)
class Model:
    """weights by bucket (mostly 0), and the bias."""

    weights: np.ndarray
    bias: float


def buckets(text: str | None, mark: np.ndarray) -> np.ndarray:
    """The distinct feature buckets of a text, sorted.  mark: zeros of 2**BITS, left as they were."""
    text = f" {(text or '').lower()} "
    for a in range(0, max(1, len(text) - max(ORDERS) + 1), CHARACTERS):
        # parts overlap, so that no n-gram is cut
        chars = np.frombuffer(text[a : a + CHARACTERS + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = (chars + np.uint32(1)) * _C1
        chars ^= chars >> np.uint32(15)
        key = chars
        for n in range(2, max(ORDERS) + 1):
            if len(chars) < n:
                break
            key = key[:-1] * np.uint32(0x01000193) ^ chars[n - 1 :]
            if n in ORDERS:
                h = (key ^ (key >> np.uint32(16))) * _C2
                mark[h >> np.uint32(32 - BITS)] = 1
    found = np.flatnonzero(mark)
    mark[found] = 0
    return found


def steps_between(found: np.ndarray) -> bytes:
    """Sorted buckets as steps of two bytes each."""
    steps = np.diff(found, prepend=0)
    skips = steps // _SKIP
    out = np.full(len(found) + int(skips.sum()), _SKIP, dtype=np.uint16)
    out[np.arange(len(found)) + np.cumsum(skips)] = steps % _SKIP
    return out.tobytes()


def from_steps(data: bytes | memoryview) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != _SKIP].astype(np.int32)


def ratios(seen: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    """The log-count ratio of each bucket, from the rows of each label that hold it."""
    share = [(x + alpha) / (x.sum() + alpha * len(x)) for x in seen]
    return np.log(share[1] / share[0])


def regress(lots: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ratio: np.ndarray, prior: float, steps: int = 40, ridge: float = 3e-5) -> Model:
    """Logistic regression, by L-BFGS, on the buckets of each row, scaled by their ratios.

    lots: of some rows in order, the number of buckets of each and all their buckets.  prior: the share of
    label 1 that scores should assume.
    """
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    n, y = len(labels), labels.astype(np.float64)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, total, g = w[:-1] * ratio, 0.5 * ridge * float(w[:-1] @ w[:-1]), np.zeros(len(w))
        a = 0
        for sizes, col in lots:
            b = a + len(sizes)
            row = np.repeat(np.arange(b - a, dtype=np.int32), sizes)
            z = np.bincount(row, scaled[col], b - a) + w[-1]
            total += float(np.logaddexp(0, np.where(y[a:b] > 0, -z, z)).sum()) / n
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[a:b]) / n
            g[:-1] += np.bincount(col, error[row], len(ratio))
            g[-1] += error.sum()
            a = b
        g[:-1] = g[:-1] * ratio + ridge * w[:-1]
        return total, g

    w = least_by_lbfgs(loss, np.zeros(len(ratio) + 1), steps)
    sampled = float(y.mean())
    return Model((w[:-1] * ratio).astype(np.float32), float(w[-1] + np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled))))


def least_by_lbfgs(loss, w: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """Where a smooth convex function is about least; loss(w): its value and gradient."""
    value, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, used = -g, []
        for s, d in reversed(pairs):
            used.append(float(s @ direction) / float(s @ d))
            direction = direction - used[-1] * d
        if pairs:
            s, d = pairs[-1]
            direction = direction * (float(s @ d) / float(d @ d))
        for (s, d), x in zip(pairs, reversed(used), strict=True):
            direction = direction + (x - float(d @ direction) / float(s @ d)) * s
        slope = float(g @ direction)
        if slope > -1e-10:
            break
        step = 1.0 if pairs else 1.0 / max(1e-9, float(np.sqrt(g @ g)))
        for _ in range(20):
            there, g_there = loss(w + step * direction)
            if there <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = step * direction, g_there - g
        if float(s @ d) > 1e-12:
            pairs = [*pairs[1 - memory :], (s, d)] if len(pairs) >= memory else [*pairs, (s, d)]
        w, gain, value, g = w + s, value - there, there, g_there
        if gain < 1e-6 * abs(value):
            break
    return w


def fit(rows: Iterable[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """Fit on the sorted feature buckets of each row; they are held once, four bytes each."""
    seen, lots = np.zeros((2, 1 << BITS)), []
    held: list[np.ndarray] = []

    def close() -> None:
        lots.append((np.array([len(x) for x in held]), np.concatenate(held)))
        held.clear()

    for x, label in zip(rows, labels, strict=True):
        seen[label][x] += 1
        held.append(x.astype(np.int32))
        if sum(map(len, held)) >= ENTRIES:
            close()
    if held:
        close()
    return regress(lots, labels, ratios(seen), prior)


def margin(model: Model, text: str | None, mark: np.ndarray) -> float:
    return float(model.weights[buckets(text, mark)].sum(dtype=np.float64) + model.bias)


def train(docs: DataFrame, labels: DataFrame, in_training: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows for which in_training (over doc_id) holds, at most per_class of each label."""
    spark = docs.sparkSession
    store.ship(spark)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).where(in_training).groupBy(doc_id).agg(F.max(label).alias("_y"))
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id).limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)

    # the sample has 2 * per_class rows at most, so its ids may be broadcast; it's written to be read by name
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where("_doc is not null")
    sample = texts.join(F.broadcast(drawn.withColumnRenamed(doc_id, "_doc")), "_doc").select(F.col("_doc").cast("string").alias("_id"), "_y", "_text")
    sample = store.materialise(sample.dropDuplicates(["_id"]), "labelled")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, np.uint8)
        for batch in batches:
            found = [steps_between(buckets(x, mark)) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(found, pa.binary())], ["_id", "_y", "_steps"])

    prior = shares.get(1, 0) / total if total else 0.0

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches).sort_by("_id")
        model = fit((from_steps(x.as_buffer()) for x in found.column("_steps")), found.column("_y").to_numpy().astype(np.int64), prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])
        textops.settle()

    if not total:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(1e-6 / (1 - 1e-6))))
    # 2 * per_class rows of distinct buckets, two bytes each, meet in the one task that fits; only weights reach the driver
    laid = sample.mapInArrow(lay_out, "_id string, _y int, _steps binary").repartition(1)
    made = laid.mapInArrow(fit_all, "weights binary, bias double").first()
    store.remove(spark, sample)
    return Model(np.frombuffer(made["weights"], np.float32), made["bias"]) if made else Model(np.zeros(1 << BITS, np.float32), float(np.log(1e-6 / (1 - 1e-6))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability, 0 to 1, that label 1 is the right one."""
    spark = docs.sparkSession
    store.ship(spark)
    sent = spark.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mark, known = np.zeros(1 << BITS, np.uint8), sent.value
        for texts in batches:
            z = np.array([margin(known, x, mark) for x in texts], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return docs.select(*kept, F.pandas_udf(run, "double")(F.col(text)).alias(out))
