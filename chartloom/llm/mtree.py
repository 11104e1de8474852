"""Exact top-k by inner product with M-trees searched best first.

Integer vectors become points of a metric space in which the largest inner product is
the least Euclidean distance: x gets one more coordinate sqrt(M - |x|^2), M being the
largest squared norm of all, and a query gets 0 there.  Rows are dealt to the nearest of a bounded
sample of pivots, and what one pivot draws is split into shards of bounded size.  Each
shard is an M-tree of pages: routing entries with covering radius and distance to
the parent, and leaves with each object's distance to the parent.  Stored distances
rule entries out by the triangle inequality before any distance is computed.  A query visits
the shards of its own pivot first, and then those that can hold a score as good as the k-th best found there.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows
with a null id, take no part; vectors of different lengths never meet; candidates are rows,
so those that repeat an id or a vector all count; a query's own id is no candidate; queries that share an id
are answered together; ties go to the smaller id; fewer candidates than k
give fewer rows; other columns are left out, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

PAGE = 48
#: Bounds of the pivot sample, of a shard's rows and of a block of queries.
MOST_PIVOTS = 64
SHARD = 4096
QUERY_BLOCK = 2048
#: Distances are compared with this slack, so that rounding never rules an answer out.
SLACK = 1e-6


@dataclass
class Page:
    """Entries of one node.  Leaves: objects; inner pages: the pivots of the pages below."""

    objects: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray | None = None
    below: list["Page"] | None = None


class MTree:
    """An M-tree over the rows of points, bulk-loaded by recursive assignment to pivots."""

    def __init__(self, points: np.ndarray, page: int = PAGE):
        self.points, self.page = points, page
        self.pivot = 0
        self.root = self._load(np.arange(len(points)), 0)
        self.computed = 0

    def _distance(self, objects: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[objects] - to) ** 2).sum(axis=1), 0.0))

    def _load(self, objects: np.ndarray, pivot: int) -> Page:
        if len(objects) <= self.page:
            return Page(objects, self._distance(objects, self.points[pivot]))
        n = min(self.page, math.ceil(len(objects) / self.page))
        pivots = objects[np.linspace(0, len(objects) - 1, n).astype(np.int64)]
        x, p = self.points[objects], self.points[pivots]
        nearest = ((x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
        groups = [objects[nearest == i] for i in range(n)]
        if max(map(len, groups)) > 0.9 * len(objects):  # alike: any cut is as good
            groups = np.array_split(objects, max(2, n))
            pivots = [g[0] for g in groups]
        kept = [(g, q) for g, q in zip(groups, pivots, strict=True) if len(g)]
        chosen = np.array([q for _, q in kept])
        radius = np.array([self._distance(g, self.points[q]).max() for g, q in kept])
        return Page(chosen, self._distance(chosen, self.points[pivot]), radius, [self._load(g, q) for g, q in kept])

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, scores_of, own: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, among objects whose score isn't below least.

        scores_of(objects): exact integer scores; least bounds the k-th score from below.
        """
        base = self._base + float(query @ query)
        reach = math.sqrt(max(base - 2 * least, 0.0)) if least > -math.inf else math.inf
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        order = 0
        first = float(np.sqrt(((self.points[self.pivot] - query) ** 2).sum()))
        waiting = [(0.0, order, first, self.root)]
        while waiting:
            bound, _, to_parent, page = heapq.heappop(waiting)
            slack = SLACK * (1 + min(reach, 1e12))
            if bound > reach + slack:
                break
            gap = np.abs(page.to_parent - to_parent)
            if page.below is None:
                near = page.objects[gap <= reach + slack]
                near = near[ids[near] != own]
                if not len(near):
                    continue
                self.computed += len(near)
                scores = scores_of(near)
                if len(best) == k:
                    some = scores >= best[0][0]
                    near, scores = near[some], scores[some]
                for s, i in zip(scores.tolist(), ids[near].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    reach = min(reach, math.sqrt(max(base - 2 * best[0][0], 0.0)))
                continue
            may = np.flatnonzero(gap - page.radius <= reach + slack)
            if not len(may):
                continue
            self.computed += len(may)
            far = self._distance(page.objects[may], query)
            for d, e in zip(far.tolist(), may.tolist(), strict=True):
                low = max(bound, d - float(page.radius[e]), 0.0)
                if low <= reach + slack:
                    order += 1
                    heapq.heappush(waiting, (low, order, d, page.below[e]))
        return [(s, -i) for s, i in best]

    _base = 0.0

    @classmethod
    def for_products(cls, vectors: np.ndarray, most: float, page: int = PAGE) -> "MTree":
        """A tree over integer vectors in which distance falls as the inner product rises."""
        x = vectors.astype(np.float64)
        tree = cls(np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))]), page)
        tree._base = most
        return tree


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, dim, norm (squared) and v (int64 components as bytes) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("_v")
            ends = np.asarray(held.offsets)
            starts, sizes = ends[:-1], np.diff(ends)
            values = held.values.to_numpy(zero_copy_only=False)  # null components become NaN
            unsound = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            sound = (unsound[ends[1:]] == unsound[starts]) & (sizes > 0) & np.asarray(held.is_valid()) & np.asarray(batch.column("_id").is_valid())
            for d in np.unique(sizes[sound]).tolist():
                rows = np.flatnonzero(sound & (sizes == d))
                x = np.floor(scale * values[starts[rows][:, None] + np.arange(d)]).astype(np.int64)
                packed = pa.Array.from_buffers(pa.binary(8 * d), len(rows), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), pa.array((x * x).sum(axis=1).astype(np.float64)), packed], ["vec_id", "dim", "norm", "v"])

    return vectors.select(F.col(vec_id).cast("long").alias("_id"), F.col(embedding).cast("array<double>").alias("_v")).mapInArrow(run, "vec_id long, dim int, norm double, v binary")


def _lift(v: np.ndarray, most: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))])


def _reach(most: float, query: np.ndarray, least: float) -> float:
    """The distance beyond which no score is as good as least, and the slack for rounding."""
    reach = math.sqrt(max(most + float(query @ query) - 2 * least, 0.0)) if least > -math.inf else math.inf
    return reach + SLACK * (1 + min(reach, 1e12))


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, most_pivots: int = MOST_PIVOTS, query_block: int = QUERY_BLOCK, costs: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k largest integer inner products.

    is_query: over a column vec_id, the rows that are queries.  With costs: query_id, shards (visited) and
    distances (computed in them) instead.
    """
    spark = vectors.sparkSession
    store.ship(spark)
    rows = store.materialise(integer_vectors(vectors, vec_id, embedding), "vectors")
    facts = {r["dim"]: (r["most"], r["queries"]) for r in rows.groupBy("dim").agg(F.max("norm").alias("most"), F.sum(is_query.cast("long")).alias("queries")).collect()}
    per_dim = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    # most_pivots rows of each dimension: WindowGroupLimit keeps that many before the shuffle
    sample: dict[int, list[tuple[bytes, int]]] = {}
    for r in rows.select("dim", "vec_id", "v", F.row_number().over(per_dim).alias("i")).where(F.col("i") <= most_pivots).collect():
        sample.setdefault(r["dim"], []).append((bytes(r["v"]), r["vec_id"]))
    known = {d: (np.array([np.frombuffer(v, np.int64) for v, _ in x]), np.array([i for _, i in x])) for d, x in sample.items()}
    pivots = {d: _lift(np.unique(x, axis=0), facts[d][0]) for d, (x, _) in known.items()}
    sent = spark.sparkContext.broadcast((pivots, known, facts))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, _, facts = sent.value
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            near, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for some in np.array_split(at, math.ceil(len(at) / 256)):  # differences, since a radius must not be rounded down
                    x = np.frombuffer(b"".join(batch.column("v").take(pa.array(some)).to_pylist()), np.int64).reshape(-1, d)
                    distance = np.sqrt(((_lift(x, facts[d][0])[:, None] - pivots[d]) ** 2).sum(axis=2))
                    near[some], far[some] = distance.argmin(axis=1), distance.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], [*batch.schema.names, "pivot", "far"])

    dealt = store.materialise(rows.mapInArrow(assign, "vec_id long, dim int, norm double, v binary, pivot int, far double"), "dealt")
    held: dict[int, dict[int, tuple[int, float]]] = {}
    for r in dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
        held.setdefault(r["dim"], {})[r["pivot"]] = (math.ceil(r["n"] / shard), r["r"])
    sent_held = spark.sparkContext.broadcast(held)  # a pair for each pivot

    def route(home: bool):
        """Ways of queries (query_id, dim, v, pivot, least) to shards: those of their own pivot, or then the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, known, facts = sent.value
            for batch in batches:
                out = []
                for i, d, v, own, least in zip(*batch.columns, strict=True):
                    i, d, own, least = i.as_py(), d.as_py(), own.as_py(), least.as_py()
                    q, by_pivot = np.frombuffer(v.as_py(), np.int64), sent_held.value[d]
                    if home:
                        scores = known[d][0][known[d][1] != i] @ q
                        least = float(np.sort(scores)[-k]) if len(scores) >= k else -math.inf
                        chosen = [own]
                    else:
                        distance = np.sqrt(((pivots[d] - np.append(q.astype(np.float64), 0.0)) ** 2).sum(axis=1))
                        reach = _reach(facts[d][0], q, least)
                        chosen = [p for p, (_, radius) in by_pivot.items() if p != own and distance[p] - radius <= reach]
                    out += [(i, d, q.tobytes(), p, s, least) for p in chosen for s in range(by_pivot[p][0])]
                columns = zip(*out, strict=True) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["query_id", "dim", "v", "pivot", "salt", "least"])

        return run

    salts = F.lit(1)
    for d, by_pivot in held.items():
        for p, (n, _) in by_pivot.items():
            if n > 1:
                salts = F.when((F.col("dim") == d) & (F.col("pivot") == p), F.lit(n)).otherwise(salts)
    blocks = max(1, math.ceil(max([q or 0 for _, q in facts.values()], default=0) / query_block))
    keys = ["dim", "pivot", "salt", "block"]
    shards = dealt.select("vec_id", "dim", "v", "pivot", F.pmod(F.xxhash64("vec_id", "v"), salts).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(shard_rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard_rows) and len(asked):
            v = np.array([np.frombuffer(x, np.int64) for x in shard_rows["v"]])
            ids = shard_rows["vec_id"].to_numpy()
            tree = MTree.for_products(v, sent.value[2][int(shard_rows["dim"].iloc[0])][0])
            for i, x, least in zip(asked["query_id"], asked["v"], asked["least"], strict=True):
                q = np.frombuffer(x, np.int64)
                before = tree.computed
                found = tree.search(np.append(q.astype(np.float64), 0.0), k, ids, lambda at, q=q: v[at] @ q, i, least)
                out += [(i, j, s, -1) for s, j in found] + [(i, 0, 0, tree.computed - before)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "computed"], dtype="int64")

    def answers(queries: DataFrame, home: bool) -> DataFrame:
        """What shards find, and a row for each visit with what it computed."""
        routed = queries.mapInArrow(route(home), "query_id long, dim int, v binary, pivot int, salt int, least double")
        routed = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        return shards.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long, computed long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.where("computed < 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    queries = dealt.where(is_query).select(F.col("vec_id").alias("query_id"), "dim", "v", "pivot")
    first = store.materialise(answers(queries.withColumn("least", F.lit(0.0)), True), "first")
    # the k-th score at home bounds what the other shards must hold
    kth = ranked(first).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    bounded = queries.join(kth, "query_id", "left").select("query_id", "dim", "v", "pivot", F.coalesce("least", F.lit(-math.inf)).alias("least"))
    found = first.unionByName(answers(bounded, False))
    return found.where("computed >= 0").groupBy("query_id").agg(F.count("*").alias("shards"), F.sum("computed").alias("distances")) if costs else ranked(found)
