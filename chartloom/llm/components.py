"""Connected components by alternating large-star and small-star, on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Rows of one key from which it counts as heavy, if no more than MOST_HEAVY keys can.
HEAVY_ROWS = 500
#: Heavy keys that may be broadcast: with 24 bytes each, 1.2 MB.
MOST_HEAVY = 50_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, fact: str, n_rows: int, spread: str) -> DataFrame:
    """rows with the column ``fact`` of the row of facts that has the same key, null where there is none.

    facts: key, fact and k, the number of rows with that key, of which there are n_rows in all.  Keys with
    so many rows that only MOST_HEAVY can exist meet a broadcast; their rows are then dealt by ``spread``
    instead of their key, so no key's rows come together in one task.
    """
    heavy_from = max(HEAVY_ROWS, n_rows // MOST_HEAVY)
    heavy = facts.where(F.col("k") > heavy_from).select(F.col(key).alias("_heavy"), F.col(fact).alias("_of_heavy"))
    light = facts.where(F.col("k") <= heavy_from).select(F.col(key).alias("_light"), F.col(fact).alias("_of_light"))
    dealt = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    # a heavy row may meet a light key by chance; its own fact comes first
    by = F.when(F.col("_heavy").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.xxhash64(spread))
    met = dealt.withColumn("_by", by).join(light, F.col("_by") == F.col("_light"), "left")
    of_light = F.when(F.col("_by") == F.col(key), F.col("_of_light"))
    return met.withColumn(fact, F.when(F.col("_heavy").isNotNull(), F.col("_of_heavy")).otherwise(of_light)).select(*rows.columns, fact)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node and component (the least node reachable) for every node that has an edge.

    Edges with a null end or two equal ends say nothing and are dropped; repeated edges
    count once; without edges the result is empty.  Each round keeps one table of edges
    in the shared folder; minima are combined before the shuffle and the edges of hubs
    meet a broadcast, so no neighbourhood is gathered.
    """
    spark = edges.sparkSession
    ends = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull())
    now = store.materialise(ends.where("u <> v").distinct(), "edges")
    state = _state(now)
    while True:
        n = state[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
        large = join_facts(both.where("v > u"), least, "u", "m", 2 * n, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store.materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = join_facts(large, least, "u", "m", 2 * n, "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store.materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        store.remove(spark, now, large)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
