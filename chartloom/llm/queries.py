"""The contract queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, licenses, lm_scoring, minhash, mtree, quality, token_counts, toxicity, training_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from the folds that aren't 2."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, _fold(4) != 2)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document: 3 words, similarity 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest and known licence of every whole document."""
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known_licenses(spark), digests=licenses.known_digests(spark))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; learns from the folds that aren't 1."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _fold(5) == 1)
    scored = lm_scoring.lm_scores(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, the language's threshold and the decision for every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, hit and item counts of every document against the benchmark, in windows of 13 words."""
    return decontam.measure(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth vector with all others."""
    return mtree.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, shard, place and checksum of every sequence of every document, read from the shards written."""
    return training_order.materialise(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash": op2_minhash,
    "op3_token_counts": op3_token_counts,
    "op4_licenses": op4_licenses,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_mtree_topk": op8_mtree_topk,
    "op9_training_order": op9_training_order,
    "op10_byte_bpe": op10_byte_bpe,
}

# Fixed values of the contracts: word and window rules as DuckDB SQL.
_OP2_SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM split),
classes AS (SELECT row_number() OVER (ORDER BY min(doc_id), list_sort(s)) AS cid, min(doc_id) AS least_id, list_sort(s) AS s FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY list_sort(s)),
grams AS (SELECT cid, len(s) AS n, unnest(s) AS g FROM classes),
links AS (
    SELECT a.cid AS u, b.cid AS v FROM grams a JOIN grams b ON a.g = b.g AND a.cid < b.cid
    WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT cid AS node, cid AS seen FROM classes UNION SELECT reach.node, both_ways.v FROM reach JOIN both_ways ON reach.seen = both_ways.u),
least AS (SELECT node, min(least_id) AS component FROM reach JOIN classes ON seen = cid GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN sets.doc_id IS NOT NULL THEN coalesce(least.component, sets.doc_id) END AS component_id, coalesce(sets.doc_id = coalesce(least.component, sets.doc_id), false) AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN least ON classes.cid = least.node
"""

_OP7_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_OP7_SQL = f"""
WITH items AS (SELECT item_id, {_OP7_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 13) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, {_OP7_WORDS} AS w FROM documents),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) AS ks)),
hits AS (SELECT places.doc_id, places.i, places.k, windows.item_id FROM places JOIN windows ON places.k = windows.k AND places.win = windows.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op2_minhash": _OP2_SQL,
    "op4_licenses": licenses.scan_sql(),
    "op7_decontamination": _OP7_SQL,
    "op8_mtree_topk": _OP8_SQL,
}
