"""From raw documents to token counts: five stages, each written as Parquet and read again.

Each function takes (spark, docs, sf_dir) and works on every row of docs; all but the last
return the columns of documents.  A stage begins with executors that hold nothing of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import bpe, decontam, minhash, quality, store, toxicity

#: A score from which a document counts as toxic.
TOXIC_FROM = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold; labels of all ids in docs take part."""
    store.rest(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # a document travels as one struct, so that its columns' names can't clash with a stage's;
    # decisions go by id and text, so that rows sharing an id, or without one, are told apart
    key = F.xxhash64("doc_id", "text")
    held = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"))
    judged = quality.classify(docs.select("doc_id", "lang", "text", key.alias("key")), labels, keep=["key"])
    rejected = judged.where(~F.col("accepted")).select("key").distinct()
    return held.join(rejected, "key", "left_anti").select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM; labels of all ids in docs may train."""
    store.rest(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels, F.lit(True))
    held = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return toxicity.score(held, model).where(F.col("score") < TOXIC_FROM).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8."""
    store.rest(spark)
    return minhash.deduplicate(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without what passages of the benchmark they hold; DataFrame operations only."""
    store.rest(spark, python=False)
    clean = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of ids, their digest, and that of the bytes they decode to."""
    store.rest(spark)
    made = {"text", "n_tokens", "ids_sha256", "decoded_sha256"}
    return bpe.round_trip(docs, keep=[c for c in docs.columns if c not in made])


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level bpe", encode),
]

#: Models and components can't be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; every stage before is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
