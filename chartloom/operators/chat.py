"""Questions answered from the contexts, as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..providers import Answerer, Embedder
from .retrieval import search

CHAT_K = 3


def entity_ids(extracted: DataFrame, order: str | None = None, column: str = "patient_id") -> DataFrame:
    """The distinct ids with the place of their first appearance (by order, if given)."""
    numbered = extracted.select(F.col(column).cast("string").alias("patient_id"), (F.col(order) if order else F.monotonically_increasing_id()).alias("pos"))
    return numbered.groupBy("patient_id").agg(F.min("pos").alias("pos"))


def detect_entity(questions: DataFrame, ids: DataFrame, question: str = "question", most_broadcast: int = 100_000) -> DataFrame:
    """questions with the first id, by appearance, that their text contains; null without one.

    Containment is kept as it is: p1 is found in p12.  Ids are broadcast in chunks of most_broadcast.
    """
    known = ids.where("patient_id is not null").select(F.col("patient_id").alias("_id"), "pos")
    chunks = max(1, -(-known.count() // max(most_broadcast, 1)))
    first = F.lit(None).cast(known.select(F.struct("pos", "_id").alias("x")).schema["x"].dataType)
    found = questions.withColumn("_first", first)
    for i in range(chunks):
        # a chunk is one row: an array of ids in order; nothing is shuffled, and each question is read in its row
        part = known if chunks == 1 else known.where(F.pmod(F.xxhash64("_id"), F.lit(chunks)) == i)
        listed = part.agg(F.sort_array(F.collect_list(F.struct("pos", "_id"))).alias("_ids"))
        hit = F.get(F.filter("_ids", lambda x: F.contains(F.col(question), x["_id"])), F.lit(0))
        found = found.crossJoin(F.broadcast(listed)).withColumn("_first", F.least("_first", hit)).drop("_ids")
    return found.select(*questions.columns, F.col("_first._id").alias("patient_id"))


def answer_questions(questions: DataFrame, contexts: DataFrame, embedder: Embedder, answerer: Answerer, k: int = CHAT_K) -> DataFrame:
    """question_id, question, patient_id, answer and hits (rank, score, context_id, context).

    questions: question_id, question and patient_id; an empty or null patient_id searches all contexts.  Questions
    without a hit get the fixed sentence, without a call.
    """
    asked = questions.select("question_id", "question", F.nullif(F.col("patient_id"), F.lit("")).alias("asked_id")).withColumn("query_embedding", embedder.column(F.col("question")))
    one = search(contexts.withColumn("asked_id", F.col("patient_id")), asked.where("asked_id is not null").select("question_id", "asked_id", "query_embedding"), ["asked_id"], ["question_id"], k)
    # the questions without a patient are what stands against the whole collection, in blocks of rows
    every = search(contexts, asked.where("asked_id is null").select("question_id", "query_embedding"), [], ["question_id"], k)
    best = one.drop("asked_id").unionByName(every)
    block = prompts.answer_block(F.col("score"), F.col("context"), F.col("patient_id"), F.col("feature_name"), F.col("pdf_source"))
    hits = F.array_sort(F.collect_list(F.struct("rank", "score", "context_id", "context"))).alias("hits")
    joined = best.groupBy("question_id").agg(prompts.joined_blocks(F.col("rank"), block, "\n", "").alias("block"), hits)

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for asked_prompts in batches:
            out = []
            for p in asked_prompts:
                try:
                    out.append(prompts.NOTHING_FOUND if p is None else answerer.answer(p))
                except Exception:
                    out.append(prompts.ANSWER_FAILED)
            yield pd.Series(out, dtype=object)

    rows = asked.select("question_id", "question", "asked_id").join(joined, "question_id", "left")
    return rows.select("question_id", "question", F.col("asked_id").alias("patient_id"), reply(prompts.answer_prompt(F.col("question"), F.col("block"))).alias("answer"), "hits")
