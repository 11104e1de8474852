"""Quality: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Every trusted document takes part: four fifths, by a hash of their id, make the model (``kneser_ney``), the
others the thresholds, which must come from text that the model hasn't seen.  A language's threshold is a
quantile of the perplexity of its trusted documents outside the model.  A large model is asked in blocks, so
that what the texts ask doesn't stand on disk at once.

Defined results: null and empty texts hold the end token alone; the longest texts are read whole, their
bytes in bounded steps; perplexity is drawn to the language's mean with the weight of
``PRIOR_TOKENS`` tokens, so short texts aren't rejected for noise; a language without trusted
documents (or null) takes the mean and threshold of them all; without any trusted documents all are
kept.  Labels repeated for an id count once if all say trusted; repeated documents are
judged each for itself; a null id is judged like any other, but is never trusted; an empty table gives
an empty table; columns of docs other than those named aren't read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney, ngrams, store

ORDER = 3
#: Trusted documents that may take part: all.
MOST_TRUSTED = math.inf
QUANTILE = 0.995
PRIOR_TOKENS = 10.0
#: Bytes of the model's texts for each block, and the most blocks: each one reads the texts again.
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 6
#: Ids of the model's texts that may be broadcast; more meet the texts in a join, once.
MOST_IDS = 1_000_000
#: Languages whose limits may be broadcast, at about 100 bytes each.
MOST_LANGUAGES = 100_000


def fit(trusted: DataFrame, order: int = ORDER, text: str = "text", size: int | None = None) -> tuple[kneser_ney.Model, float]:
    """A model of all texts of trusted, of 1 to 3 words, and log10 of an unknown word's probability.  size: bytes of the texts, where known."""
    store.ship(trusted.sparkSession)
    model = kneser_ney.fit(trusted, order, text, size)
    return model, model.unknown


def log_probabilities(docs: DataFrame, model: kneser_ney.Model, unknown: float, order: int = ORDER, text: str = "text", keep: list[str] | None = None, hot_keys: int = ngrams.HOT_KEYS, blocks: int = 1) -> DataFrame:
    """keep (default doc_id) with n_tokens and log10_prob of each whole text; model and unknown: of fit, for that order."""
    if (order, unknown) != (model.order, model.unknown):
        raise ValueError("not the model that was fitted")
    keep = keep if keep is not None else ["doc_id"]
    held = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"), F.xxhash64(text).alias("_key"))
    scored = kneser_ney.log_probabilities(held, model, [f"_{i}" for i in range(len(keep))], "_key", "_text", hot_keys, blocks)
    return scored.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", "log10_prob")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, blocks: int | None = None, label: str = "quality", keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """keep (default doc_id and lang) with n_tokens, log10_prob, perplexity, threshold and accepted.

    labels: label 1 marks trusted documents.  blocks: in which the model is asked, by default as its texts' size asks; the results are the same.
    """
    spark = docs.sparkSession
    store.ship(spark)
    keep = keep if keep is not None else [doc_id, lang]
    marked = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.min(F.coalesce(label, F.lit(0))) == 1).alias("_trusted")).where("_trusted")
    # a fifth of the trusted ids sets the thresholds; all others make the model
    marked = store.materialise(marked.select("_id", (F.pmod(F.xxhash64(F.lit("calibrate"), F.col("_id").cast("string")), F.lit(5)) == 0).alias("_calibrate")), "trusted")
    texts, ids = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), marked.where("not _calibrate").select("_id")
    few = ids.count() <= MOST_IDS
    training = texts.join(F.broadcast(ids) if few else ids, "_id", "left_semi")
    training = training if few else store.materialise(training, "training", "zstd")
    size = kneser_ney.bytes_of(training, "_text")
    if blocks is None:
        blocks = min(MOST_BLOCKS, 1 + size // BLOCK_BYTES)

    inner = [f"_keep{i}" for i in range(len(keep))]
    # a total depends on the text alone, so rows of one id and text may share it
    renamed = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, inner, strict=True)), F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(doc_id, text).alias("_key"))
    model, _ = fit(training, order, "_text", size)
    if not few:
        store.remove(spark, training)
    scored = kneser_ney.log_probabilities(renamed, model, [*inner, "_id", "_lang"], "_key", "_text", ngrams.HOT_KEYS, blocks)
    model.remove()
    calibration = scored.select("_id", "_lang", "n_tokens", "log10_prob").join(marked.where("_calibrate").select("_id"), "_id")

    mean = -F.sum("log10_prob") / F.sum("n_tokens")
    overall = calibration.agg(mean.alias("m")).first()["m"]
    if overall is None:
        return scored.select(*(F.col(x).alias(c) for c, x in zip(keep, inner, strict=True)), "n_tokens", "log10_prob", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")).alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("accepted"))
    # rounded, since sums of doubles in another order differ in their last digits and copies of a text must not part at the limit
    smoothed = F.round((-F.col("log10_prob") + PRIOR_TOKENS * F.coalesce("_mean", F.lit(overall))) / (F.col("n_tokens") + PRIOR_TOKENS), 9).alias("_smoothed")
    rank = F.percentile_approx("_smoothed", quantile, 100_000)
    means = calibration.where("_lang is not null").groupBy("_lang").agg(mean.alias("_mean"))
    drawn = calibration.join(_few(means), "_lang", "left").select("_lang", smoothed)
    limits = store.materialise(drawn.where("_lang is not null").groupBy("_lang").agg(rank.alias("_limit")).join(means, "_lang"), "limits")
    limit = F.coalesce("_limit", F.lit(drawn.agg(rank.alias("t")).first()["t"]))
    judged = scored.join(_few(limits), "_lang", "left").select("*", smoothed)
    perplexity, threshold = F.pow(F.lit(10.0), F.col("_smoothed")), F.pow(F.lit(10.0), limit)
    return judged.select(*(F.col(x).alias(c) for c, x in zip(keep, inner, strict=True)), "n_tokens", "log10_prob", perplexity.alias("perplexity"), threshold.alias("threshold"), (F.col("_smoothed") <= limit).alias("accepted"))


def _few(by_language: DataFrame) -> DataFrame:
    """A row for each language: broadcast while there are MOST_LANGUAGES at most, else the planner's choice."""
    return F.broadcast(by_language) if by_language.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else by_language
