"""Queries of the extraction engine over the driver's tables, and their DuckDB SQL.

documents stand for notes (source: the patient), embeddings for contexts (label: the
patient), conversations for questions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import prompts
from .functions.text import clean_value, name_candidates
from .operators import cascade, chat, contexts, definitions, matrix, redaction, resolution, retrieval
from .plans.extraction import Extraction
from .providers import HashingEmbedder, SnippetAnswerer
from .sources import sinks
from .sources.features import features_from_list
from .sources.synthetic import event_dates

#: Inline feature definitions whose patterns occur in the tables.
FEATURES = [
    {"name": "license", "description": "License named", "input_prompt": "Which license?", "expected_output_type": "string", "expected_range": "any", "reference": "summary", "regex_patterns": ["license"]},
    {"name": "phone", "description": "Phone number", "input_prompt": "Which number?", "expected_output_type": "string", "expected_range": "any", "reference": "summary", "regex_patterns": ["[0-9]{3}-[0-9]{4}"]},
    {"name": "contact", "description": "Address", "input_prompt": "Which address?", "expected_output_type": "string", "expected_range": "any", "reference": "notes", "regex_patterns": ["@"]},
    {"name": "article", "description": "Word before an article", "input_prompt": "Which word?", "expected_output_type": "string", "expected_range": "any", "reference": "notes", "regex_patterns": ["[a-z]+ the"]},
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _notes(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    # a small file is one task; matching is what costs, so rows are spread first
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("patient_id"), F.col("text").alias("markdown_text"), *more)
    return docs if docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else docs.repartition(spark.sparkContext.defaultParallelism)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.extract_contexts(_notes(spark, sf_dir), features_from_list(spark, FEATURES))


def regex_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of every pattern in every document, with its place."""
    from .functions.patterns import compile_pattern, find_matches

    patterns = [compile_pattern(spark, f["regex_patterns"][0]) for f in FEATURES]
    return find_matches(_notes(spark, sf_dir), patterns, "markdown_text", ["doc_id"]).select("doc_id", "pattern_no", "match_no", "match_start", "matched_text")


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippet around every match."""
    return _contexts(spark, sf_dir).select("doc_id", "feature_name", "match_no", "match_start", "matched_text", "context")


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.context_counts(_contexts(spark, sf_dir), "doc_id", "feature_name")


def patient_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.context_counts(_contexts(spark, sf_dir), "patient_id")


def name_candidates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate names of every document, sorted."""
    return _notes(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(name_candidates(F.col("markdown_text"))), "|").alias("names"))


def redact_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its candidate names replaced."""
    return redaction.redact_notes(_notes(spark, sf_dir)).select("doc_id", "markdown_text", F.regexp_count("markdown_text", F.lit(r"\[REDACTED\]")).cast("long").alias("n_redacted"))


def raw_notes_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("patient_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("pdf_source"), F.col("lang").alias("reference"), F.col("text").alias("markdown_text"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 50 == 0, F.col("lang")).otherwise(F.concat(F.initcap("lang"), F.lit("_"), F.col("doc_id").cast("string"))), F.lit(".pdf"))
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("patient_id"), name.alias("pdf_source")).distinct()


_LABELS = [
    {"name": "a", "reference": "en", "fallback_category_1": "de", "fallback_category_2": ""},
    {"name": "b", "reference": "summary", "fallback_category_1": "", "fallback_category_2": "fr"},
    {"name": "c", "fallback_category_1": "en", "fallback_category_2": "es"},
]


def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that stands for each label of each patient, and whether the label may claim it."""
    resolved = resolution.resolve_references(_files(spark, sf_dir), resolution.distinct_references(features_from_list(spark, _LABELS)))
    claimed = resolution.claim_once(resolved).select("patient_id", "reference", F.lit(True).alias("claimed"))
    return resolved.join(claimed, ["patient_id", "reference"], "left").select("patient_id", "reference", "ref_pos", "pdf_source", F.coalesce("claimed", F.lit(False)).alias("claimed"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "embeddings")
    of = lambda n, c: (F.col("vec_id") % n).cast("string").alias(c)
    held = rows.select(F.col("label").cast("string").alias("patient_id"), of(7, "feature_name"), of(3, "reference"), F.col("vec_id").alias("context_id"), "embedding")
    asked = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("patient_id"), of(11, "feature_name"), of(3, "reference"), F.col("embedding").alias("query_embedding"))
    return held, asked


def topk_by_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 nearest contexts of each query's patient."""
    held, asked = _vectors(spark, sf_dir)
    found = retrieval.search(held, asked.select("query_id", "patient_id", "query_embedding"), ["patient_id"], ["query_id"], 3, digits=6)
    return found.select("query_id", "patient_id", "context_id", "score", F.col("rank").cast("long").alias("rank"))


def topk_patient_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest contexts of each query's patient."""
    held, asked = _vectors(spark, sf_dir)
    found = retrieval.search(held, asked.select("query_id", "patient_id", "query_embedding"), ["patient_id"], ["query_id"], cascade.EVERYWHERE_K, digits=6)
    return found.select("query_id", "patient_id", "context_id", "score", F.col("rank").cast("long").alias("rank"))


def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 nearest contexts of each query among all: the query set against all rows."""
    held, asked = _vectors(spark, sf_dir)
    found = retrieval.search(held, asked.select("query_id", "query_embedding"), [], ["query_id"], 3, digits=6)
    return found.select("query_id", "context_id", "score", F.col("rank").cast("long").alias("rank"))


def topk_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 for patient, feature and reference; for patient and reference where that is empty."""
    held, asked = _vectors(spark, sf_dir)
    by = ["patient_id", "feature_name", "reference"]
    one = asked.groupBy(*by).agg(F.min_by("query_embedding", "query_id").alias("query_embedding"))
    return retrieval.search_relaxed(held, one, 3, digits=6).select(*by, "context_id", "score", F.col("rank").cast("long").alias("rank"), F.col("tier").cast("long").alias("tier"))


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined context blocks of each query."""
    found = topk_by_patient(spark, sf_dir)
    block = prompts.context_block(F.col("score"), F.concat(F.lit("context "), F.col("context_id").cast("string")))
    return found.groupBy("query_id").agg(F.when(F.count(block) > 0, prompts.joined_blocks(F.col("rank"), block)).alias("block"))


def _level(i: int) -> Column:
    return F.when(F.pmod(F.col("doc_id").bitwiseXOR(F.lit(i * 37)), F.lit(i + 2)) == 0, F.lit(" MISSING ")).when(F.col("doc_id") % 13 == i, F.lit(prompts.FAILED)).otherwise(F.concat(F.lit(f"level {i}: "), F.col("lang")))


def fallback_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fallback = lambda n: F.when(F.col("doc_id") % n != 0, F.col("source")).otherwise("")
    return docs.select("doc_id", cascade.resolve_cascade(*(_level(i) for i in range(4)), fallback(4), fallback(6), F.col("doc_id") % 2 == 0).alias("answer"))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each patient with the number of snippets of each feature, "Missing" without any."""
    counted = contexts.context_counts(_contexts(spark, sf_dir), "patient_id", "feature_name")
    grid = matrix.result_grid(_table(spark, sf_dir, "documents").select(F.col("source").alias("patient_id")), features_from_list(spark, FEATURES))
    answers = grid.join(counted, ["patient_id", "feature_name"], "left").withColumn("value_raw", F.coalesce(F.col("n_contexts").cast("string"), F.lit(prompts.MISSING)))
    return matrix.wide_rows(matrix.with_clean_values(answers), [f["name"] for f in FEATURES])


_CASCADE = [
    FEATURES[0] | {"reference": "en", "fallback_category_1": "de", "fallback_category_2": "fr"},
    FEATURES[1] | {"reference": "fr", "fallback_category_1": "", "fallback_category_2": "es", "search_everywhere": True},
    FEATURES[2] | {"reference": "none", "fallback_category_1": "", "fallback_category_2": ""},
    FEATURES[3] | {"reference": "none", "fallback_category_1": "", "fallback_category_2": "none", "search_everywhere": True},
    {"name": "absent", "description": "Nothing has it", "input_prompt": "Which?", "expected_output_type": "string", "expected_range": "any", "reference": "es", "fallback_category_1": "none", "fallback_category_2": "de", "regex_patterns": ["zzqx"]},
]


class LetterEmbedder:
    """How often each letter from a to z occurs: vectors that SQL can make too."""

    def column(self, text: Column) -> Column:
        return F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: (F.length(text) - F.length(F.replace(text, F.char(c), F.lit("")))).cast("float"))


def cascade_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with retrieval, prompts and answers: every patient's features from the snippets of all documents."""
    docs = _notes(spark, sf_dir, F.col("lang").alias("reference"))
    features = features_from_list(spark, _CASCADE)
    found = contexts.extract_contexts(docs, features)
    made = F.concat_ws("-", "doc_id", "feature_pos", "match_no")
    held = found.withColumn("context_id", made).withColumn("embedding", LetterEmbedder().column(F.col("context")))
    grid = matrix.result_grid(docs.select("patient_id"), features)
    asked = cascade.cascade_prompts(grid, held, LetterEmbedder())
    return matrix.with_clean_values(cascade.answer_cascade(asked, SnippetAnswerer())).select("patient_id", "feature_name", "value")


_RAW_VALUES = ["('answer', 'Stage II')", "plain", " padded\t", "('only')", "a('b', 'c')d", "('x', ' y ', 'z')", "", "Missing"]


def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(_RAW_VALUES)), "id int, value_raw string")
    return rows.select("id", "value_raw", clean_value(F.col("value_raw")).alias("value"))


_IDS = ["and", "die", "the", "que", "le"]


def detect_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known id that each turn of a conversation contains."""
    ids = spark.createDataFrame([(x, i) for i, x in enumerate(_IDS)], "patient_id string, pos int")
    return chat.detect_entity(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), chat.entity_ids(ids, "pos"), "text").select("conv_id", "turn", "patient_id")


_BASE = [{"name": "age_1", "description": "Age"}, {"name": "Tumor size_7", "description": "Size"}, {"name": "sex", "description": "Sex"}]
_NEW = [
    {"name": "EGFR mutation", "description": "EGFR"},
    {"name": "PD-L1 expression_3", "expected_output_type": "numeric"},
    {"name": "HER2 status", "expected_range": "", "type": "Categorical (Pos, Neg)", "unit": ""},
    {"name": "dose", "type": "Numeric (mg, 0-80)"},
    {"name": "12"},
]


def feature_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, base = features_from_list(spark, _NEW), features_from_list(spark, _BASE)
    return definitions.numbered(new, base).select("pos", "name")


def feature_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = definitions.generated_defaults(definitions.numbered(features_from_list(spark, _NEW), features_from_list(spark, _BASE)))
    return made.select("pos", "name", "feature_group", "expected_output_type", "unit", "input_prompt", "expected_range", "reference", "search_everywhere")


def pattern_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = definitions.generated_defaults(definitions.numbered(features_from_list(spark, _NEW), features_from_list(spark, _BASE)))
    return made.select("pos", F.get("regex_patterns", F.lit(0)).alias("value_pattern"), F.get("regex_patterns", F.lit(1)).alias("word_pattern"))


def feature_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = definitions.combined(features_from_list(spark, _BASE), features_from_list(spark, _NEW))
    return both.select("pos", "name", "description", "expected_output_type", "unit", "expected_range")


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_from_list(spark, _NEW).select("pos", definitions.display_name(F.col("name")).alias("shown"))


def names_to_avoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.names_to_avoid(features_from_list(spark, _BASE), features_from_list(spark, _NEW))


def synthetic_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.createDataFrame([("01/22/2025",), ("02/28/2024",)], "diagnosis_date string")
    return days.select("diagnosis_date", *(v.alias(k) for k, v in event_dates(F.col("diagnosis_date")).items() if k != "current_date"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw notes written as CSV and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    shared = shared or "file://" + tempfile.mkdtemp()
    path = f"{shared}/csv-{uuid.uuid4().hex}"
    if not sinks.save_raw_notes(raw_notes_export(spark, sf_dir), path):
        raise RuntimeError("the notes couldn't be written")
    return sinks.read_csv(spark, path)


def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question to the snippets of all documents and features."""
    found = _contexts(spark, sf_dir).withColumn("context_id", F.concat_ws("-", "doc_id", "feature_name", "match_no")).withColumn("pdf_source", F.col("doc_id").cast("string"))
    embedder = HashingEmbedder(64)
    held = found.select("context_id", "patient_id", "feature_name", "pdf_source", "context").withColumn("embedding", embedder.column(F.col("context")))
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("patient_id"))
    return chat.answer_questions(asked, held, embedder, SnippetAnswerer()).select("question_id", "answer", F.size("hits").alias("n_hits"))


def extraction_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction, with every document as a note."""
    engine = Extraction(spark, FEATURES, collection="extraction_wide_contexts")
    return engine.run_notes(raw_notes_export(spark, sf_dir).drop("reference"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        regex_matches, match_counts, patient_counts, context_windows, redact_notes, raw_notes_export, reference_resolution, topk_by_patient, topk_patient_wide, topk_global, topk_relaxed, prompt_blocks, fallback_cascade, cascade_answers, feature_matrix, clean_values,
        detect_entity, feature_numbering, feature_defaults, pattern_synthesis, feature_union, display_names, names_to_avoid, synthetic_dates, csv_round_trip, chat_answers, extraction_wide,
    )
} | {"name_candidates": name_candidates_query}


def _quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _matches_sql() -> str:
    one = """SELECT doc_id, source, text, {no} AS pattern_no, {name} AS feature_name, regexp_extract_all(text, {p}, 0) AS hits, regexp_split_to_array(text, {p}) AS gaps FROM documents"""
    parts = " UNION ALL ".join(one.format(no=i, name=_quote(f["name"]), p=_quote("(?i)" + f["regex_patterns"][0])) for i, f in enumerate(FEATURES))
    return f"""found AS ({parts}),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM found),
m AS (SELECT doc_id, source, text, pattern_no, feature_name, k - 1 AS match_no, hits[k] AS matched_text,
    CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS BIGINT) AS s FROM each)"""


_WINDOWS_SQL = """w AS (SELECT *, length(text) AS n, greatest(0, s - 200) AS l, least(length(text), s + length(matched_text) + 200) AS r FROM m),
w2 AS (SELECT *, length(regexp_extract(substring(text, greatest(0, l - 100) + 1, l - greatest(0, l - 100)), '(?s)^(.*[.!?]\\s+)[A-Z]', 1)) AS jump,
    length(regexp_extract(substring(text, r + 1, least(100, n - r)), '(?s)^(.*?[.!?])\\s', 1)) AS stop FROM w),
w3 AS (SELECT *, CASE WHEN l > 0 AND jump > 0 THEN greatest(0, l - 100) + jump ELSE l END AS b, CASE WHEN r < n AND stop > 0 THEN r + stop ELSE r END AS e FROM w2),
c AS (SELECT *, regexp_replace(substring(text, b + 1, e - b), '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g') AS context FROM w3),
ctx AS (SELECT * FROM c WHERE context <> '')"""

_COS = "round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


def _topk_sql(k: int, patient: bool) -> str:
    on = "q.label = c.label" if patient else "true"
    extra = "CAST(q.label AS VARCHAR) AS patient_id, " if patient else ""
    names = "query_id, " + ("patient_id, " if patient else "") + "context_id, score"
    return f"""WITH s AS (SELECT q.vec_id AS query_id, {extra}c.vec_id AS context_id, {_COS} AS score FROM embeddings q JOIN embeddings c ON {on} WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, context_id) AS rank FROM s)
SELECT {names}, rank FROM r WHERE rank <= {k}"""


def _relaxed_sql() -> str:
    return f"""WITH a AS (SELECT CAST(label AS VARCHAR) AS p, CAST(vec_id % 11 AS VARCHAR) AS f, CAST(vec_id % 3 AS VARCHAR) AS r, vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
q AS (SELECT p, f, r, arg_min(embedding, vec_id) AS embedding FROM a GROUP BY p, f, r),
c AS (SELECT CAST(label AS VARCHAR) AS p, CAST(vec_id % 7 AS VARCHAR) AS f, CAST(vec_id % 3 AS VARCHAR) AS r, vec_id, embedding FROM embeddings),
s AS (SELECT q.p, q.f, q.r, c.vec_id, {_COS} AS score, CASE WHEN q.f = c.f THEN 0 ELSE 1 END AS tier FROM q JOIN c ON q.p = c.p AND q.r = c.r),
t AS (SELECT *, min(tier) OVER (PARTITION BY p, f, r) AS least FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY p, f, r ORDER BY score DESC, vec_id) AS rank FROM t WHERE least = 1 OR tier = 0)
SELECT p AS patient_id, f AS feature_name, r AS reference, vec_id AS context_id, score, rank, CAST(least AS BIGINT) AS tier FROM k WHERE rank <= 3"""


def _cascade_sql() -> str:
    level = lambda i: f"CASE WHEN xor(doc_id, {i * 37}) % {i + 2} = 0 THEN ' MISSING ' WHEN doc_id % 13 = {i} THEN '{prompts.FAILED}' ELSE 'level {i}: ' || lang END"
    return f"""WITH l AS (SELECT doc_id, {', '.join(f'{level(i)} AS l{i}' for i in range(4))}, CASE WHEN doc_id % 4 <> 0 THEN source ELSE '' END AS f1, CASE WHEN doc_id % 6 <> 0 THEN source ELSE '' END AS f2 FROM documents),
a AS (SELECT *, CASE WHEN lower(trim(l0)) = 'missing' AND f1 <> '' THEN l1 ELSE l0 END AS r1 FROM l),
b AS (SELECT *, CASE WHEN lower(trim(r1)) = 'missing' AND f2 <> '' THEN l2 ELSE r1 END AS r2 FROM a)
SELECT doc_id, CASE WHEN lower(trim(r2)) = 'missing' AND doc_id % 2 = 0 THEN l3 ELSE r2 END AS answer FROM b"""


def _resolution_sql() -> str:
    return """WITH f AS (SELECT DISTINCT source AS patient_id, CASE WHEN doc_id % 50 = 0 THEN lang ELSE upper(lang[1]) || lang[2:] || '_' || doc_id END || '.pdf' AS pdf_source FROM documents),
r(reference, ref_pos) AS (VALUES ('en', 0), ('de', 1), ('summary', 2), ('fr', 3), ('', 4), ('es', 5)),
x AS (SELECT patient_id, reference, ref_pos, pdf_source, row_number() OVER (PARTITION BY patient_id, reference ORDER BY CASE WHEN pdf_source = reference || '.pdf' THEN 0 WHEN starts_with(lower(pdf_source), lower(reference)) THEN 1 ELSE 2 END, pdf_source) AS k FROM f, r)
SELECT patient_id, reference, ref_pos, pdf_source, row_number() OVER (PARTITION BY patient_id, pdf_source ORDER BY ref_pos) = 1 AS claimed FROM x WHERE k = 1"""


def _values(rows: list[dict], names: list[str]) -> str:
    listed = ", ".join(f"({i}, {', '.join(_quote(r.get(n)) for n in names)})" for i, r in enumerate(rows))
    return f"(VALUES {listed}) AS v(pos, {', '.join(names)})"


def _numbered_sql(lower: bool) -> str:
    name = "replace(coalesce(name, ''), ' ', '_')"
    fields = ["name", "description", "expected_output_type", "unit", "expected_range", "type"]
    return f"""n AS (SELECT pos, {f'lower({name})' if lower else name} AS raw, description, expected_output_type, unit, expected_range, type FROM {_values(_NEW, fields)}),
h AS (SELECT coalesce(max(TRY_CAST(regexp_extract(name, '(?:^|_)([0-9]+)$', 1) AS BIGINT)), 0) AS top FROM {_values(_BASE, ['name'])}),
x AS (SELECT *, CASE WHEN regexp_matches(raw, '_[0-9]+$') THEN raw ELSE raw || '_' || (top + sum(CASE WHEN regexp_matches(raw, '_[0-9]+$') THEN 0 ELSE 1 END) OVER (ORDER BY pos)) END AS name FROM n, h)"""


_RANGE = "CASE WHEN contains(lower(name), 'status') THEN 'Positive, Negative, Unknown' WHEN contains(lower(name), 'mutation') THEN 'Mutated, Not Mutated, Unknown' WHEN contains(lower(name), 'level') OR contains(lower(name), 'expression') THEN '0-100' ELSE 'N/A' END"


def _union_sql() -> str:
    inside = r"CASE WHEN regexp_matches(type, '\((.*?)\)') THEN regexp_extract(type, '\((.*?)\)', 1) END"
    return f"""WITH {_numbered_sql(False)},
y AS (SELECT *, coalesce(nullif(expected_output_type, ''), CASE WHEN type IS NULL THEN 'string' WHEN contains(lower(type), 'categorical') THEN 'categorical' WHEN contains(lower(type), 'numeric') THEN 'numeric' ELSE 'string' END) AS kind, {inside} AS i, coalesce(expected_range, '') = '' AS e FROM x),
z AS (SELECT *, coalesce(contains(i, ',') AND kind = 'numeric', false) AS two FROM y)
SELECT pos, name, description, CAST(NULL AS VARCHAR) AS expected_output_type, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS expected_range FROM {_values(_BASE, ['name', 'description'])}
UNION ALL SELECT pos + {len(_BASE)}, name, coalesce(nullif(description, ''), 'Description for ' || name), kind, CASE WHEN e AND two THEN trim(string_split(i, ',')[1]) ELSE coalesce(nullif(unit, ''), 'N/A') END,
    CASE WHEN e THEN CASE WHEN two THEN trim(string_split(i, ',')[2]) ELSE coalesce(i, {_RANGE}) END ELSE expected_range END FROM z"""


def _cascade_answers_sql() -> str:
    fields = ["name", "description", "input_prompt", "reference", "fallback_category_1", "fallback_category_2"]
    everywhere = ", ".join(str(i) for i, f in enumerate(_CASCADE) if f.get("search_everywhere"))
    letters = lambda t: f"list_transform(range(97, 123), lambda c: CAST(length({t}) - length(replace({t}, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"
    # of equal scores the smaller id wins; scores are rounded, since sums of doubles differ in their last digit
    best = "arg_min(context, (-round(list_cosine_similarity(v, q), 12), context_id))"
    return f"""WITH {_matches_sql()}, {_WINDOWS_SQL},
f AS (SELECT *, {letters("(description || ' ' || input_prompt)")} AS q FROM {_values(_CASCADE, fields)}),
held AS (SELECT c.source AS patient, c.feature_name, d.lang, c.doc_id || '-' || c.pattern_no || '-' || c.match_no AS context_id, c.context, {letters('c.context')} AS v FROM ctx c JOIN documents d ON c.doc_id = d.doc_id),
levels AS (SELECT pos, name, q, 0 AS level, reference FROM f UNION ALL SELECT pos, name, q, 1, fallback_category_1 FROM f UNION ALL SELECT pos, name, q, 2, fallback_category_2 FROM f),
tiers AS (SELECT patient, pos, level, CASE WHEN feature_name = name THEN 0 ELSE 1 END AS tier, {best} AS context FROM levels JOIN held ON lang = reference GROUP BY ALL),
one AS (SELECT patient, pos, level, arg_min(context, tier) AS context FROM tiers GROUP BY ALL),
every AS (SELECT patient, pos, 3 AS level, {best} AS context FROM f, held WHERE pos IN ({everywhere}) GROUP BY ALL),
answers AS (SELECT patient, pos, arg_min(trim(string_split(context, chr(10))[1], ' ' || chr(9) || chr(13)), level) AS value FROM (SELECT * FROM one UNION ALL SELECT * FROM every) GROUP BY ALL)
SELECT p.source AS patient_id, f.name AS feature_name, coalesce(a.value, 'Missing') AS value FROM (SELECT DISTINCT source FROM documents) p CROSS JOIN f LEFT JOIN answers a ON a.patient = p.source AND a.pos = f.pos"""


def _oracle() -> dict[str, str]:
    m = "WITH " + _matches_sql()
    ctx = f"{m}, {_WINDOWS_SQL} "
    pivot = ", ".join(f"coalesce(CAST(nullif(count(*) FILTER (feature_name = '{f['name']}'), 0) AS VARCHAR), 'Missing') AS {f['name']}" for f in FEATURES)
    days = {name: n for name, n in __import__("chartloom.sources.synthetic", fromlist=["EVENT_DAYS"]).EVENT_DAYS.items()}
    dated = ", ".join(f"strftime(d + INTERVAL ({n}) DAY, '%m/%d/%Y') AS {name}" for name, n in days.items())
    raw = "SELECT source AS patient_id, 'doc' || doc_id || '.pdf' AS pdf_source, lang AS reference, text AS markdown_text FROM documents"
    clean = "CASE WHEN starts_with(value_raw, '(''') AND ends_with(value_raw, ''')') THEN trim(string_split(value_raw, ',')[2], ' ''') ELSE value_raw END"
    term = "replace(name, '_', ' ')"
    kind = "coalesce(expected_output_type, 'categorical')"
    values = f"array_to_string(list_transform(string_split(coalesce(expected_range, {_RANGE}), ','), lambda v: trim(v)), '|')"
    low = "lower(name)"
    based = f"CASE WHEN regexp_matches({low}, '_[0-9]+$') THEN regexp_replace({low}, '_[0-9]+$', '') ELSE split_part({low}, '_', 1) END"
    base = _values(_BASE, ["name"])
    return {
        "regex_matches": m + " SELECT doc_id, CAST(pattern_no AS INTEGER) AS pattern_no, CAST(match_no AS INTEGER) AS match_no, CAST(s AS INTEGER) AS match_start, matched_text FROM m",
        "context_windows": ctx + "SELECT doc_id, feature_name, CAST(match_no AS INTEGER) AS match_no, CAST(s AS INTEGER) AS match_start, matched_text, context FROM ctx",
        "match_counts": ctx + "SELECT doc_id, feature_name, count(*) AS n_contexts FROM ctx GROUP BY ALL",
        "patient_counts": ctx + "SELECT source AS patient_id, count(*) AS n_contexts FROM ctx GROUP BY ALL",
        "feature_matrix": ctx + f"SELECT p.source AS patient_id, {pivot} FROM (SELECT DISTINCT source FROM documents) p LEFT JOIN ctx ON ctx.source = p.source GROUP BY p.source",
        "raw_notes_export": raw,
        "csv_round_trip": raw,
        "reference_resolution": _resolution_sql(),
        "topk_by_patient": _topk_sql(3, True),
        "topk_patient_wide": _topk_sql(5, True),
        "topk_global": _topk_sql(3, False),
        "topk_relaxed": _relaxed_sql(),
        "prompt_blocks": f"SELECT query_id, chr(10) || chr(10) || string_agg(printf('Context (similarity score: %.4f):', score) || chr(10) || 'context ' || context_id, chr(10) || chr(10) ORDER BY rank) AS block FROM ({_topk_sql(3, True)}) GROUP BY query_id",
        "fallback_cascade": _cascade_sql(),
        "cascade_answers": _cascade_answers_sql(),
        "clean_values": f"SELECT CAST(id AS INTEGER) AS id, value_raw, regexp_replace(replace(replace(replace({clean}, '(''', ''), ''', ''', ''), ''')', ''), '^\\s+|\\s+$', '', 'g') AS value FROM (VALUES {', '.join(f'({i}, {_quote(v)})' for i, v in enumerate(_RAW_VALUES))}) AS v(id, value_raw)",
        "detect_entity": f"SELECT conv_id, turn, (SELECT arg_min(id, pos) FROM (VALUES {', '.join(f'({_quote(x)}, {i})' for i, x in enumerate(_IDS))}) AS v(id, pos) WHERE contains(text, id)) AS patient_id FROM conversations",
        "feature_numbering": f"WITH {_numbered_sql(True)} SELECT pos, name FROM x",
        "feature_defaults": f"WITH {_numbered_sql(True)} SELECT pos, name, 'Biomarkers' AS feature_group, {kind} AS expected_output_type, coalesce(unit, 'N/A') AS unit, 'What is the ' || {term} || ' value?' AS input_prompt, coalesce(expected_range, {_RANGE}) AS expected_range, 'summary' AS reference, true AS search_everywhere FROM x",
        "pattern_synthesis": f"WITH {_numbered_sql(True)} SELECT pos, '(?i)' || {term} || '[:\\s]*' || CASE WHEN {kind} = 'categorical' THEN '(' || {values} || ')' ELSE '(.*?)' END AS value_pattern, '(?i)\\b' || {term} || '\\b' AS word_pattern FROM x",
        "feature_union": _union_sql(),
        "names_to_avoid": f"SELECT split_part({low}, '_', 1) AS name FROM {base} UNION SELECT {low} FROM {base} UNION SELECT {based} FROM {base} UNION SELECT replace({based}, '_', ' ') FROM {base} UNION SELECT replace({based}, ' ', '_') FROM {base} UNION SELECT {low} FROM {_values(_NEW, ['name'])}",
        "synthetic_dates": f"SELECT diagnosis_date, {dated} FROM (SELECT diagnosis_date, strptime(diagnosis_date, '%m/%d/%Y') AS d FROM (VALUES ('01/22/2025'), ('02/28/2024')) AS v(diagnosis_date))",
    }


ORACLE_SQL: dict[str, str] = _oracle()
