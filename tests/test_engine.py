"""Resolution, retrieval, cascade, matrix, chat, definitions, sources and the whole extraction."""

import os

import pytest
from pyspark.sql import functions as F

from chartloom import cli, config, providers
from chartloom.operators import cascade, chat, definitions, matrix, resolution, retrieval
from chartloom.plans.authoring import Authoring
from chartloom.plans.extraction import Extraction
from chartloom.sources import features as feature_source
from chartloom.sources import notes, sinks, synthetic
from chartloom.streaming import ingest

FULL = {"description": "d", "input_prompt": "q", "expected_output_type": "string", "expected_range": "any"}


def test_resolution(spark):
    labels = resolution.distinct_references(feature_source.features_from_list(spark, [{"name": "a", "reference": "summary", "fallback_category_1": "Imaging", "fallback_category_2": ""}, {"name": "b"}, {"name": "c", "reference": "summary"}]))
    assert [(r[0], r[1]) for r in labels.orderBy("ref_pos").collect()] == [("summary", 0), ("Imaging", 1), ("", 2)]
    files = spark.createDataFrame([("p", "Summary_2025.pdf"), ("p", "summary.pdf"), ("p", "a.PDF"), ("q", "b.pdf"), ("r", "x.PDF")], "patient_id string, pdf_source string")
    found = resolution.resolve_references(files, labels)
    assert {(r[0], r[1], r[3]) for r in found.collect()} == {("p", "summary", "summary.pdf"), ("p", "Imaging", "Summary_2025.pdf"), ("p", "", "Summary_2025.pdf"), ("q", "summary", "b.pdf"), ("q", "Imaging", "b.pdf"), ("q", "", "b.pdf")}
    assert {(r["patient_id"], r["pdf_source"], r["reference"]) for r in resolution.claim_once(found).collect()} == {("p", "summary.pdf", "summary"), ("p", "Summary_2025.pdf", "Imaging"), ("q", "b.pdf", "summary")}


def test_cascade_rules(spark):
    rows = [("Missing", "x", "y", "z", "", "f", True), ("Missing", "missing", " MISSING", "z", "f", "f", True), ("Error in processing", "x", "y", "z", "f", "f", True), ("Missing", "a", "b", "z", "", "", None), ("v", "a", "b", "c", "f", "f", True)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, f string, g string, e boolean")
    out = df.select(cascade.resolve_cascade(*(F.col(x) for x in "abcdfge")).alias("r")).collect()
    assert [r["r"] for r in out] == ["y", "z", "Error in processing", "Missing", "v"]


def test_answerer_is_called_no_more_than_needed(spark, tmp_path):
    log = str(tmp_path / "calls")

    class Counting:
        def answer(self, prompt):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            if prompt == "fail":
                raise RuntimeError
            return "Missing" if prompt == "none" else prompt

    rows = [("hit", "x", "x", "x", "f", "f", True), ("none", None, "hit2", "x", "f", "f", True), ("fail", "x", "x", "x", "f", "f", True), (None, None, None, None, "f", "f", True)]
    df = spark.createDataFrame(rows, "prompt_0 string, prompt_1 string, prompt_2 string, prompt_3 string, fallback_category_1 string, fallback_category_2 string, search_everywhere boolean").coalesce(1)
    assert [r["value_raw"] for r in cascade.answer_cascade(df, Counting()).collect()] == ["hit", "hit2", "Error in processing", "Missing"]
    assert open(log).read().split() == ["hit", "none", "hit2", "fail"]


def test_retrieval(spark):
    rows = [("p", "f", "r", "b", "x", [1.0, 0.0]), ("p", "f", "r", "a", "x", [2.0, 0.0]), ("p", "g", "r", "c", "x", [0.0, 1.0]), ("q", "f", "r", "d", "x", [0.0, 0.0]), ("q", "f", "r", "e", "x", None)]
    held = spark.createDataFrame(rows, "patient_id string, feature_name string, reference string, context_id string, context string, embedding array<float>")
    asked = spark.createDataFrame([("p", "f", "r", [1.0, 0.0]), ("p", "h", "r", [0.0, 3.0])], "patient_id string, feature_name string, reference string, query_embedding array<float>")
    got = retrieval.search_relaxed(held, asked, 2)
    assert sorted((r["feature_name"], r["tier"], r["rank"], r["context_id"], round(r["score"], 6)) for r in got.collect()) == [("f", 0, 1, "a", 1.0), ("f", 0, 2, "b", 1.0), ("h", 1, 1, "c", 1.0), ("h", 1, 2, "a", 0.0)]
    assert [r["context_id"] for r in retrieval.search_global(held, [1.0, 0.0], 3, "").orderBy("rank").collect()] == ["a", "b", "c"]
    assert "WindowGroupLimit" in retrieval.top_k(held.withColumn("score", F.lit(1.0)), ["patient_id"], 1)._jdf.queryExecution().toString()


def test_matrix(spark):
    rows = [("p", "a", 0, "('x', 'y')"), ("p", "b", 1, "v"), ("p", "a", 2, "last"), ("q", "a", 0, "('bad')")]
    answers = matrix.with_clean_values(spark.createDataFrame(rows, "patient_id string, feature_name string, pos int, value_raw string"))
    assert {tuple(r) for r in matrix.wide_rows(answers, ["a", "b", "a"]).collect()} == {("p", "last", "v"), ("q", None, None)}
    assert {tuple(r) for r in matrix.wide_rows(answers, ["a", "b"], compat=True).collect()} == {("p", "last", "v")}


def test_detect_entity(spark):
    ids = chat.entity_ids(spark.createDataFrame([("p1", 1), ("p12", 0), ("p1", 5)], "patient_id string, pos int"), "pos")
    asked = spark.createDataFrame([(0, "of p12?"), (1, "p1 now"), (2, "none"), (3, None)], "question_id int, question string")
    for most in (10, 0):
        assert {r["question_id"]: r["patient_id"] for r in chat.detect_entity(asked, ids, most_broadcast=most).collect()} == {0: "p12", 1: "p1", 2: None, 3: None}


def test_definitions(spark):
    new = feature_source.features_from_list(spark, [{"name": "PD-L1 level", "regex_patterns": None}, {"name": "x_9"}, {"name": "dose", "type": "Numeric (mg, 0-80)"}])
    base = feature_source.features_from_list(spark, [{"name": "age_4"}, {"name": "7"}])
    assert definitions.highest_number(base).first()[0] == 7
    assert [r["name"] for r in definitions.numbered(new, base).orderBy("pos").collect()] == ["pd-l1_level_8", "x_9", "dose_9"]
    both = {r["name"]: r for r in definitions.combined(base, new).collect()}
    assert [r for r in both] and both["dose_9"]["unit"] == "mg" and both["dose_9"]["expected_range"] == "0-80" and both["dose_9"]["expected_output_type"] == "numeric"
    assert both["PD-L1_level_8"]["regex_patterns"] == [r"(?i)PD-L1 level[:\s]*(.*?)", r"(?i)\bPD-L1 level\b"]
    saved = definitions.saved_defaults(feature_source.features_from_list(spark, [{"description": "d"}])).first()
    assert (saved["name"], saved["unit"], saved["search_everywhere"]) == ("unknown_feature_1", "N/A", True)
    shown = definitions.display_batch(new).first()[0]
    assert shown.startswith("* **Pd-L1 Level**\n   * Description: ") and "* **X**" in shown
    assert definitions.display_batch(new.limit(0)).first()[0] == "No features available."
    batch = definitions.batch_names(definitions.batch_of(new, 2)).first()
    assert batch["names"] == ["PD-L1 level", "x_9", "dose"] and batch["entity_feature_count"] == 3
    left = definitions.without_known(new, definitions.names_to_avoid(base, spark.createDataFrame([("Dose",)], "name string")))
    assert {r["name"] for r in left.collect()} == {"PD-L1 level", "x_9"}
    assert definitions.config_name("Lung Cancer") == "lung_cancer_feature_config.json"


def test_feature_files(spark, tmp_path):
    path = str(tmp_path / "new" / "config.json")
    assert feature_source.save_config([{"name": "a", **FULL, "search_everywhere": "no"}], path)
    loaded = feature_source.load_features(spark, path).first()
    assert loaded["search_everywhere"] is True and loaded["regex_patterns"] is None
    assert feature_source.read_config(str(tmp_path / "absent")) == []
    (tmp_path / "bad").write_text("[1]")
    with pytest.raises(ValueError):
        feature_source.read_config(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        feature_source.load_features(spark, [{"name": "a"}])


def test_csv_keeps_texts_and_ids(spark, tmp_path):
    rows = [("00123", "a.pdf", "r", 'x "y", \n z'), ("7", "b.pdf", "", "plain")]
    df = spark.createDataFrame(rows, "patient_id string, pdf_source string, reference string, markdown_text string")
    assert sinks.save_raw_notes(df, str(tmp_path / "raw"))
    assert {tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "raw")).fillna("").collect()} == set(rows)
    assert sinks.read_csv(spark, str(tmp_path / "absent")) is None


def test_synthetic_notes_and_pdf(spark, tmp_path):
    texts = {r["pdf_source"]: r["markdown_text"] for r in synthetic.synthetic_notes(spark).collect()}
    assert "05/02/2024" in texts["imaging.pdf"] and "{" not in "".join(texts.values()) and "He came in on 06/28/2024" in texts["summary.pdf"]
    folder = synthetic.write_synthetic_notes(spark, str(tmp_path / "p7"))
    assert open(os.path.join(folder, "summary.pdf"), "rb").read().startswith(b"%PDF-1.4")
    files = notes.with_patients(notes.pdf_files(spark, folder), folder)
    assert {(r["patient_id"], r["pdf_source"]) for r in files.collect()} == {("p7", f"{k}.pdf") for k in synthetic.NOTES}

    class Broken:
        def pages(self, content):
            raise ValueError("no")

    class Fixed:
        def pages(self, content):
            return [("text", [[["h", None], ["1", "2"]]])]

    assert notes.pdf_to_markdown(files, Broken()).where("error is null").count() == 0
    good = notes.readable(notes.pdf_to_markdown(files, Broken(), Fixed())).where("pdf_source = 'summary.pdf'").first()
    assert good["markdown_text"] == "# summary\n\n## Page 1\n\ntext\n\n| h |  |\n| --- | --- |\n| 1 | 2 |\n\n"
    assert notes.not_yet_converted(files.drop("content"), files.limit(1)).count() == 3
    synthetic.write_synthetic_notes(spark, str(tmp_path / "md"), pdf=False)
    assert {r["patient_id"] for r in notes.notes_from_markdown(spark, str(tmp_path / "md")).collect()} == set(synthetic.NOTES)


def test_whole_extraction_and_chat(spark):
    features = [
        {"name": "size", **FULL, "reference": "pathology", "regex_patterns": [r"tumor size: [0-9.]+", "("]},
        {"name": "ecog", **FULL, "reference": "surgery", "search_everywhere": True, "regex_patterns": [r"ECOG status: \d"]},
        {"name": "none", **FULL, "reference": "summary", "regex_patterns": ["zebra"]},
    ]
    engine = Extraction(spark, features, collection="contexts_test")
    wide = engine.run_notes(synthetic.synthetic_notes(spark))
    assert wide.columns == ["patient_id", "size", "ecog", "none"] and wide.count() == 1
    row = wide.first()
    assert row["size"].startswith("PATHOLOGY") and row["ecog"] != "Missing" and row["none"] != ""
    asked = spark.createDataFrame([(1, "What of 40217736?"), (2, "anything")], "question_id int, question string")
    answers = {r["question_id"]: r for r in engine.chat(asked, wide).collect()}
    assert answers[1]["patient_id"] == "40217736" and answers[1]["hits"] and answers[2]["hits"]
    assert "[REDACTED]" in "".join(r["context"] for r in spark.table("contexts_test").collect())
    asked, said = iter(["", "What of 40217736?", " EXIT "]), []
    cli.converse(spark, engine, "/no/such/table", True, lambda _: next(asked), said.append)
    assert len(said) > 1 and said[1].startswith("Result 1 (score: ")


def test_cli_looks_for_pdf_files(tmp_path):
    assert not cli.has_pdf(str(tmp_path)) and not cli.has_pdf(str(tmp_path / "absent"))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.PDF").write_bytes(b"")
    assert cli.has_pdf(str(tmp_path))


def test_stream_finds_the_same_snippets(spark, tmp_path):
    rows = synthetic.synthetic_notes(spark).withColumn("arrived", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    features = feature_source.features_from_list(spark, [{"name": "size", **FULL, "regex_patterns": ["mass"]}])
    ingest.stream_contexts(ingest.note_stream(spark, str(tmp_path / "in")), features, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    from chartloom.operators.contexts import extract_contexts

    assert spark.read.parquet(str(tmp_path / "out")).count() == extract_contexts(synthetic.synthetic_notes(spark), features).count() > 0


def test_environment(monkeypatch, tmp_path):
    monkeypatch.setenv("GROQ_API_KEY", "k")
    assert config.get_api_key_for_platform("Groq") == "k"
    with pytest.raises(ValueError):
        config.get_api_key_for_platform("other")
    with pytest.raises(ValueError):
        config.get_env_var("CHARTLOOM_ABSENT", required=True)
    config.configure_logging("WARNING", str(tmp_path / "log" / "x.log"), console=False).warning("hello")
    assert "hello" in (tmp_path / "log" / "x.log").read_text()


def test_default_embedder(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(providers.HashingEmbedder(16).column(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in df[0]["v"]) - 1) < 1e-6 and not any(df[1]["v"]) and len(df[2]["v"]) == 16


def test_authoring(spark, tmp_path):
    class Said:
        prompts, replies = [], iter(['Here:\n```json\n{"entity_specific_features": [{"name": "EGFR status", "description": "d"}, {"name": "age"}]}\n```', "no json", '{"entity_specific_features": [{"name": "dose_9"}]}'])

        def generate(self, prompt):
            self.prompts.append(prompt)
            return next(self.replies)

    base = [{"name": "age_4", **FULL}]
    made = Authoring(spark, base, Said())
    first = made.propose("lung cancer", batch_number=1, previously_suggested=["Stage"]).first()
    assert [f["name"] for f in first["entity_specific_features"]] == ["egfr_status_5", "age_6"] and first["entity_feature_count"] == 2 and first["error"] is None
    assert first["entity_specific_features"][0]["expected_range"] == "Positive, Negative, Unknown" and "**Egfr Status**" in made.show()
    assert made.propose("lung cancer", batch_number=2).first()["error"] == "The proposal couldn't be read."
    assert made.show() == "No features available."
    assert made.propose("lung cancer", batch_number=3).first()["entity_feature_count"] == 3
    assert made.propose("lung cancer", batch_number=4).first()["error"].startswith("No features")
    assert "Suggested already: age, stage" in Said.prompts[0] and "11 to 15" in Said.prompts[2] and "egfr" in Said.prompts[2]
    assert [r["name"] for r in made.combined().orderBy("pos").collect()] == ["age_4", "egfr_status_5", "age_6", "dose_9"]
    kept = Authoring(spark, base, type("One", (), {"generate": lambda self, p: '{"entity_specific_features": [{"name": "Age"}, {"name": "x"}]}'})(), filter_known=True)
    assert [f["name"] for f in kept.propose("e").first()["entity_specific_features"]] == ["x_5"]
    for i, text in enumerate(['{"entity_specific_features": [{"name": "b"}]}', '{"entity_specific_features": []}']):
        (tmp_path / str(i)).write_text(text)
    said = []
    files = cli.FileGenerator([str(tmp_path / "0"), str(tmp_path / "1")])
    answers = iter(["yes", "no"])
    path = cli.author(Authoring(spark, base, files), "Lung Cancer", "", str(tmp_path / "config"), lambda _: next(answers), said.append)
    assert [f["name"] for f in feature_source.read_config(path)] == ["age_4", "b_5"] and said[1] == "No features available."


def test_converted_notes_are_kept(spark, tmp_path):
    folder = synthetic.write_synthetic_notes(spark, str(tmp_path / "p7"))
    log = str(tmp_path / "calls")

    class Logged:
        def pages(self, content):
            with open(log, "a") as f:
                f.write(".")
            return [("Seen by Jane Roe. tumor size: 3", [])]

    class Broken:
        def pages(self, content):
            raise ValueError("no")

    engine = Extraction(spark, [{"name": "size", **FULL, "reference": "pathology", "regex_patterns": ["tumor size: [0-9]"]}], collection="contexts_kept", parser=Broken(), second_parser=Logged(), notes_table="notes_kept")
    engine.clear_notes()
    n = len(synthetic.NOTES)
    wide = engine.run_folder(folder)
    assert wide.count() == 1 and wide.first()["size"] == "# pathology" and len(open(log).read()) == n
    assert "tumor size: 3" in spark.table("contexts_kept").first()["context"]
    assert {r["markdown_text"].count("Roe") for r in spark.table("notes_kept").collect()} == {0}
    assert engine.run_folder(folder).count() == 1 and len(open(log).read()) == n
    assert engine.run_folder(folder, use_cache=False).count() == 1 and len(open(log).read()) == 2 * n
    assert spark.table("notes_kept").count() == 2 * n and spark.table("contexts_kept").count() == 1
    engine.clear_notes()
    assert not spark.catalog.tableExists("notes_kept")
