import json
import os

import pytest
from pyspark.sql import functions as F

from examlake.config import EngineConfig
from examlake.functions import text as T
from examlake.operators import answers, dedup, errors, report, search, validate
from examlake.operators.parse import parse_questions
from examlake.operators.segment import question_blocks
from examlake.plans import pipeline
from examlake.sources import readers, writers
from examlake.streaming import incremental

from .test_parse import BLOCK, pages


@pytest.fixture(scope="module")
def store(spark):
    second = BLOCK.replace("#1", "#2").replace("Topic 1", "Topic 2").replace("archive", "log|file")
    third = "Question #3 Topic 2\nWhat should the operators do with the old network of the company?\nA. Remove it\nB. Renew it"
    return parse_questions(question_blocks(pages(spark, BLOCK, second, third))).cache()


def test_duplicates_are_strict_and_exact(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    rows = [("a", ten), ("b", ten.upper()), ("c", ten.replace("w9", "x")), ("d", " ".join(f"w{i}" for i in range(8))), ("e", ""), ("f", None), ("g", ten + " y")]
    got = {(r.id_1, r.id_2): r.similarity for r in dedup.duplicate_pairs(spark.createDataFrame(rows, "unique_id string, description string")).collect()}
    sets = {k: set((t or "").lower().split()) for k, t in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 > 4 * len(sets[a] | sets[b])}
    assert got == want and ("a", "d") not in got
    left = dedup.drop_duplicates_of(spark.createDataFrame(rows, "unique_id string, description string"), dedup.duplicate_pairs(spark.createDataFrame(rows, "unique_id string, description string")))
    assert {r.unique_id for r in left.collect()} == {"a", "d", "e", "f"}


def test_reports(spark, store):
    s = report.confidence_stats(store).first()
    assert (s.questions, s.high, s.medium, s.low) == (3, 2, 1, 0)
    assert report.confidence_stats(store.limit(0)).first().questions == 0
    assert [(r.value, r.questions) for r in report.by_topic(store).collect()] == [("Topic 2", 2), ("Topic 1", 1)]
    assert report.completeness(store).first().community_answers == 2
    assert [r.recommendation[:8] for r in report.recommendations(store).orderBy("rank").collect()] == ["Consider", "Communit"]
    row = report.markdown_rows(store).filter("value LIKE '%log%'").first().value
    assert "log\\|file" in row and row.startswith("| 2 | ")
    given = spark.createDataFrame([("u", "Q1_1", "C"), ("u", "Q2_2", ""), ("v", "Q1_1", "A"), ("v", "nope", "A")], "user string, unique_id string, answer string")
    assert [(r.user, r.correct, r.skipped, r.passed) for r in report.score_exam(store, given).orderBy("user").collect()] == [("u", 1, 1, False), ("v", 0, 0, False)]


def test_search(spark, store):
    ids = lambda **f: sorted(r.unique_id for r in search.filter_questions(store, search.Filters(**f)).collect())
    assert ids() == ["Q1_1", "Q2_2", "Q3_3"] and ids(search="LOG|F") == ["Q2_2"] and ids(search=".*") == []
    assert ids(topic="Topic 2", answer="C") == ["Q2_2"] and ids(confidence="medium") == ["Q3_3"] and ids(source="x") == []
    assert {(r.facet, r.value) for r in search.facet_values(store).collect()} >= {("topic", "Topic 1"), ("source", "Questions_1.pdf"), ("answer", "F")}
    out = search.export_filtered(store, search.Filters(topic="Topic 1"), "now").first()
    assert out.total_questions == 1 and json.loads(out.questions[0])["unique_id"] == "Q1_1"
    assert search.cards(store).filter("title = 'Question 3'").first().answer == "N/A"


def test_updates(spark):
    store = spark.createDataFrame([("a", "1", "old", {"A": "x"}, {"p": "1", "q": "2"}), ("b", "2", "old", None, None)], "id string, number string, description string, options map<string,string>, metadata map<string,string>")
    updates = spark.createDataFrame([("a", None, "new", None, {"p": "9", "r": "3"}), ("z", None, "x", None, None), (None, None, "x", None, None)], "id string, number string, description string, options map<string,string>, metadata map<string,string>")
    out, bad = search.merge_updates(store, updates)
    a, b = out.orderBy("id").collect()
    assert (a.number, a.description, a.options, a.metadata) == ("1", "new", {"A": "x"}, {"p": "9", "q": "2", "r": "3"}) and b.description == "old"
    assert sorted((r.id or "", r.status) for r in bad.collect()) == [("", 400), ("z", 404)]


def test_updates_of_repeated_ids(spark):
    schema = "id string, number string, description string, options map<string,string>, metadata map<string,string>"
    store = spark.createDataFrame([("a", "1", "x", None, None), ("a", "2", "y", None, None)], schema).coalesce(1)
    updates = spark.createDataFrame([("a", None, "zzz", None, None), ("a", None, "last", None, None)], schema).coalesce(1)
    out, _ = search.merge_updates(store, updates)
    assert sorted((r.number, r.description) for r in out.collect()) == [("1", "last"), ("2", "y")]


def test_exam_of_ids_in_two_sources(spark, store):
    twice = store.unionByName(store.withColumn("source", F.lit("other.pdf")).withColumn("community_answer", F.lit("E")))
    given = spark.createDataFrame([("u", "Q1_1", "other.pdf", "E"), ("v", "Q1_1", "Questions_1.pdf", "E")], "user string, unique_id string, source string, answer string")
    assert [(r.user, r.answered, r.correct) for r in report.score_exam(twice, given).orderBy("user").collect()] == [("u", 1, 1), ("v", 1, 0)]
    assert report.score_exam(twice, given.drop("source")).count() == 0


def test_unnumbered_questions_keep_their_comments(spark):
    found = pipeline.extract(pages(spark, BLOCK.replace("Question #1", "Question #")))
    ids = {r.unique_id for r in found.questions.collect()}
    assert {r.question_id for r in found.comments.collect()} <= ids


def test_validation(spark, store):
    cache = readers.pages_of_cache
    pages_ = store.select(F.col("source").alias("source_file"), "page_number", F.explode(F.array(F.lit("default"), F.lit("layout"))).alias("strategy"), F.col("raw_content").alias("text")).filter("page_number < 3")
    rows = validate.issues(store, pages_).collect()
    by = {(r.question_id, r.issue_type, r.severity) for r in rows}
    assert ("Q3_3", "pdf_access_error", "critical") in by and len([r for r in rows if r.question_id == "Q3_3"]) == 1
    assert any(r.issue_type == "text_accuracy" and 0 < r.confidence < 0.9 for r in rows)
    dirty = store.filter("unique_id = 'Q1_1'").withColumn("description", F.lit("user_a Highly Voted traOc")).withColumn("options", F.slice("options", 1, 1))
    kinds = sorted((r.issue_type, r.severity) for r in validate.issues(dirty, pages_, False).collect())
    assert kinds == [("community_pollution", "critical")] * 3 + [("missing_options", "critical"), ("ocr_error", "minor"), ("truncated_text", "major")]
    assert validate.issues(store.withColumn("page_number", F.lit(0)), pages_, False).filter("issue_type <> 'missing_metadata'").count() == 0
    s = validate.validation_scores(validate.issues(store, pages_, False), store).first()
    assert s.total == 3 and 0 <= s.quality <= 1 and s.status in ("fail", "warn", "good")
    assert validate.validation_scores(validate.issues(store, pages_, False).limit(0), store.limit(0)).first().quality == 0.0
    assert {r["class"] for r in validate.triage(store).collect()} == {"good", "major"}
    assert cache is readers.pages_of_cache


def test_model_answers(spark, store):
    calls = []

    def provider(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise answers.RateLimited
        if len(calls) == 2:
            raise ValueError("broken")
        return "Answer: B.\n\nBecause GCP does it."

    waits = []
    assert answers.ask(provider, "p", 3, waits.append) == ("Answer: B.\n\nBecause GCP does it.", None) and waits == [5, 2]
    assert answers.ask(lambda p: None, "p", 2, waits.append) == ("", "request failed")
    assert answers.ask(lambda p: 1 / 0, "p", 2, waits.append) == ("", "division by zero")
    prompts = answers.prompts(store)
    assert prompts.count() == 3 and "A. Compute Engine disks\nB." in prompts.filter("question_id = 'Q1_1'").first().prompt
    replies = answers.query_model(prompts, lambda p: "The answer is C. " + "x" * 200, EngineConfig(), lambda s: None)
    parsed = answers.parse_responses(replies)
    done = answers.apply_responses(store, parsed)
    assert done.columns == store.columns and {r.llm_answer for r in done.collect()} == {"C"}
    odd = spark.createDataFrame([("1", "Answer: The best is D. ok", None), ("2", "", "failed"), ("3", None, None), ("4", "no letters at all here", None)], "question_id string, response_text string, error string")
    assert {r.question_id: r.correct_answer for r in answers.parse_responses(odd).collect()} == {"1": "D", "2": "", "3": "", "4": ""}
    assert answers.run_counters(store, odd).first().failed == 1


def test_errors(spark, tmp_path):
    log = errors.ErrorLog()
    assert log.load_json(str(tmp_path / "none.json")) is None
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    assert log.load_json(str(bad)) is None and log.save_json({"a": 1}, str(tmp_path / "x" / "ok.json"))
    assert log.load_json(str(tmp_path / "x" / "ok.json")) == {"a": 1}
    assert not log.check_type(1, str) and not log.check_path("") and log.check_path(str(bad)) and log.check_disk("/", 0)
    waits = []
    with pytest.raises(ZeroDivisionError):
        log.retry(lambda: 1 / 0, 2, 1.0, waits.append)
    assert waits == [1.0, 2.0]
    rows = {(r.measure, r.value): r.errors for r in errors.error_summary(log.table(spark)).collect()}
    assert rows[("total", "")] == 7 and rows[("type", "ZeroDivisionError")] == 3 and rows[("severity", "WARNING")] == 3
    assert errors.last_errors(log.table(spark), 2).count() == 2
    log.append(spark, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 7


def test_sources_and_sinks(spark, store, tmp_path):
    out = pipeline.run(pages(spark, BLOCK, "nothing"), str(tmp_path / "out"))
    assert sorted(out) == ["csv", "json", "md", "summary", "web"]
    assert pipeline.run(pages(spark, "nothing"), str(tmp_path / "none")) == {}
    with pytest.warns(UserWarning, match="unknown format 'xyz'"):
        assert sorted(writers.write_all(store, str(tmp_path / "few"), ("csv", "xyz"))) == ["csv", "summary"]
    web_files = sorted(str(f) for f in (tmp_path / "out" / "web").rglob("part-*.txt"))
    document = json.loads("".join(open(f, encoding="utf-8").read() for f in web_files))
    assert document["metadata"]["total_questions"] == 1 and document["questions"][0]["answers"]["claude"] == "" and document["filters"]["sources"] == ["Questions_1.pdf"]
    table = spark.read.option("header", True).csv(out["csv"])
    assert table.columns == list(EngineConfig().columns) and table.count() == 1
    web = readers.read_web_json(spark, out["web"]).first()
    assert web.id == "Q1_1" and web.options["A"].startswith("Compute") and web.answers.community == "C"
    assert readers.source_and_page(readers.read_web_json(spark, out["web"])).first().page == 1
    assert "Total questions processed: 1" in "\n".join(r.value for r in spark.read.text(out["summary"]).collect())
    text = "\n".join(r.value for n in range(3) for r in spark.read.text(f"{out['md']}/part={n}").collect())
    assert "| Question No |" in text and "- Questions_1.pdf: 1" in text
    pages_ = store.select(F.col("source").alias("source_file"), "page_number", F.lit("default").alias("strategy"), F.col("raw_content").alias("text"))
    writers.write_comparison(store, pages_, str(tmp_path / "html"))
    writers.write_validation(validate.issues(store, pages_, False), store, str(tmp_path / "val"))
    writers.write_export(store, search.Filters(topic="Topic 2"), str(tmp_path / "exp"))
    assert json.loads(spark.read.text(str(tmp_path / "exp")).first().value)["total_questions"] == 2
    writers.write_page_dump(pages(spark, "abc"), str(tmp_path / "dump"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"k": "v"}) + "\n" + "{bad\n")
    good, bad = readers.read_json_lenient(spark, str(tmp_path / "in"), "k string")
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "a.json").write_text(json.dumps({"k": "v", "n": {"x": ["y"]}}))
    assert writers.rewrite_clean(str(tmp_path / "in2"), str(tmp_path / "in3"), spark) == 1
    assert spark.read.json(str(tmp_path / "in3")).first().n.x == ["y"]
    with pytest.raises(Exception):
        writers.rewrite_clean(str(tmp_path / "in2"), str(tmp_path / "in3"), spark)


def test_validation_report_lists_every_issue(spark, store, tmp_path):
    rows = [(f"Q{i:03}", "t", level, "d", 1 + i % 7, "s") for i in range(120) for level in ("critical", "major", "minor")]
    found = spark.createDataFrame(rows, "question_id string, issue_type string, severity string, description string, page_number int, source string")
    writers.write_validation(found, store, str(tmp_path / "report"))
    lines = [x for f in sorted(os.listdir(tmp_path / "report")) if f.startswith("part-") for x in (tmp_path / "report" / f).read_text().splitlines()]
    listed = [f"- Q{i:03} (page {p}): t - d" for p, i in sorted((1 + i % 7, i) for i in range(120))]
    at, other = lines.index("## Critical issues: 120"), lines.index("## Major issues: 120")
    assert lines[0] == "# Validation Report" and lines[at + 2 : other - 1] == listed
    assert lines[other + 2 : lines.index("## Recommendations") - 1] == listed


def test_pdf_plug_in(spark, tmp_path):
    for n in ("Questions_1.pdf", "Questions_2.pdf", "other.pdf"):
        (tmp_path / n).write_bytes(b"bad" if n.endswith("2.pdf") else b"page one\fpage two")

    def decode(content):
        if content == b"bad":
            raise ValueError("no pdf")
        return {"default": content.decode().split("\f")}

    cache, bad = readers.read_pdf_cache(spark, str(tmp_path), decode)
    assert sorted((r.source_file, r.page_number, r.text) for r in cache.collect()) == [("Questions_1.pdf", 1, "page one"), ("Questions_1.pdf", 2, "page two")]
    assert bad.first().source_file == "Questions_2.pdf" and readers.pages_of_cache(cache).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("one\ftwo\f")
    assert sorted(r.page_number for r in readers.read_text_pages(spark, str(tmp_path / "t")).collect()) == [1, 2]
    store = pages(spark, "a", "b", "c")
    store.select("source_file", "page_number", "raw_text").write.parquet(str(tmp_path / "p"))
    assert [r.page_number for r in readers.read_page_table(spark, str(tmp_path / "p"), 1, 2).collect()] == [2]


def test_streaming(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    add = lambda n, text: pages(spark, text).select("source_file", F.lit(n).alias("page_number"), "raw_text").coalesce(1).write.mode("append").parquet(source)
    add(1, BLOCK)
    incremental.run_available(spark, source, out, mark)
    add(2, BLOCK.replace("#1", "#5"))
    incremental.run_available(spark, source, out, mark)
    incremental.run_available(spark, source, out, mark)
    assert sorted(r.unique_id for r in spark.read.parquet(out).collect()) == ["Q1_1", "Q2_5"]


def test_limit_and_enhancement(spark):
    found = pipeline.extract(pages(spark, BLOCK, BLOCK.replace("#1", "#2")), config=EngineConfig(max_questions=1))
    q = found.questions.collect()
    assert len(q) == 1 and q[0].unique_id == "Q1_1" and q[0].description.endswith("?")
    assert found.comments.count() == 6
    assert pipeline.extract(pages(spark, BLOCK, BLOCK.replace("#1", "#2"))).duplicates.count() == 1
    assert T.STEPS == EngineConfig().enhance and os.path.exists(__file__)
