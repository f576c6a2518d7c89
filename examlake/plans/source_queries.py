"""Registered queries of sources, sinks, prompts, errors and single checks, and their SQL counterparts.

Sinks write to a folder of their own under the shared folder; what is read back
is held against the base columns.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..config import EngineConfig
from ..functions import text as T
from ..operators import answers, errors, parse, search, segment, validate
from ..sources import readers, writers
from . import fixtures
from .queries import _BASE, _OPTIONS_TEXT, _cache, _lit, blocks, query, questions, table


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or a temporary one where that is unset (local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="examlake-")
    return f"{base.rstrip('/')}/queries/{uuid.uuid4().hex}"


# ---- sinks, read back -----------------------------------------------------------------------------------------------


@query(
    "web_store",
    f"""WITH {_BASE} SELECT unique_id AS id, number, description, a AS option_a, d AS option_d, vote AS community, '' AS claude, '' AS claude_reasoning, topic, page_number AS page, source, confidence FROM base""",
)
def _web_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    writers.write_web(questions(spark, sf_dir), path)
    q = readers.source_and_page(readers.read_web_json(spark, path))
    o = F.col("options")
    return q.select("id", "number", "description", o["A"].alias("option_a"), o["D"].alias("option_d"), "answers.community", "answers.claude", "claude_reasoning", "metadata.topic", "page", "source", "metadata.confidence")


@query("json_store", f"WITH {_BASE} SELECT unique_id, source, description, b AS option_b, page_number, './data/input/' || source AS source_pdf_path, latest_date FROM base")
def _json_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    writers.write_json(questions(spark, sf_dir), path)
    schema = "unique_id string, source string, description string, options map<string,string>, page_number int, source_pdf_path string, latest_date string"
    good, _ = readers.read_json_lenient(spark, f"{path}/questions", schema)
    return good.select("unique_id", "source", "description", F.col("options")["B"].alias("option_b"), "page_number", "source_pdf_path", "latest_date")


@query(
    "csv_store",
    f"""WITH {_BASE} SELECT number AS "Question No", {_OPTIONS_TEXT} AS "Answer Options", nullif(vote, '') AS "Community Answer", topic AS "Topic", source AS "Source" FROM base""",
)
def _csv_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    writers.write_csv(questions(spark, sf_dir), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select("Question No", "Answer Options", "Community Answer", "Topic", "Source")


@query(
    "export_filtered",
    f"WITH {_BASE} SELECT unique_id, source, description, vote AS community_answer, (SELECT count(*) FROM base WHERE topic = 'Topic 1') AS total_questions FROM base WHERE topic = 'Topic 1'",
)
def _export_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.export_filtered(questions(spark, sf_dir), search.Filters(topic="Topic 1"), "now")
    q = found.select("total_questions", F.explode("questions").alias("json"))
    return q.select(F.from_json("json", "unique_id string, source string, description string, community_answer string").alias("q"), "total_questions").select("q.*", "total_questions")


_BAR = "=" * 50


@query(
    "page_text_dump",
    f"""WITH {_BASE} SELECT chr(10) || '{_BAR}' || chr(10) || 'Source: ' || source || chr(10) || 'Page: ' || page_number || chr(10) || '{_BAR}' || chr(10) || chr(10)
    || 'Header line with enough characters ' || p_brand || chr(10) || 'Question #' || number || ' ' || topic || chr(10) || chr(10)
    || 'Your team must ConKgure traOc for ' || p_name || ' in region ' || p_type || '. What should they do?' || chr(10) || 'A. ' || a || chr(10) || 'B. ' || b || chr(10)
    || coalesce('C. ' || c || chr(10) || 'D. ' || d || chr(10), '') || CASE WHEN vote = '' THEN '' ELSE 'Selected Answer: ' || vote || chr(10) END
    || 'user_' || p_size || ' ' || latest_date || chr(10) || 'upvoted ' || p_size || ' times' || chr(10) AS value FROM base""",
)
def _dump_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.page_text_dump(readers.with_text(fixtures.exam_pages(spark, sf_dir)))


@query(
    "validation_report",
    f"""WITH {_BASE} SELECT '- ' || unique_id || ' (page ' || page_number || '): pdf_access_error - Cannot access page ' || page_number || ' of ' || source AS value FROM base WHERE k % 10 = 0
    UNION ALL SELECT '- ' || unique_id || ' (page ' || page_number || '): incomplete_options - Incomplete answer options: 2 (typically 4-6 expected)' FROM base WHERE k % 10 <> 0 AND n = 2
    UNION ALL SELECT '- ' || unique_id || ' (page ' || page_number || '): missing_options - Missing answer options: found 2, expected ~4' FROM base WHERE k % 10 <> 0 AND n = 2""",
)
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, path = questions(spark, sf_dir), scratch(spark)
    writers.write_validation(validate.issues(q, _cache(spark, sf_dir), similarity=False), q, path)
    return spark.read.text(path).filter(F.col("value").rlike(r"^- Q\d"))


@query("read_all", "SELECT 200 AS status, 'head' AS part, CAST(1 AS BIGINT) AS lines UNION ALL SELECT 200, 'question', count(*) FROM part UNION ALL SELECT 200, 'tail', 1 UNION ALL SELECT 404, 'missing', 1")
def _read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    writers.write_web(questions(spark, sf_dir), path)
    rows = readers.read_all(spark, path).unionByName(readers.read_all(spark, path + "/nowhere"))
    line = F.col("line")
    part = F.when(F.col("status") == 404, "missing").when(line.startswith('{"metadata"'), "head").when(line == "]}", "tail").otherwise("question")
    return rows.groupBy("status", part.alias("part")).agg(F.count(F.lit(1)).alias("lines"))


@query("rewrite_in_place", "SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS name, 'old  ' || p_name AS before FROM part")
def _rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" ")).alias("name"), F.concat(F.lit("old  "), "p_name").alias("note"))
    part.write.json(path)
    writers.rewrite_in_place(path, spark)
    new, old = spark.read.json(path), spark.read.json(path + ".backup")
    return new.select("p_partkey", "name").join(old.select("p_partkey", F.col("note").alias("before")), "p_partkey")


# ---- sources --------------------------------------------------------------------------------------------------------


@query(
    "page_range",
    f"WITH {_BASE} SELECT source AS source_file, page_number FROM base WHERE page_number > 10 AND page_number <= 40",
)
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    fixtures.exam_pages(spark, sf_dir).write.parquet(path)
    return readers.read_page_table(spark, path, 10, 40).select("source_file", "page_number")


def _decode(content: bytes) -> dict:
    """A stand-in for a PDF decoder: pages of JSON text; one that says so fails."""
    pages = [str(x) for x in json.loads(content)]
    return {"default": [ValueError("unreadable page") if x == "bad" else x for x in pages], "layout": [x.upper() for x in pages if x != "bad"]}


@query(
    "pdf_cache",
    """SELECT 'default' AS strategy, 1 AS page_number, CAST('page of ' || (SELECT count(*) FROM supplier) AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS error
    UNION ALL SELECT 'default', 3, 'end', NULL UNION ALL SELECT 'layout', 1, 'PAGE OF ' || (SELECT count(*) FROM supplier), NULL UNION ALL SELECT 'layout', 2, 'END', NULL
    UNION ALL SELECT '', 2, '', 'ValueError: unreadable page'""",
)
def _pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    n.select(F.to_json(F.array(F.concat(F.lit("page of "), F.col("n").cast("string")), F.lit("bad"), F.lit("end"))).alias("value")).coalesce(1).write.text(path)
    cache, bad = readers.read_pdf_cache(spark, path, _decode, EngineConfig(file_glob="*.txt"))
    none = F.lit(None).cast("string")
    good = cache.select("strategy", "page_number", "text", none.alias("error"))
    return good.unionByName(bad.select(F.lit("").alias("strategy"), "page_number", F.lit("").alias("text"), "error"))


@query("json_lenient", "SELECT 'good' AS kind, CAST(s_suppkey AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'bad', '{\"k\": ' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def _lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    key = F.col("s_suppkey").cast("string")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"k": '), key)).otherwise(F.concat(F.lit('{"k": "'), key, F.lit('"}')))
    table(spark, sf_dir, "supplier").select(line.alias("value")).write.text(path)
    good, bad = readers.read_json_lenient(spark, path, "k string")
    return good.select(F.lit("good").alias("kind"), F.col("k").alias("value")).unionByName(bad.select(F.lit("bad").alias("kind"), F.col("_bad").alias("value")))


@query("config_document", "SELECT 'Exam_*.pdf' AS file_glob, './in' AS input_directory, 80 AS min_block_chars, 'A,B' AS columns, 50 AS requests_per_minute, CAST(0 AS BIGINT) AS missing")
def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    settings = {"pdf_processing": {"file_pattern": "Exam_*.pdf", "input_directory": "./in"}, "question_detection": {"minimum_question_length": 80}, "output_format": {"columns": ["A", "B"]}, "other": 1}
    spark.createDataFrame([(json.dumps(settings, indent=1),)], "value string").coalesce(1).write.text(path)
    c = EngineConfig.of(readers.read_document(spark, path))
    row = (c.file_glob, c.input_directory, c.min_block_chars, ",".join(c.columns), c.requests_per_minute, len(readers.read_document(spark, path + "/nowhere")))
    return spark.createDataFrame([row], "file_glob string, input_directory string, min_block_chars int, columns string, requests_per_minute int, missing long")


# ---- prompts and a provider -----------------------------------------------------------------------------------------

_LINES = "'A. ' || a || chr(10) || 'B. ' || b || coalesce(chr(10) || 'C. ' || c || chr(10) || 'D. ' || d, '')"


@query("prompts_with_topic", f"WITH {_BASE} SELECT unique_id AS question_id, source, replace(replace(replace({_lit(R.CONTEXT_PROMPT)}, '{{topic}}', topic), '{{options}}', {_LINES}), '{{question}}', description) AS prompt FROM base")
def _topic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.prompts(questions(spark, sf_dir), with_topic=True)


_TEMPLATES = {"question_analysis": {"system_prompt": "You know the exam.", "user_template": "Q: {question_text}\nO:\n{options_text}"}}


@query("prompts_of_document", f"WITH {_BASE} SELECT unique_id AS question_id, source, 'You know the exam.' || chr(10) || chr(10) || 'Q: ' || description || chr(10) || 'O:' || chr(10) || {_LINES} AS prompt FROM base")
def _document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.prompts(questions(spark, sf_dir), template=answers.template_of(_TEMPLATES))


def _provider(prompt: str) -> str | None:
    if "Topic 2" in prompt:
        raise answers.RateLimited("later")
    if "Topic 3" in prompt:
        raise ValueError("refused")
    return None if "Topic 4" in prompt else f"The correct answer is {'B' if 'Topic 1' in prompt else 'C'}."


def _no_wait(seconds: float) -> None:
    """Tests and queries don't wait."""


@query(
    "query_model",
    f"""WITH {_BASE} SELECT unique_id AS question_id, source, CASE topic WHEN 'Topic 1' THEN 'The correct answer is B.' WHEN 'Topic 5' THEN 'The correct answer is C.' ELSE '' END AS response_text,
    CASE topic WHEN 'Topic 2' THEN 'rate limited' WHEN 'Topic 3' THEN 'refused' WHEN 'Topic 4' THEN 'request failed' END AS error FROM base""",
)
def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.query_model(answers.prompts(questions(spark, sf_dir), with_topic=True), _provider, wait=_no_wait, workers=4)


# ---- errors ---------------------------------------------------------------------------------------------------------


@query(
    "error_handling",
    """SELECT * FROM (VALUES ('ZeroDivisionError', 'division by zero', 'attempt 1', 'WARNING', true), ('ZeroDivisionError', 'division by zero', 'attempt 2', 'WARNING', true),
    ('ZeroDivisionError', 'division by zero', 'attempt 3', 'ERROR', false), ('Error', 'text is int, not str', 'check_type', 'ERROR', true), ('Error', 'no such file: ''''', 'check_path', 'ERROR', true),
    ('Error', 'less than 1000000000000.0 MB free', 'check_disk', 'WARNING', true), ('Error', 'less than 1000000000000.0 MB of memory free', 'check_memory', 'WARNING', true)) t(error_type, error_message, context, severity, recoverable)""",
)
def _handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = errors.ErrorLog()
    try:
        log.retry(lambda: 1 / 0, 2, 1.0, _no_wait)
    except ZeroDivisionError:
        pass  # the last error is raised, and logged
    log.check_type(1, str, "text")
    log.check_path("")
    log.check_disk("/", 1e12)
    log.check_memory(1e12)
    return log.table(spark).select("error_type", "error_message", "context", "severity", "recoverable")


# ---- texts, fields and single checks --------------------------------------------------------------------------------


@query("introductory_info", "SELECT s_suppkey, s_name || ' builds data tools for many people.' AS introductory_info, CAST(0 AS BIGINT) AS missing_intro FROM supplier")
def _intro(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))
    text = F.concat(
        F.lit("Question #"), F.col("s_suppkey").cast("string"), F.lit(" Topic 1\nCompany Overview - "), "s_name",
        F.lit(" builds data tools for many people.\nSolution Concept follows in short.\nHow should they store the archive data?\nA. Keep one copy\nB. Keep two copies\nC. Keep three copies\nD. Keep none at all"),
    )
    pages = readers.with_text(s.select(F.lit("f.pdf").alias("source_file"), (F.col("s_suppkey") + 1).cast("int").alias("page_number"), text.alias("raw_text")))
    q = parse.parse_questions(segment.question_blocks(pages))
    cache = pages.select("source_file", "page_number", F.lit("default").alias("strategy"), "text")
    found = validate.issues(q, cache, similarity=False).filter("issue_type = 'missing_intro'").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    return q.join(found, q["unique_id"] == found["question_id"], "left").select(
        F.col("original_number").cast("long").alias("s_suppkey"), "introductory_info", F.coalesce("n", F.lit(0)).alias("missing_intro")
    )


@query(
    "validation_single_checks",
    f"""WITH {_BASE}, o AS (SELECT *, k % 6 AS m FROM base)
SELECT unique_id AS question_id, 'missing_metadata' AS issue_type, 'critical' AS severity FROM o WHERE m = 0
UNION ALL SELECT unique_id, 'pdf_access_error', 'critical' FROM o WHERE m <> 0 AND k % 10 = 0
UNION ALL SELECT unique_id, 'missing_options', 'critical' FROM o WHERE m = 1 AND k % 10 <> 0
UNION ALL SELECT unique_id, 'empty_option', 'major' FROM o WHERE m = 2 AND k % 10 <> 0
UNION ALL SELECT unique_id, unnest(['incomplete_options', 'missing_options']), 'major' FROM o WHERE m > 1 AND k % 10 <> 0 AND n = 2
UNION ALL SELECT unique_id, 'missing_text', 'critical' FROM o WHERE m = 4 AND k % 10 <> 0""",
)
def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    m = F.col("original_number").cast("long") % 6
    blank = F.transform("options", lambda o, i: F.when(i == 0, o.withField("text", F.lit("x"))).otherwise(o))
    q = q.withColumn("source", F.when(m == 0, "").otherwise(F.col("source")))
    q = q.withColumn("options", F.when(m == 1, F.slice("options", 1, 1)).when(m == 2, blank).otherwise(F.col("options")))
    q = q.withColumn("description", F.when(m == 4, "Why?").otherwise(F.col("description")))
    return validate.issues(q, _cache(spark, sf_dir), similarity=False).select("question_id", "issue_type", "severity")


@query("text_similarity", "SELECT p_partkey, round(2.0::DOUBLE * length(p_name) / (2 * length(p_name) + p_size % 40), 9) AS ratio FROM part")
def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fixtures.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    pairs = part.select("p_partkey", F.col("p_name").alias("one"), F.concat("p_name", F.repeat(F.lit("~"), (F.col("p_size") % 40).cast("int"))).alias("two"))
    return validate.text_similarity(pairs).select("p_partkey", F.round("ratio", 9).alias("ratio"))


@query(
    "without_comments",
    f"""WITH {_BASE} SELECT source, page_number, 'Header line with enough characters ' || p_brand || chr(10) || 'Question #' || number || ' ' || topic || chr(10)
    || 'Your team must ConKgure traOc for ' || p_name || ' in region ' || p_type || '. What should they do?' || chr(10) || 'A. ' || a || chr(10) || 'B. ' || b || coalesce(chr(10) || 'C. ' || c || chr(10) || 'D. ' || d, '') AS content FROM base""",
)
def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return b.select(F.col("source_file").alias("source"), F.col("start_page").alias("page_number"), parse.without_comments(F.col("full_content")).alias("content"))


@query(
    "enhanced_texts",
    """SELECT p_partkey, 'Our team must use BigQuery for ' || p_name || '.' AS plain, 'our team must use BigQuery for ' || p_name || '?' AS question, 'Use Cloud SQL for ' || p_name || CASE WHEN length('Use Cloud SQL for ' || p_name) > 20 THEN '.' ELSE '' END AS option_text FROM part""",
)
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fixtures.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    return part.select(
        "p_partkey",
        T.enhance(F.concat(F.lit("Our team  must use bigquery for "), "p_name", F.lit(" ."))).alias("plain"),
        T.enhance_question(F.concat(F.lit("Question #12. our team must  use BIGQUERY for "), "p_name")).alias("question"),
        T.enhance_option(F.concat(F.lit("B) use cloud   sql for "), "p_name")).alias("option_text"),
    )
