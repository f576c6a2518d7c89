"""The registered queries of the engine's own operators, and their SQL counterparts.

Parsing queries read pages made of base columns (see fixtures); their SQL
returns those columns, so it is no second copy of the parser. Rewriting queries
add noise to the documents' texts on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import scores
from ..functions import text as T
from ..operators import answers, dedup, errors, parse, report, robust, search, segment, validate
from ..sources.readers import with_text
from . import fixtures
from .pipeline import enhance_questions

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_questions(blocks(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.question_blocks(with_text(fixtures.exam_pages(spark, sf_dir)))


# ---- rewriting of texts -------------------------------------------------------------------------------------------

_ALIAS = {"$1$2": "\\1\\2", "$1 $2": "\\1 \\2", "$1 ": "\\1 ", "$1": "\\1", "$0": "\\0"}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {_lit(pattern)}, {_lit(_ALIAS.get(new, new))}, 'g')"


def _fold(x: str, table: tuple[tuple[str, str], ...], flags: str = "") -> str:
    return reduce(lambda a, r: _sub(a, flags + r[0], r[1]), table, x)


def _strip(x: str) -> str:
    return _sub(x, r"^\s+|\s+$", "")


def _squeeze(x: str) -> str:
    return _sub(x, r"\s+", " ")


def rewriting(name: str, noise: str, spark_side: Callable[[Column], Column], sql_side: Callable[[str], str]) -> None:
    """A query that applies a rewriting step to all documents; noise is SQL over ``text`` that both engines run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = fixtures.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return docs.select("doc_id", F.expr(noise).alias("text")).select("doc_id", spark_side(F.col("text")).alias("result"))

    _QUERIES[name] = run
    _SQL[name] = f"SELECT doc_id, {sql_side('text')} AS result FROM (SELECT doc_id, {noise} AS text FROM documents)"


_NOISY = "concat('12', chr(10), 'https://www.examtopics.com/x?y=1 ', replace(text, 'tion ', 'ti-' || chr(10) || ' on '), chr(10), 'Page 7 of', chr(10), chr(10), chr(10), chr(10), 'q', chr(10), 'end    x')"
_DUCK_CLEAN = lambda x: _strip(_fold(x, tuple((p.replace("(?d)", ""), n) for p, n in R.PAGE_CLEAN)))
rewriting("text_clean_page", _NOISY, T.clean_page, _DUCK_CLEAN)
rewriting(
    "text_drop_icons",
    "concat('a  ', replace(text, 'the ', ' █'), '', chr(10), '░b')",
    T.drop_icons,
    lambda x: _strip(_squeeze(_sub(f"translate({x}, '█▐░', '')", r"[\x{F000}-\x{F8FF}]", ""))),
)
rewriting("text_page_breaks", "replace(replace(text, 'on the', 'on-' || chr(10) || 'the'), ' of ', chr(10) || 'of ')", T.join_page_breaks, lambda x: _fold(x, R.PAGE_BREAKS))
rewriting(
    "text_standardize",
    "concat('- question 12 topic  3 ', text)",
    T.standardize,
    lambda x: _sub(_sub(_sub(_squeeze(x), r"^[*+\-]\s*", "• "), r"(?i)question\s*#?\s*(\d+)", "Question #\\1"), r"(?i)topic\s*(\d+)", "Topic \\1"),
)
rewriting(
    "text_term_casing",
    "replace(replace(text, ' the ', ' bigquery '), ' of ', ' CLOUD sql ')",
    T.case_terms,
    lambda x: _fold(x, tuple((r"\b" + t + r"\b", t) for t in R.TERMS), "(?i)"),
)
rewriting(
    "text_final_clean",
    "replace(replace(text, '. ', ' .... '), ', ', ' ,, !!! ')",
    T.final_clean,
    lambda x: (lambda y: f"(SELECT CASE WHEN length(z) > 20 AND NOT regexp_matches(z, '[.!?]$') THEN z || '.' ELSE z END FROM (SELECT {y} AS z))")(
        _strip(_fold(x, R.FINAL_CLEAN[:-1] + ((r"[ \t\f\v\r]+\n", "\n"),)))
    ),
)
rewriting(
    "text_encoding",
    "replace(replace(replace(text, 'the', 'â€™'), 'é', 'Ã©'), ' of', 'Â')",
    T.repair_encoding,
    lambda x: reduce(lambda a, r: f"replace({a}, {_lit(r[0])}, {_lit(r[1])})", R.MOJIBAKE_SAFE, x),
)
rewriting(
    "text_comparable",
    "concat('ExamTopics x Professional Page 3 ', replace(text, 'tion', 'solu\"on Data^ow'), ' ')",
    T.comparable,
    lambda x: _strip(_fold(_sub(_sub(_squeeze(_strip(x)), r"(?i)ExamTopics.*?Professional", ""), r"Page\s+\d+", ""), R.OCR_COMPARE, "(?i)")),
)
rewriting(
    "text_ocr_dictionary",
    "replace(replace(replace(text, 'tion', 'solu\"on'), ' the ', ' ConKgure '), ' of ', ' ^at  Kles ')",
    lambda c: T.guarded_fold(c, R.OCR_DESCRIPTION),
    lambda x: _fold(x, R.OCR_DESCRIPTION, "(?i)"),
)
rewriting("text_escape_markdown", "replace(replace(text, ' ', '_'), '.', '|#*`')", T.escape_markdown, lambda x: _sub(x, r"([|*_`#])", "\\\\\\1"))
rewriting("text_escape_html", "replace(text, ' ', '<&>')", T.escape_html, lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
rewriting("text_truncate", "text", lambda c: T.truncate(c, 200), lambda x: f"CASE WHEN length({x}) > 200 THEN left({x}, 197) || '...' ELSE {x} END")


@query("text_clean_nested", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(source, '\\s+', ' ', 'g')) AS b, CAST(n_chars AS BIGINT) AS n FROM documents")
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.spread(table(spark, sf_dir, "documents"))
    deep = docs.select("doc_id", F.struct(F.array(F.concat(F.lit(""), "text")).alias("x"), F.create_map(F.lit("k"), F.concat("source", F.lit("  "))).alias("m"), "n_chars").alias("s"))
    return T.clean_nested(deep).select("doc_id", F.col("s.x")[0].alias("a"), F.col("s.m")["k"].alias("b"), F.col("s.n_chars").alias("n"))


@query(
    "text_enhancement_check",
    """
WITH t AS (SELECT doc_id, text || ' BigQuery 17' AS a, replace(replace(text || ' BigQuery 17', 'BigQuery', CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'BigQuery' END), ' th', CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' th' END) AS b FROM documents),
w AS (SELECT *, list_sort(list_distinct(regexp_extract_all(a, '\\d+'))) AS na, list_sort(list_distinct(regexp_extract_all(b, '\\d+'))) AS nb,
      len(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')) AS wa, len(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')) AS wb FROM t)
SELECT doc_id, abs(length(b) - length(a)) <= length(a) * 0.3::DOUBLE AS valid, CAST(length(b) - length(a) AS INTEGER) AS length_change,
       CAST(wb - wa AS INTEGER) AS word_count_change, na <> nb AS numbers_changed, NOT contains(b, 'BigQuery') AS terms_lost FROM w""",
)
def _check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    a = F.concat("text", F.lit(" BigQuery 17"))
    b = F.replace(a, F.lit("BigQuery"), F.when(F.col("doc_id") % 2 == 0, "x").otherwise("BigQuery"))
    b = F.replace(b, F.lit(" th"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(" th"))
    return docs.select("doc_id", a.alias("a"), b.alias("b")).select("doc_id", T.enhancement_check(F.col("a"), F.col("b")).alias("c")).select("doc_id", "c.*")


@query("text_enhance")
def _enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", T.enhance(F.col("text")).alias("result"))


_ARTICLE = "CASE WHEN regexp_matches({0}, '^[aeiouAEIOU]') THEN 'an ' ELSE 'a ' END || {0}"


@query("text_grammar", f"SELECT p_partkey, 'It is ' || {_ARTICLE.format('p_name')} || ', and an apple; ' || {_ARTICLE.format('p_type')} || '. Next one.' AS result FROM part")
def _grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fixtures.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    said = F.concat(F.lit("It is a "), "p_name", F.lit(" , and  a apple ;a "), "p_type", F.lit(". next one."))
    return part.select("p_partkey", T.fix_grammar(said).alias("result"))


# ---- segmentation and parsing --------------------------------------------------------------------------------------

_BASE = """
base AS (SELECT p_partkey AS k, 'Questions_' || CAST(p_partkey % 13 + 1 AS VARCHAR) || '.pdf' AS source, CAST(p_partkey AS INTEGER) + 1 AS page_number,
    'Q' || CAST(p_partkey + 1 AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) AS unique_id, CAST(p_partkey AS VARCHAR) AS number, 'Topic ' || CAST(p_size % 5 + 1 AS VARCHAR) AS topic,
    'Header line with enough characters ' || p_brand || ' Your team must Configure traffic for ' || p_name || ' in region ' || p_type || '. What should they do?' AS description,
    'Deploy ' || p_type AS a, 'Migrate ' || p_name AS b, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '~/b' END AS c, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Retain ' || p_brand END AS d,
    CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 4 END AS n, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE substr('ABCD', CAST(p_partkey % 4 AS INTEGER), 1) END AS vote,
    p_size, CAST(p_size % 11 + 1 AS VARCHAR) || ' months ago' AS latest_date,
    0.4::DOUBLE + CASE WHEN p_partkey % 3 = 0 THEN 0.15::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END + 0.1::DOUBLE AS confidence,
    p_name, p_brand, p_type FROM part)"""


@query(
    "segment_blocks",
    f"WITH {_BASE} SELECT source AS source_file, page_number AS start_page, 1 AS start_line, 'Question #' || number || ' ' || topic AS question_header, "
    "CAST(6 + CASE WHEN n = 4 THEN 2 ELSE 0 END + CASE WHEN vote = '' THEN 0 ELSE 1 END + 1 AS INTEGER) AS lines FROM base",
)
def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("source_file", "start_page", "start_line", "question_header", F.size("content_lines").alias("lines"))


@query(
    "segment_two_on_a_page",
    """
WITH s AS (SELECT 'Questions_' || CAST(s_suppkey % 5 + 1 AS VARCHAR) || '.pdf' AS source, CAST(s_suppkey AS INTEGER) + 1 AS page_number, s_suppkey AS k, s_name FROM supplier)
SELECT source, page_number, CAST(k AS VARCHAR) AS original_number, 'A first supplier asks how ' || s_name || ' should store its archive data.' AS description,
       'A: Keep one copy; B: Keep two copies' AS options_text, 'B' AS highly_voted_answer, '' AS most_recent_answer, 'Topic 1' AS topic FROM s
UNION ALL
SELECT source, page_number, CAST(k + 100000 AS VARCHAR), 'A second supplier asks how ' || s_name || ' should encrypt its archive data.',
       'A: Use managed keys; B: Use own keys; C: Use no keys', '', 'C', 'Topic 2' FROM s""",
)
def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.parse_questions(segment.question_blocks(with_text(fixtures.double_pages(spark, sf_dir))))
    return found.select("source", "page_number", "original_number", "description", T.options_text(F.col("options")).alias("options_text"), "highly_voted_answer", "most_recent_answer", "topic")


@query(
    "parse_questions",
    f"WITH {_BASE} SELECT unique_id, number AS original_number, description, vote AS community_answer, '' AS highly_voted_answer, '' AS most_recent_answer, latest_date, topic, page_number, confidence AS confidence_score, source FROM base",
)
def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select(
        "unique_id", "original_number", "description", "community_answer", "highly_voted_answer", "most_recent_answer", "latest_date", "topic", "page_number", "confidence_score", "source"
    )


@query(
    "parse_options",
    f"WITH {_BASE} SELECT * FROM (SELECT source, unique_id, 'A' AS letter, a AS text FROM base UNION ALL SELECT source, unique_id, 'B', b FROM base "
    "UNION ALL SELECT source, unique_id, 'C', c FROM base UNION ALL SELECT source, unique_id, 'D', d FROM base) WHERE text IS NOT NULL",
)
def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("source", "unique_id", F.explode("options").alias("o")).select("source", "unique_id", "o.letter", "o.text")


@query(
    "parse_comments",
    f"""WITH {_BASE}
SELECT unique_id AS question_id, '' AS username, 'Selected Answer: ' || vote AS content, '' AS timestamp, 0 AS vote_count, 'Selected Answer' AS vote_type, page_number, source FROM base WHERE vote <> ''
UNION ALL SELECT unique_id, 'user_' || p_size, 'user_' || p_size || ' ' || latest_date, latest_date, 0, '', page_number, source FROM base
UNION ALL SELECT unique_id, '', 'upvoted ' || p_size || ' times', '', p_size, '', page_number, source FROM base""",
)
def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_comments(blocks(spark, sf_dir))


@query(
    "robust_questions",
    f"WITH {_BASE} SELECT unique_id AS id, number, 'Your team must Configure traffic for ' || p_name || ' in region ' || p_type || '. What should they do?' AS description, n AS options, vote AS community_answer, page_number, source AS source_file, 0.8::DOUBLE AS confidence_score FROM base",
)
def _robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust.robust_questions(with_text(fixtures.exam_pages(spark, sf_dir)))
    return found.select("id", "number", "description", F.size("options").alias("options"), "community_answer", "page_number", "source_file", "confidence_score")


@query(
    "robust_case_study",
    """
SELECT 'case_study_' || lower(replace(s_name, ' ', '_')) || '_1' AS id, 'For this question, refer to the ' || s_name || ' case study. ' || 'How should ' || s_name || ' store its data?' AS description,
       'A: One copy; B: Two copies' AS options_text, 'B' AS community_answer, 'B' AS highly_voted_answer, 0.85::DOUBLE AS confidence_score FROM supplier""",
)
def _case(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))
    text = F.concat(F.lit("For this question, refer to the "), "s_name", F.lit(" case study.\nHow should "), "s_name", F.lit(" store its data?\nA. One copy\nB. Two copies\nHighly Voted B user_x 3 months ago"))
    files = s.select(F.col("s_name").alias("source_file"), F.lit(1).alias("page_number"), text.alias("text"))
    found = robust.case_study_questions(segment.file_texts(files))
    return found.select("id", "description", T.options_text(F.col("options")).alias("options_text"), "community_answer", "highly_voted_answer", "confidence_score")


@query(
    "page_cache_join",
    f"WITH {_BASE} SELECT source, unique_id, CASE WHEN k % 10 = 0 THEN 'missing' ELSE 'found' END AS page FROM base",
)
def _cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).select("source", "page_number", "unique_id")
    pages = validate.page_texts(_cache(spark, sf_dir)).select("source", "page_number", "page_text")
    return q.join(pages, ["source", "page_number"], "left").select("source", "unique_id", F.when(F.col("page_text").isNull(), "missing").otherwise("found").alias("page"))


@query("comments_per_question", f"WITH {_BASE} SELECT source, unique_id, CAST(CASE WHEN vote = '' THEN 2 ELSE 3 END AS BIGINT) AS comments, CAST(p_size AS BIGINT) AS votes FROM base")
def _per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    own = parse.parse_comments(b).groupBy("source", F.col("question_id").alias("unique_id")).agg(F.count(F.lit(1)).alias("comments"), F.sum("vote_count").alias("votes"))
    return parse.parse_questions(b).select("source", "unique_id").join(own, ["source", "unique_id"])


# ---- duplicates ----------------------------------------------------------------------------------------------------


@query(
    "duplicate_pairs",
    """
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS w FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
p AS (SELECT a.doc_id AS id_1, b.doc_id AS id_2, count(*) AS same FROM w a JOIN w b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT id_1, id_2, CAST(same AS DOUBLE) / CAST(x.n + y.n - same AS DOUBLE) AS similarity
FROM p JOIN n x ON x.doc_id = id_1 JOIN n y ON y.doc_id = id_2 WHERE same * 5 > 4 * (x.n + y.n - same)""",
)
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup.duplicate_pairs(docs, "doc_id", "text")


# ---- reports -------------------------------------------------------------------------------------------------------


@query(
    "confidence_by_source",
    f"WITH {_BASE} SELECT source, count(*) AS questions, round(avg(confidence), 9) AS average, min(confidence) AS minimum, max(confidence) AS maximum, "
    "count(*) FILTER (confidence >= 0.8::DOUBLE) AS high, count(*) FILTER (confidence >= 0.5::DOUBLE AND confidence < 0.8::DOUBLE) AS medium, count(*) FILTER (confidence < 0.5::DOUBLE) AS low FROM base GROUP BY source",
)
def confidence_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.confidence_stats(questions(spark, sf_dir), "source").withColumn("average", F.round("average", 9))


@query(
    "confidence_stats",
    f"WITH {_BASE} SELECT count(*) AS questions, round(avg(confidence), 9) AS average, min(confidence) AS minimum, max(confidence) AS maximum, "
    "count(*) FILTER (confidence >= 0.8::DOUBLE) AS high, count(*) FILTER (confidence >= 0.5::DOUBLE AND confidence < 0.8::DOUBLE) AS medium, count(*) FILTER (confidence < 0.5::DOUBLE) AS low FROM base",
)
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.confidence_stats(questions(spark, sf_dir)).withColumn("average", F.round("average", 9))


@query("count_by_source", f"WITH {_BASE} SELECT source AS value, count(*) AS questions FROM base GROUP BY 1")
def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_source(questions(spark, sf_dir))


@query("count_by_topic", f"WITH {_BASE} SELECT topic AS value, count(*) AS questions FROM base GROUP BY 1")
def _by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_topic(questions(spark, sf_dir))


@query(
    "completeness",
    f"WITH {_BASE} SELECT count(*) AS total, count(*) AS descriptions, count(*) AS with_options, count(*) FILTER (vote <> '') AS community_answers, 0::BIGINT AS highly_voted_answers, 0::BIGINT AS most_recent_answers, "
    "0::BIGINT AS llm_answers, count(*) FILTER (confidence >= 0.8::DOUBLE) AS high_confidence, count(*) FILTER (confidence < 0.5::DOUBLE) AS low_confidence, round(avg(confidence), 9) AS average_confidence FROM base",
)
def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.completeness(questions(spark, sf_dir)).withColumn("average_confidence", F.round("average_confidence", 9))


@query(
    "shares",
    f"WITH {_BASE} SELECT count(*) AS total, 100.0::DOUBLE AS descriptions_percent, 100.0::DOUBLE AS with_options_percent, count(*) FILTER (vote <> '') * 100.0::DOUBLE / count(*) AS community_answers_percent, "
    "0.0::DOUBLE AS llm_answers_percent, count(*) FILTER (confidence >= 0.8::DOUBLE) * 100.0::DOUBLE / count(*) AS high_confidence_percent FROM base",
)
def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.shares(questions(spark, sf_dir))


@query(
    "recommendations",
    f"WITH {_BASE} SELECT 1 AS rank, 'Consider reprocessing ' || count(*) || ' questions missing model analysis' AS recommendation FROM base "
    "UNION ALL SELECT 2, 'Community answer extraction could be improved - review parsing logic' FROM base HAVING count(*) FILTER (vote <> '') < count(*) * 0.8::DOUBLE",
)
def _recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recommendations(questions(spark, sf_dir))


_OPTIONS_TEXT = "'A: ' || a || '; B: ' || b || coalesce('; C: ' || c || '; D: ' || d, '')"


@query(
    "tabular_rows",
    f"""WITH {_BASE} SELECT number AS "Question No", description AS "Question Description", {_OPTIONS_TEXT} AS "Answer Options", vote AS "Community Answer", '' AS "Highly Voted Answer",
    '' AS "Most Recent Answer", '' AS "Claude Answer", latest_date AS "Latest Date", topic AS "Topic", CAST(page_number AS VARCHAR) AS "Page Number", source AS "Source" FROM base""",
)
def _tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tabular(questions(spark, sf_dir))


@query(
    "markdown_rows",
    f"""WITH {_BASE} SELECT '| ' || number || ' | ' || replace(description, '#', '\\#') || ' | ' || replace({_OPTIONS_TEXT}, '#', '\\#') || ' | ' || vote || ' |  |  |  | ' || latest_date || ' | ' || topic
    || ' | ' || CAST(page_number AS VARCHAR) || ' | ' || replace(source, '_', '\\_') || ' |' AS value FROM base""",
)
def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown_rows(questions(spark, sf_dir))


@query(
    "web_questions",
    f"""WITH {_BASE} SELECT unique_id AS id, number, a AS option_a, d AS option_d, vote AS community, '' AS claude, topic, page_number AS page, source, latest_date AS date, confidence FROM base""",
)
def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = report.web_question(questions(spark, sf_dir))
    o = F.col("q.options")
    return q.select("q.id", "q.number", o["A"].alias("option_a"), o["D"].alias("option_d"), "q.answers.community", "q.answers.claude", "q.metadata.topic", "q.metadata.page", "q.metadata.source", "q.metadata.date", "q.metadata.confidence")


@query(
    "distinct_lists",
    f"WITH {_BASE} SELECT (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT source AS x FROM base)) AS sources, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT topic AS x FROM base)) AS topics",
)
def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distinct_lists(questions(spark, sf_dir)).select(F.array_join("sources", "|").alias("sources"), F.array_join("topics", "|").alias("topics"))


# ---- search and updates --------------------------------------------------------------------------------------------


def filtered(name: str, filters: search.Filters, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.filter_questions(questions(spark, sf_dir), filters).select("source", "unique_id")

    _QUERIES[name] = run
    _SQL[name] = f"WITH {_BASE} SELECT source, unique_id FROM base WHERE {where}"


_TEXT = "lower(description || ' ' || a || ' ' || b || coalesce(' ' || c || ' ' || d, '') || ' ' || topic || ' ')"
filtered("search_text", search.Filters(search="MIGRATE Small"), f"contains({_TEXT}, 'migrate small')")
filtered("search_topic", search.Filters(topic="Topic 3"), "topic = 'Topic 3'")
filtered("search_source", search.Filters(source="Questions_7.pdf"), "source = 'Questions_7.pdf'")
filtered("search_answer", search.Filters(answer="B"), "vote = 'B'")
filtered("search_confidence", search.Filters(confidence="medium"), "confidence >= 0.5::DOUBLE AND confidence < 0.8::DOUBLE")
filtered("search_all", search.Filters("red", "Topic 2", "Questions_4.pdf", "A", "high"), f"contains({_TEXT}, 'red') AND topic = 'Topic 2' AND source = 'Questions_4.pdf' AND vote = 'A' AND confidence >= 0.8::DOUBLE")


@query(
    "facet_values",
    f"WITH {_BASE} SELECT DISTINCT 'topic' AS facet, topic AS value FROM base UNION ALL SELECT DISTINCT 'source', source FROM base UNION ALL SELECT 'answer', unnest(['A', 'B', 'C', 'D', 'E', 'F'])",
)
def _facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet_values(questions(spark, sf_dir))


@query(
    "cards",
    f"WITH {_BASE} SELECT 'Question ' || number AS title, topic, CASE WHEN vote = '' THEN 'N/A' ELSE vote END AS answer, CASE WHEN confidence >= 0.8::DOUBLE THEN 'High' WHEN confidence >= 0.5::DOUBLE THEN 'Medium' ELSE 'Low' END AS confidence, description FROM base",
)
def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cards(questions(spark, sf_dir))


_UPDATES = """
s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_mktsegment, c_nationkey, c_custkey AS k FROM customer)"""


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = fixtures.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))
    key = F.col("c_custkey").cast("string")
    store = c.select(
        key.alias("id"),
        F.col("c_name").alias("number"),
        F.col("c_mktsegment").alias("description"),
        F.create_map(F.lit("A"), F.col("c_name")).alias("options"),
        F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("page"), F.lit("1")).alias("metadata"),
    )
    none = F.lit(None)
    updates = c.filter("c_custkey % 5 = 0").select(
        F.when(F.col("c_custkey") % 20 == 0, F.lit("")).when(F.col("c_custkey") % 20 == 5, F.concat(F.lit("x"), key)).otherwise(key).alias("id"),
        none.cast("string").alias("number"),
        F.concat(F.lit("new "), "c_name").alias("description"),
        none.cast("map<string,string>").alias("options"),
        F.create_map(F.lit("page"), F.lit("2")).alias("metadata"),
    )
    return store, updates


@query(
    "merge_updates",
    f"WITH {_UPDATES} SELECT id, c_name AS number, CASE WHEN k % 20 IN (10, 15) THEN 'new ' || c_name ELSE c_mktsegment END AS description, c_name AS option_a, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN k % 20 IN (10, 15) THEN '2' ELSE '1' END AS page FROM s",
)
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = search.merge_updates(*_store(spark, sf_dir))
    return out.select("id", "number", "description", F.col("options")["A"].alias("option_a"), F.col("metadata")["nation"].alias("nation"), F.col("metadata")["page"].alias("page"))


@query("merge_errors", f"WITH {_UPDATES} SELECT '' AS id, 400 AS status FROM s WHERE k % 20 = 0 UNION ALL SELECT 'x' || id, 404 FROM s WHERE k % 20 = 5")
def _merge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.merge_updates(*_store(spark, sf_dir))[1]


# ---- validation ----------------------------------------------------------------------------------------------------


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages under two strategies, without every tenth."""
    pages = with_text(fixtures.exam_pages(spark, sf_dir)).filter("(page_number - 1) % 10 <> 0")
    return pages.select("source_file", "page_number", F.explode(F.array(F.lit("default"), F.lit("layout"))).alias("strategy"), "text")


_ISSUES = f"""WITH {_BASE}, i AS (
SELECT unique_id AS question_id, source, page_number, 'pdf_access_error' AS issue_type, 'critical' AS severity FROM base WHERE k % 10 = 0
UNION ALL SELECT unique_id, source, page_number, 'incomplete_options', 'major' FROM base WHERE k % 10 <> 0 AND n = 2
UNION ALL SELECT unique_id, source, page_number, 'missing_options', 'major' FROM base WHERE k % 10 <> 0 AND n = 2)"""


@query("validation_issues", _ISSUES + " SELECT * FROM i")
def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issues(questions(spark, sf_dir), _cache(spark, sf_dir), similarity=False).select("question_id", "source", "page_number", "issue_type", "severity")


@query("validation_similarity")
def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issues(questions(spark, sf_dir), _cache(spark, sf_dir)).filter("issue_type = 'text_accuracy'")


@query(
    "validation_scores",
    _ISSUES
    + """, c AS (SELECT (SELECT count(*) FROM base) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, 0::BIGINT AS minor,
        count(*) FILTER (issue_type = 'missing_options') AS miss FROM i),
    r AS (SELECT *, 1.0::DOUBLE AS accuracy, greatest(0.0::DOUBLE, 1.0::DOUBLE - CAST(miss AS DOUBLE) / total) AS completeness,
        greatest(0.0::DOUBLE, 1.0::DOUBLE - (critical * 0.3::DOUBLE + major * 0.1::DOUBLE) / total) AS quality FROM c)
SELECT total, critical, major, minor, accuracy, round(completeness, 9) AS completeness, round(quality, 9) AS quality, CASE WHEN quality < 0.7 THEN 'fail' WHEN quality < 0.9 THEN 'warn' ELSE 'good' END AS status FROM r""",
)
def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    found = validate.issues(q, _cache(spark, sf_dir), similarity=False)
    return validate.validation_scores(found, q).withColumn("completeness", F.round("completeness", 9)).withColumn("quality", F.round("quality", 9))


@query("severity_breakdown", _ISSUES + " SELECT severity, count(*) AS issues FROM i GROUP BY 1")
def _severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issues(questions(spark, sf_dir), _cache(spark, sf_dir), similarity=False).groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with faults put into every description: community text, OCR errors, a cut end."""
    q = questions(spark, sf_dir)
    k = F.col("original_number").cast("long")
    said = F.when(k % 5 == 0, F.lit("Sam_1 Highly Voted and traOc")).when(k % 5 == 1, F.lit("We deKne Knd")).when(k % 5 == 2, F.lit("short")).otherwise(F.col("description"))
    return q.withColumn("description", said)


@query(
    "validation_faults",
    f"""WITH {_BASE}, o AS (SELECT * FROM base WHERE k % 10 <> 0)
SELECT issue_type, severity, count(*) AS issues FROM (
SELECT 'missing_text' AS issue_type, 'critical' AS severity FROM o WHERE k % 5 IN (1, 2)
UNION ALL SELECT 'community_pollution', 'critical' FROM (SELECT unnest([1, 2, 3]) FROM o WHERE k % 5 = 0)
UNION ALL SELECT 'ocr_error', 'minor' FROM (SELECT unnest(CASE k % 5 WHEN 0 THEN [1] ELSE [1, 2] END) FROM o WHERE k % 5 IN (0, 1))
UNION ALL SELECT 'truncated_text', 'major' FROM o WHERE k % 5 IN (0, 1, 2)
UNION ALL SELECT 'incomplete_options', 'major' FROM o WHERE n = 2
UNION ALL SELECT 'missing_options', 'major' FROM o WHERE n = 2
UNION ALL SELECT 'pdf_access_error', 'critical' FROM base WHERE k % 10 = 0) GROUP BY 1, 2""",
)
def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issues(_dirty(spark, sf_dir), _cache(spark, sf_dir), similarity=False).groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("issues"))


# The four queries above leave out the comparison of descriptions with page texts, for SQL has no counterpart of it;
# these are the whole checks.


def _checked(q: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issues(q, _cache(spark, sf_dir))


@query("validation_issues_full")
def _issues_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(questions(spark, sf_dir), spark, sf_dir).select("question_id", "source", "page_number", "issue_type", "severity")


@query("validation_scores_full")
def _scores_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    return validate.validation_scores(_checked(q, spark, sf_dir), q)


@query("severity_breakdown_full")
def _severity_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(questions(spark, sf_dir), spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))


@query("validation_faults_full")
def _faults_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(_dirty(spark, sf_dir), spark, sf_dir).groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query("triage", f"WITH {_BASE} SELECT source, unique_id, CASE k % 5 WHEN 0 THEN 'critical' ELSE CASE WHEN n = 2 THEN 'major' ELSE 'good' END END AS class FROM base")
def _triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.triage(_dirty(spark, sf_dir)).select("source", "unique_id", "class")


@query(
    "comparison_issues",
    f"""WITH {_BASE}
SELECT source, unique_id, 'CRITICAL' AS level, 'Community comment ''Highly Voted'' found in question text' AS issue FROM base WHERE k % 5 = 0
UNION ALL SELECT source, unique_id, 'MAJOR', 'OCR errors detected in question text' FROM base WHERE k % 5 = 0
UNION ALL SELECT source, unique_id, 'MAJOR', 'Only 2 answer options found (expected 4-6)' FROM base WHERE n = 2
UNION ALL SELECT source, unique_id, 'CRITICAL', 'Question description too short - possible truncation' FROM base WHERE k % 5 IN (0, 1, 2)""",
)
def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.comparison_issues(_dirty(spark, sf_dir)).select("source", "unique_id", "level", "issue")


@query(
    "comparison_rows",
    f"WITH {_BASE} SELECT source, unique_id, description, {_OPTIONS_TEXT} AS options_text, k % 10 = 0 AS missing FROM base ORDER BY source, page_number LIMIT 20",
)
def _side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.comparison_rows(questions(spark, sf_dir), _cache(spark, sf_dir))
    return rows.select("source", "unique_id", "description", "options_text", (F.col("page_text") == "Page text not available").alias("missing"))


# ---- model answers -------------------------------------------------------------------------------------------------


@query(
    "prompts",
    f"WITH {_BASE} SELECT unique_id AS question_id, source, {_lit(R.PROMPT.split('{question}')[0])} || description || {_lit(R.PROMPT.split('{question}')[1].split('{options}')[0])} || "
    f"'A. ' || a || chr(10) || 'B. ' || b || coalesce(chr(10) || 'C. ' || c || chr(10) || 'D. ' || d, '') || {_lit(R.PROMPT.split('{options}')[1])} AS prompt FROM base",
)
def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.prompts(questions(spark, sf_dir))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fixtures.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    letter = F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    text = F.concat(
        F.lit("The correct answer is "), letter, F.lit(".\n\nReasoning: "), "p_name", F.lit(" fits BigQuery best, as the "), "p_type", F.lit(" case needs little care and keeps its cost low over time.\n\nDone.")
    )
    bad = F.col("p_partkey") % 7 == 0
    return part.select(
        F.concat(F.lit("Q"), (F.col("p_partkey") + 1).cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("question_id"),
        F.concat(F.lit("Questions_"), (F.col("p_partkey") % 13 + 1).cast("string"), F.lit(".pdf")).alias("source"),
        F.when(bad, F.lit("")).otherwise(text).alias("response_text"),
        F.when(bad, F.lit("request failed")).alias("error"),
    )


_REASON = "p_name || ' fits BigQuery best, as the ' || p_type || ' case needs little care and keeps its cost low over time.'"
_RESPONSE = f"""r AS (SELECT k, unique_id AS question_id, source, k % 7 = 0 AS bad, substr('ABCD', CAST(k % 4 + 1 AS INTEGER), 1) AS letter, {_REASON} AS reason,
    length('The correct answer is X.' || chr(10) || chr(10) || 'Reasoning: ' || {_REASON} || chr(10) || chr(10) || 'Done.') AS n FROM base)"""


@query(
    "parse_responses",
    f"""WITH {_BASE}, {_RESPONSE} SELECT question_id, source, CASE WHEN bad THEN '' ELSE letter END AS correct_answer, CASE WHEN bad THEN '' ELSE reason END AS reasoning,
    CASE WHEN bad THEN 0.0::DOUBLE ELSE 0.4::DOUBLE + CASE WHEN length(reason) >= 100 THEN 0.35::DOUBLE WHEN length(reason) >= 50 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN n >= 200 THEN 0.15::DOUBLE WHEN n >= 100 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE END AS confidence FROM r""",
)
def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.parse_responses(_responses(spark, sf_dir)).select("question_id", "source", "correct_answer", "reasoning", "confidence")


@query(
    "apply_responses",
    f"WITH {_BASE}, {_RESPONSE} SELECT question_id AS unique_id, source, CASE WHEN bad THEN '' ELSE letter END AS llm_answer, CASE WHEN bad THEN '' ELSE reason END AS llm_reasoning, NOT bad AS has_llm_answer FROM r",
)
def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = answers.apply_responses(questions(spark, sf_dir), answers.parse_responses(_responses(spark, sf_dir)))
    return done.select("unique_id", "source", "llm_answer", "llm_reasoning", "has_llm_answer")


@query("run_counters", f"WITH {_BASE} SELECT count(*) AS questions, count(*) AS eligible, count(*) FILTER (k % 7 <> 0) AS processed, count(*) FILTER (k % 7 = 0) AS failed FROM base")
def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.run_counters(questions(spark, sf_dir), _responses(spark, sf_dir))


@query("enhanced_questions")
def _enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = enhance_questions(questions(spark, sf_dir))
    return q.select("source", "unique_id", "description", T.options_text(F.col("options")).alias("options_text"))


# ---- errors and exam -----------------------------------------------------------------------------------------------


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    level = F.element_at(F.array(*[F.lit(x) for x in ("WARNING", "ERROR", "CRITICAL")]), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit("Type"), (F.col("user_id") % 4).cast("string")).alias("error_type"),
        F.col("event_id").cast("string").alias("error_message"),
        F.lit("").alias("context"),
        F.lit("").alias("traceback"),
        level.alias("severity"),
        (F.col("value") > 5).alias("recoverable"),
    )


_ERRORS = "e AS (SELECT 'Type' || (user_id % 4) AS t, list_extract(['WARNING', 'ERROR', 'CRITICAL'], CAST(user_id % 3 + 1 AS INTEGER)) AS s, value > 5 AS r, event_id, ts FROM events WHERE event_type = 'error')"


@query(
    "error_summary",
    f"WITH {_ERRORS} SELECT 'total' AS measure, '' AS value, count(*) AS errors FROM e UNION ALL SELECT 'type', t, count(*) FROM e GROUP BY t UNION ALL SELECT 'severity', s, count(*) FROM e GROUP BY s "
    "UNION ALL SELECT 'recoverable', '', count(*) FILTER (r) FROM e UNION ALL SELECT 'critical', '', count(*) FILTER (s = 'CRITICAL') FROM e",
)
def _error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_summary(_errors(spark, sf_dir))


@query("last_errors", f"WITH {_ERRORS} SELECT CAST(event_id AS VARCHAR) AS error_message, t AS error_type FROM e ORDER BY ts DESC, t DESC LIMIT 5")
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.last_errors(_errors(spark, sf_dir)).select("error_message", "error_type")


@query("first_questions", f"WITH {_BASE} SELECT source, unique_id FROM base ORDER BY source, page_number LIMIT 50")
def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).orderBy("source", "page_number", "start_line").limit(50).select("source", "unique_id")


@query(
    "exam_scores",
    f"""WITH {_BASE}, x AS (SELECT k % 50 AS u, vote, CASE WHEN k % 9 = 0 THEN '' ELSE substr('ABCD', CAST(k % 3 + 1 AS INTEGER), 1) END AS given FROM base WHERE vote <> ''),
g AS (SELECT CAST(u AS VARCHAR) AS "user", count(*) FILTER (given <> '') AS answered, count(*) FILTER (given = vote) AS correct, count(*) FILTER (given = '') AS skipped, count(*) AS n FROM x GROUP BY u)
SELECT "user", answered, correct, skipped, CAST(correct AS DOUBLE) / n AS score, CAST(correct AS DOUBLE) / n >= 0.7::DOUBLE AS passed FROM g""",
)
def _exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    k = F.col("p_partkey")
    given = fixtures.spread(table(spark, sf_dir, "part").select("p_partkey")).select(
        (k % 50).cast("string").alias("user"),
        F.concat(F.lit("Q"), (k + 1).cast("string"), F.lit("_"), k.cast("string")).alias("unique_id"),
        F.when(k % 9 == 0, "").otherwise(F.substring(F.lit("ABCD"), (k % 3 + 1).cast("int"), F.lit(1))).alias("answer"),
    )
    return report.score_exam(q, given)


@query(
    "question_confidence",
    """
WITH d AS (SELECT doc_id, length(text) AS n, CAST(doc_id % 6 AS INTEGER) AS o, CASE WHEN doc_id % 4 = 0 THEN 'A' ELSE '' END AS a, CASE WHEN doc_id % 3 = 0 THEN 'AB' WHEN doc_id % 3 = 1 THEN 'x' ELSE 'F' END AS b, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '1' END AS num FROM documents)
SELECT doc_id, least(1.0::DOUBLE, (CASE WHEN n >= 50 THEN 0.4::DOUBLE WHEN n >= 20 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN o >= 4 THEN 0.3::DOUBLE WHEN o >= 2 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE (CASE WHEN a <> '' THEN 1 ELSE 0 END + CASE WHEN b <> 'x' THEN 1 ELSE 0 END) WHEN 2 THEN 0.2::DOUBLE WHEN 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN num = '' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END)) AS confidence FROM d""",
)
def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    c = scores.question_confidence(
        F.col("text"),
        (i % 6).cast("int"),
        [F.when(i % 4 == 0, "A").otherwise(""), F.when(i % 3 == 0, "AB").when(i % 3 == 1, "x").otherwise("F"), F.lit("")],
        F.when(i % 5 == 0, "").otherwise("1"),
        F.lit("General"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("confidence"))


def _all_registered() -> None:
    from . import source_queries  # noqa: F401 (it registers its own, with the helpers above)


def queries() -> dict[str, Query]:
    _all_registered()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all_registered()
    return dict(_SQL)
