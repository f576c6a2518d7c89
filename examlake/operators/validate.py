"""Data-quality checks of extracted questions against their source pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from .parse import any_match


def _issue(kind: str, severity: str, said: Column | str, confidence: Column | float = 0.0, actual: Column | str = "", expected: str = "") -> Column:
    col = lambda x: F.lit(x) if not isinstance(x, Column) else x
    return F.struct(
        F.lit(kind).alias("issue_type"),
        F.lit(severity).alias("severity"),
        col(said).alias("description"),
        F.lit(expected).alias("expected"),
        col(actual).alias("actual"),
        col(confidence).cast("double").alias("confidence"),
    )


def _when(condition: Column, issue: Column) -> Column:
    """One issue if the condition holds (null: it doesn't), else none."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(issue)).otherwise(F.array().cast(_ISSUES))


_ISSUES = "array<struct<issue_type:string,severity:string,description:string,expected:string,actual:string,confidence:double>>"


def text_similarity(pairs: DataFrame) -> DataFrame:
    """pairs with a column ratio: the longest-matching-blocks ratio of columns one and two (0 if either is empty).

    The one check without a built-in counterpart; it runs in Arrow batches.
    """
    import difflib

    schema = pairs.schema
    names = [f.name for f in schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ratio = [
                difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in zip(frame["one"], frame["two"], strict=True)
            ]
            yield frame[names].assign(ratio=ratio)

    return pairs.mapInPandas(run, ddl + ", ratio double")


def best_matches(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """unique_id, source, start_line, strategy, similarity: the page text that is most like the question's description (ties: strategy's name)."""
    key = ["source", "unique_id", "start_line"]
    pages = cache.select(F.col("source_file").alias("source"), "page_number", "strategy", F.col("text").alias("page_text")).filter("page_text <> ''")
    pairs = questions.join(pages, ["source", "page_number"]).select(
        *key, "strategy", T.comparable(F.col("description")).alias("one"), T.comparable(F.col("page_text")).alias("two")
    )
    rated = text_similarity(pairs)
    best = rated.groupBy(*key).agg(F.min(F.struct((-F.col("ratio")).alias("r"), "strategy")).alias("b"))
    return best.select(*key, F.col("b.strategy").alias("strategy"), (-F.col("b.r")).alias("similarity"))


def page_texts(cache: DataFrame) -> DataFrame:
    """source, page_number, page_text (of the default strategy), letters (distinct option letters that start a line under any strategy)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s*([A-F])[.):]"), 1), lambda x: x))
    each = cache.select(F.col("source_file").alias("source"), "page_number", "strategy", "text", found.alias("letters"))
    return each.groupBy("source", "page_number").agg(
        F.coalesce(F.max(F.when(F.col("strategy") == "default", F.col("text"))), F.lit("")).alias("page_text"),
        F.size(F.array_distinct(F.flatten(F.collect_list("letters")))).alias("letters"),
    )


def issues(questions: DataFrame, cache: DataFrame, similarity: bool = True) -> DataFrame:
    """Issue rows (schemas.ISSUES, with source and start_line) of every question.

    cache has source_file, page_number, strategy, text. A question without
    source or page, or without a cached page, gets that one issue and no other
    check. similarity=False leaves out the comparison of texts.
    """
    q = questions.join(page_texts(cache), ["source", "page_number"], "left")
    if similarity:
        q = q.join(best_matches(questions, cache).select("source", "unique_id", "start_line", "similarity"), ["source", "unique_id", "start_line"], "left")
    else:
        q = q.withColumn("similarity", F.lit(1.0))
    d, n, page = F.col("description"), F.size("options"), F.col("page_text")
    no_key = (F.coalesce("source", F.lit("")) == "") | (F.coalesce("page_number", F.lit(0)) == 0)
    near = F.coalesce("similarity", F.lit(0.0))
    share = F.format_string("%.2f%%", near * 100)
    short = F.length(d) < 20
    text_check = F.when(short, _when(F.lit(True), _issue("missing_text", "critical", "Question description is missing or too short", 0.0, d, "Complete question text"))).otherwise(
        F.when(near < 0.7, F.array(_issue("text_accuracy", "major", F.concat(F.lit("Low text similarity ("), share, F.lit(") with page source")), near))).otherwise(
            _when(near < 0.9, _issue("text_accuracy", "minor", F.concat(F.lit("Moderate text similarity ("), share, F.lit(") with page source")), near))
        )
    )
    expected = F.greatest(F.coalesce("letters", F.lit(0)), F.lit(4))
    count = n.cast("string")
    option_check = F.when(
        n < 2, F.array(_issue("missing_options", "critical", F.concat(F.lit("Too few answer options: "), count, F.lit(" (minimum 2 expected)"))))
    ).otherwise(
        F.concat(
            _when(n < 4, _issue("incomplete_options", "major", F.concat(F.lit("Incomplete answer options: "), count, F.lit(" (typically 4-6 expected)")))),
            F.transform(
                F.filter("options", lambda o: F.length(o["text"]) < 3),
                lambda o: _issue("empty_option", "major", F.concat(F.lit("Option "), o["letter"], F.lit(" is empty or too short: '"), o["text"], F.lit("'"))),
            ),
            _when(
                n < expected * F.lit(0.8),
                _issue("missing_options", "major", F.concat(F.lit("Missing answer options: found "), count, F.lit(", expected ~"), expected.cast("string"))),
            ),
        )
    )
    polluted = F.concat(
        *[
            _when(d.rlike("(?i)" + p), _issue("community_pollution", "critical", F.concat(F.lit("Community comment text found in question description: '"), F.regexp_extract(d, "(?i)" + p, 0), F.lit("'"))))
            for p in R.POLLUTION
        ],
        *[
            F.transform(
                F.regexp_extract_all(d, F.lit("(?i)" + p), 0),
                lambda m: _issue("community_pollution", "critical", F.concat(F.lit("Username/community text in question: '"), m, F.lit("'"))),
            )
            for p in R.POLLUTION_USERS
        ],
    )
    texts = F.concat(F.array(d, F.col("introductory_info")), F.transform("options", lambda o: o["text"]))
    ocr = F.flatten(
        F.transform(
            texts,
            lambda t: F.concat(
                *[
                    F.transform(F.regexp_extract_all(t, F.lit("(?i)" + p), 0), lambda m: _issue("ocr_error", "minor", F.concat(F.lit("OCR error detected: '"), m, F.lit("' - likely needs correction"))))
                    for p in R.OCR_ERRORS
                ]
            ),
        )
    )
    complete = F.concat(
        _when((d != "") & ~F.rtrim(d).rlike(r"[?.:)]$"), _issue("truncated_text", "major", F.concat(F.lit("Question may be truncated - ends with: '"), F.right(d, F.lit(20)), F.lit("'")))),
        _when(
            any_match(page, R.PAGE_CASE_STUDY) & (T.strip(F.col("introductory_info")) == ""),
            _issue("missing_intro", "major", "Case study information detected in the page but not extracted"),
        ),
    )
    found = (
        F.when(no_key, F.array(_issue("missing_metadata", "critical", "Missing source file or page number")))
        .when(page.isNull(), F.array(_issue("pdf_access_error", "critical", F.concat(F.lit("Cannot access page "), F.col("page_number").cast("string"), F.lit(" of "), F.col("source")))))
        .otherwise(F.concat(text_check, option_check, polluted, ocr, complete))
    )
    rows = q.select(F.col("unique_id").alias("question_id"), "source", "start_line", "page_number", F.explode(found).alias("i"))
    return rows.select("question_id", "i.*", "page_number", "source", "start_line")


def validation_scores(found: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: total, issues by severity, accuracy, completeness and quality (0 without questions), and status."""
    kind, level = F.col("issue_type"), F.col("severity")
    counts = found.agg(
        F.lit(0).cast("long").alias("total"),
        F.count_if(kind == "text_accuracy").alias("text"),
        F.count_if(kind == "ocr_error").alias("ocr"),
        F.count_if(kind.isin("missing_text", "missing_options", "truncated_text")).alias("incomplete"),
        *[F.count_if(level == s).alias(s) for s in ("critical", "major", "minor")],
    )
    none = [F.lit(0).cast("long").alias(c) for c in counts.columns[1:]]
    both = counts.unionByName(questions.agg(F.count(F.lit(1)).alias("total"), *none))
    both = both.agg(*[F.sum(c).alias(c) for c in counts.columns])
    n = F.col("total").cast("double")
    rate = lambda x: F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.lit(1.0) - x / n)).otherwise(F.lit(0.0))
    quality = rate(F.col("critical") * F.lit(0.3) + F.col("major") * F.lit(0.1) + F.col("minor") * F.lit(0.02))
    return both.select(
        "total",
        "critical",
        "major",
        "minor",
        rate(F.col("text") + F.col("ocr") * F.lit(0.1)).alias("accuracy"),
        rate(F.col("incomplete").cast("double")).alias("completeness"),
        quality.alias("quality"),
        F.when(quality < 0.7, "fail").when(quality < 0.9, "warn").otherwise("good").alias("status"),
    )


def triage(questions: DataFrame) -> DataFrame:
    """unique_id, source, page_number, class: critical if the description holds community text, major if it has OCR errors or fewer than four options."""
    low = F.lower("description")
    polluted, ocr = F.lit(False), F.lit(False)
    for t in R.TRIAGE_COMMUNITY:
        polluted = polluted | F.contains(low, F.lit(t))
    for t in R.TRIAGE_OCR:
        ocr = ocr | F.contains(F.col("description"), F.lit(t))
    kind = F.when(polluted, "critical").when(ocr | (F.size("options") < 4), "major").otherwise("good")
    return questions.select("unique_id", "source", "page_number", kind.alias("class"))


def comparison_issues(questions: DataFrame) -> DataFrame:
    """unique_id, source, page_number, level, issue: the five rules of the side-by-side report."""
    d, n = F.col("description"), F.size("options")
    ocr = F.lit(False)
    for t in R.TRIAGE_OCR[:3]:
        ocr = ocr | F.contains(d, F.lit(t))
    say = lambda level, x: F.struct(F.lit(level).alias("level"), (x if isinstance(x, Column) else F.lit(x)).alias("issue"))
    rules = F.array(
        F.when(F.contains(F.lower(d), F.lit("upvoted")), say("CRITICAL", "Community comment 'upvoted' found in question text")),
        F.when(F.contains(F.lower(d), F.lit("highly voted")), say("CRITICAL", "Community comment 'Highly Voted' found in question text")),
        F.when(ocr, say("MAJOR", "OCR errors detected in question text")),
        F.when(n < 4, say("MAJOR", F.concat(F.lit("Only "), n.cast("string"), F.lit(" answer options found (expected 4-6)")))),
        F.when(F.length(d) < 50, say("CRITICAL", "Question description too short - possible truncation")),
    )
    rows = questions.select("unique_id", "source", "page_number", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("i"))
    return rows.select("unique_id", "source", "page_number", "i.*")


def comparison_rows(questions: DataFrame, cache: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The first questions in order beside their page's text (layout, else default), cut to 2000 characters."""
    text = cache.groupBy(F.col("source_file").alias("source"), "page_number").agg(
        F.coalesce(
            F.nullif(F.max(F.when(F.col("strategy") == "layout", F.col("text"))), F.lit("")),
            F.max(F.when(F.col("strategy") == "default", F.col("text"))),
        ).alias("page_text")
    )
    few = questions.orderBy("source", "page_number", "start_line").limit(config.report_rows)
    both = few.join(text, ["source", "page_number"], "left")
    return both.select(
        "source", "page_number", "start_line", "unique_id", "description", T.options_text(F.col("options")).alias("options_text"), F.left(F.coalesce("page_text", F.lit("Page text not available")), F.lit(2000)).alias("page_text")
    )
