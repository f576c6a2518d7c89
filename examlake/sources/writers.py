"""Sinks: CSV, Markdown, JSON, web JSON, summaries and the side-by-side report."""

from __future__ import annotations

import html
import json
import warnings
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..operators import report, search, segment, validate
from .. import rules as R


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def write_csv(questions: DataFrame, path: str, config: EngineConfig = DEFAULT) -> None:
    report.tabular(questions, config).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_markdown(questions: DataFrame, path: str, config: EngineConfig = DEFAULT) -> None:
    """A head, the table and the statistics as text files that sort in this order."""
    spark = questions.sparkSession
    total = questions.count()
    head = ["# Exam Questions", "", f"Generated on: {_now()}", f"Total Questions: {total}", "", "| " + " | ".join(config.columns) + " |", "| " + " | ".join(["---"] * len(config.columns)) + " |"]
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    ordered = questions.orderBy("source", "page_number", "start_line")
    report.markdown_rows(ordered, config).write.mode("overwrite").text(f"{path}/part=1")
    spark.createDataFrame([(x,) for x in statistics_lines(questions)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=2")


def statistics_lines(questions: DataFrame) -> list[str]:
    c = report.completeness(questions).first()
    total = c["total"]
    share = lambda n: f"{n} ({n / total * 100:.1f}%)" if total else "0"
    lines = ["", "## Statistics", "", "### Questions by source", ""]
    lines += [f"- {r['value']}: {r['questions']}" for r in report.by_source(questions).toLocalIterator()]
    lines += ["", "### Questions by topic", ""]
    lines += [f"- {r['value']}: {r['questions']}" for r in report.by_topic(questions).toLocalIterator()]
    lines += ["", "### Answers", ""]
    lines += [f"- {name}: {share(c[k])}" for name, k in (("Community", "community_answers"), ("Highly voted", "highly_voted_answers"), ("Most recent", "most_recent_answers"), ("Model", "llm_answers"))]
    return lines + ["", f"- Average confidence: {c['average_confidence'] or 0:.2f}", f"- High confidence: {share(c['high_confidence'])}"]


def write_json(questions: DataFrame, path: str) -> None:
    """JSON lines of the questions (options as a map), and a metadata line beside them."""
    body = questions.withColumn("options", T.options_map(F.col("options"))).drop("raw_content", "start_line")
    body.write.mode("overwrite").json(f"{path}/questions")
    row = report.confidence_stats(questions).first().asDict()
    lists = report.distinct_lists(questions).first()
    meta = {"generated_at": _now(), "total_questions": row["questions"], "source_files": lists["sources"], "topics": lists["topics"], "confidence_stats": row if row["questions"] else {}}
    questions.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def web_lines(questions: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """source, page, id, start_line, json: each question as the web document nests it (with comments, if given)."""
    q = report.web_question(questions, "start_line")
    if comments is not None:
        own = comments.groupBy(F.col("question_id").alias("cid"), F.col("source").alias("csource")).agg(F.array_sort(F.collect_list("content")).alias("comments"))
        q = q.join(own, (F.col("q.id") == F.col("cid")) & (F.col("q.metadata.source") == F.col("csource")), "left")
        q = q.select("start_line", F.col("q").withField("comments", F.coalesce("comments", F.array().cast("array<string>"))).alias("q"))
    return q.select(F.col("q.metadata.source").alias("source"), F.col("q.metadata.page").alias("page"), F.col("q.id").alias("id"), "start_line", F.to_json("q").alias("json"))


def write_web(questions: DataFrame, path: str, comments: DataFrame | None = None) -> None:
    """The web document as text files that make one JSON document in the order of their names: a head, a line for each question, a tail."""
    rows = web_lines(questions, comments)
    letters = F.array(*[F.lit(x) for x in R.LETTERS])
    meta = F.struct(F.lit(_now()).alias("generated_at"), F.col("n").alias("total_questions"), F.lit("1.0").alias("version"))
    sums = questions.agg(F.count(F.lit(1)).alias("n"), *report.distinct_columns())
    head = sums.select(F.concat(F.lit('{"metadata":'), F.to_json(meta), F.lit(',"filters":'), F.to_json(F.struct("topics", "sources", letters.alias("answer_options"))), F.lit(',"questions":[')).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    ordered = rows.orderBy("source", "page", "id", "start_line", "json")
    # the first row of a sorted table has number 0
    line = F.concat(F.when(F.monotonically_increasing_id() == 0, "").otherwise(","), "json")
    ordered.select(line.alias("value")).write.mode("overwrite").text(f"{path}/part=1")
    _write_lines(questions, ["]}"], f"{path}/part=2")


def summary_lines(questions: DataFrame) -> list[str]:
    c, s = report.completeness(questions).first(), report.confidence_stats(questions).first()
    total = c["total"]
    share = lambda n: f"{n}/{total} ({n / total * 100:.1f}%)" if total else "0/0"
    lines = ["# Extraction Summary", "", f"**Generated**: {_now()}", "", "## Overview", "", f"- Total questions processed: {total}", "", "## Quality Metrics", ""]
    lines += [f"- Average confidence score: {s['average'] or 0:.2f}", f"- High confidence questions: {s['high']}", f"- Medium confidence questions: {s['medium']}", f"- Low confidence questions: {s['low']}"]
    lines += ["", "## Data Completeness", ""]
    lines += [f"- Questions with {n}: {share(c[k])}" for n, k in (("descriptions", "descriptions"), ("options", "with_options"), ("community answers", "community_answers"), ("model answers", "llm_answers"))]
    lines += ["", "## Recommendations", ""]
    return lines + [f"- {r['recommendation']}" for r in report.recommendations(questions).orderBy("rank").collect()]


def _write_lines(df: DataFrame, lines: list[str], path: str) -> None:
    df.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_summary(questions: DataFrame, path: str) -> None:
    _write_lines(questions, summary_lines(questions), path)


def validation_lines(found: DataFrame, questions: DataFrame) -> DataFrame:
    """value: the report's lines in order, with every critical and major issue."""
    s = validate.validation_scores(found, questions).first()
    head = ["# Validation Report", "", f"- Questions: {s['total']}", f"- Accuracy: {s['accuracy']:.2%}", f"- Completeness: {s['completeness']:.2%}", f"- Quality: {s['quality']:.2%}", f"- Status: {s['status']}"]
    advice = [(s["accuracy"] < 0.8, "Improve text extraction"), (s["completeness"] < 0.9, "Review missing options and texts"), (s["critical"] > 0, "Fix critical issues first")]
    levels = ("critical", "major")
    fixed = [head] + [["", f"## {level.capitalize()} issues: {s[level]}", ""] for level in levels] + [["", "## Recommendations", ""] + [f"- {x}" for on, x in advice if on]]
    order = ["source", "page_number", "question_id", "issue_type", "description"]
    lines = questions.sparkSession.createDataFrame([(2 * i, k, x) for i, part in enumerate(fixed) for k, x in enumerate(part)], "part int, line int, value string")
    for i, level in enumerate(levels):
        text = F.concat(F.lit("- "), F.coalesce("question_id", F.lit("None")), F.lit(" (page "), F.coalesce(F.col("page_number").cast("string"), F.lit("None")), F.lit("): "), F.col("issue_type"), F.lit(" - "), F.coalesce("description", F.lit("None")))
        rows = found.filter(F.col("severity") == level).select(F.lit(2 * i + 3).alias("part"), *order, text.alias("value"))
        lines = lines.unionByName(rows, allowMissingColumns=True)
    return lines.orderBy("part", "line", *order).select("value")


def write_validation(found: DataFrame, questions: DataFrame, path: str) -> None:
    """The report as text files that sort in its order."""
    validation_lines(found, questions).write.mode("overwrite").text(path)


def write_comparison(questions: DataFrame, cache: DataFrame, path: str, config: EngineConfig = DEFAULT) -> None:
    """Side by side HTML of the first questions (config.report_rows) and their pages."""
    classes = {(r["source"], r["unique_id"]): r["class"] for r in validate.triage(questions.orderBy("source", "page_number", "start_line").limit(config.report_rows)).collect()}
    body = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Comparison</title></head><body>"]
    for r in validate.comparison_rows(questions, cache, config).orderBy("source", "page_number", "start_line").collect():
        body.append(f"<section class='{classes.get((r['source'], r['unique_id']), 'good')}' id='{html.escape(r['unique_id'])}'><h2>{html.escape(r['unique_id'])} - Page {r['page_number']}</h2>")
        body.append(f"<pre>{html.escape(r['page_text'])}</pre><div>{html.escape(r['description'])}</div><div>{html.escape(r['options_text'])}</div></section>")
    _write_lines(questions, body + ["</body></html>"], path)


def write_export(questions: DataFrame, filters: search.Filters, path: str) -> None:
    out = search.export_filtered(questions, filters, _now())
    line = F.concat(F.lit('{"exported_at":"'), "exported_at", F.lit('","filters_applied":'), "filters_applied", F.lit(',"total_questions":'), F.col("total_questions").cast("string"), F.lit(',"questions":['), F.array_join("questions", ","), F.lit("]}"))
    out.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_page_dump(pages: DataFrame, path: str) -> None:
    segment.page_text_dump(pages.orderBy("source_file", "page_number")).write.mode("overwrite").text(path)


def rewrite_in_place(path: str, spark) -> int:
    """Clean all strings of a JSON data set and put it in its place; the old one stays as path.backup, and comes back if the swap fails. Returns the rows written."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new", f"{path}.backup"
    fs = make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(make(new), True)
    rows = rewrite_clean(path, new, spark)
    fs.delete(make(old), True)
    if not fs.rename(make(path), make(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(make(new), make(path)):
        fs.rename(make(old), make(path))
        raise OSError(f"cannot replace {path}; the old data is back")
    return rows


def rewrite_clean(df_path: str, out_path: str, spark) -> int:
    """Clean all strings of a JSON data set into a new version; the old one stays as it is. Returns the rows written."""
    T.clean_nested(spark.read.json(df_path)).write.mode("errorifexists").json(out_path)
    return spark.read.json(out_path).count()


WRITERS = {"csv": write_csv, "md": write_markdown, "json": write_json, "web": write_web}


def write_all(questions: DataFrame, folder: str, formats: tuple[str, ...] = ("csv", "md", "json", "web"), comments: DataFrame | None = None) -> dict[str, str]:
    """Write the formats and a summary; returns their paths. Unknown formats are left out with a warning, an empty table writes nothing."""
    if questions.isEmpty():
        return {}
    out = {}
    for name in formats:
        if name not in WRITERS:
            warnings.warn(f"unknown format {name!r} is left out", stacklevel=2)
            continue
        out[name] = f"{folder}/{name}"
        if name == "web":
            write_web(questions, out[name], comments)
        else:
            WRITERS[name](questions, out[name])
    out["summary"] = f"{folder}/summary"
    write_summary(questions, out["summary"])
    return out
