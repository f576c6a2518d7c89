"""The second extractor: spans between markers, and case studies that fill a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from .parse import first_of, introductory_info
from .segment import file_texts, marker_spans


def span_options(c: Column) -> Column:
    """Options of a span: each ``X. text`` at a line's start up to the next one or an icon; the last text of a letter counts."""
    parts = F.split(F.regexp_replace(c, R.COMMENT_ICONS + r"[\s\S]*$", ""), r"\n(?=[A-F]\.)")
    found = F.transform(
        F.filter(parts, lambda x: x.rlike(r"^[A-F]\.\s*\S")),
        lambda x: F.struct(F.left(x, F.lit(1)).alias("letter"), T.strip(F.regexp_extract(x, r"(?s)^[A-F]\.\s*([^\n]+)", 1)).alias("text")),
    )
    last = lambda k: F.try_element_at(F.filter(found, lambda o: o["letter"] == k), F.lit(-1))
    return F.filter(
        F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("letter"), last(k)["text"].alias("text")) for i, k in enumerate(R.LETTERS)]),
        lambda o: F.coalesce(o["text"], F.lit("")) != "",
    )


def community_letters(c: Column) -> Column:
    """struct(community, highly, recent): isolated capital letters after their labels; community falls back on the others."""
    pick = lambda label: F.regexp_extract(c, rf"(?s)(?i:{label}).*?\b([A-F])\b", 1)
    highly, recent = pick(r"Highly\s+Voted"), pick(r"Most\s+Recent")
    selected = F.regexp_extract(c, r"(?i:Selected\s+Answer):\s*([A-F])\b", 1)
    return F.struct(first_of(selected, highly, recent).alias("community"), highly.alias("highly"), recent.alias("recent"))


_NAMES = ("id", "number", "description", "options", "case_study_info", "page_number", "source_file", "confidence_score", "community_answer", "highly_voted_answer", "most_recent_answer", "comments")


def page_questions(pages: DataFrame) -> DataFrame:
    """Questions of single pages: a description of 10 characters or more and two options or more; confidence 0.8."""
    spans = marker_spans(pages)
    span = F.col("span")
    body = F.regexp_extract(span, r"(?is)^Question\s*#?\s*\d+[^\n]*\n(.*)$", 1)
    cut = F.regexp_instr(body, F.lit(r"\n?(?m:^[A-F]\.)"))
    before = F.when(cut > 0, F.substring(body, F.lit(1), cut - 1)).otherwise(body)
    after = F.when(cut > 0, F.substring(body, cut, F.length(body))).otherwise(F.lit(""))
    rows = spans.select("*", T.drop_icons(before).alias("text"), span_options(body).alias("options"), community_letters(after).alias("answers"), after.alias("rest"))
    rows = rows.filter((F.length("text") >= 10) & (F.size("options") >= 2))
    return rows.select(
        F.concat(F.lit("Q"), F.col("page_number").cast("string"), F.lit("_"), F.col("number")).alias("id"),
        "number",
        T.guarded_fold(F.col("text"), R.OCR_ROBUST).alias("description"),
        F.transform("options", lambda o: F.struct(o["pos"].alias("pos"), o["letter"].alias("letter"), T.guarded_fold(T.drop_icons(o["text"]), R.OCR_ROBUST).alias("text"))).alias("options"),
        F.lit("").alias("case_study_info"),
        "page_number",
        "source_file",
        F.lit(0.8).alias("confidence_score"),
        F.col("answers.community").alias("community_answer"),
        F.col("answers.highly").alias("highly_voted_answer"),
        F.col("answers.recent").alias("most_recent_answer"),
        T.strip(F.col("rest")).alias("comments"),
    ).select(*_NAMES)


def case_study_questions(files: DataFrame) -> DataFrame:
    """At most one question of each file (source_file, full_text): what follows its first case-study reference; confidence 0.85."""
    text = T.drop_icons(F.col("full_text"))
    rows = files.select("source_file", text.alias("text"))
    rows = rows.select("*", T.strip(F.regexp_extract("text", R.CASE_STUDY, 1)).alias("name"), T.strip(F.regexp_extract("text", R.CASE_STUDY, 2)).alias("section")).filter("name <> ''")
    cut = F.regexp_instr("section", F.lit(R.COMMUNITY_START))
    rows = rows.withColumn("front", F.when(cut > 0, F.substring("section", F.lit(1), cut - 1)).otherwise(F.col("section")))
    rows = rows.withColumn("back", F.when(cut > 0, F.substring("section", cut, F.length("section"))).otherwise(F.lit("")))
    parts = F.split("front", r"(?=[A-F]\.)")
    found = F.transform(F.filter(parts, lambda x: x.rlike(r"^[A-F]\.\s*\S")), lambda x: F.struct(F.left(x, F.lit(1)).alias("letter"), T.squeeze(T.strip(F.substring(x, F.lit(3), F.length(x)))).alias("text")))
    rows = rows.withColumn("found", found)
    last = lambda k: F.try_element_at(F.filter("found", lambda o: o["letter"] == k), F.lit(-1))
    own = F.filter(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("letter"), last(k)["text"].alias("text")) for i, k in enumerate(R.LETTERS)]), lambda o: o["text"].isNotNull())
    at = F.instr("section", "A.")
    said = F.when(at > 0, F.substring("section", F.lit(1), at - 1)).otherwise(F.col("section"))
    rows = rows.select("*", own.alias("options"), T.strip(said).alias("said"), community_letters(F.col("back")).alias("answers"))
    rows = rows.filter((F.size("found") >= 2) & (F.size("options") >= 2) & (F.length("said") > 10))
    return rows.select(
        F.concat(F.lit("case_study_"), F.replace(F.lower("name"), F.lit(" "), F.lit("_")), F.lit("_1")).alias("id"),
        F.lit("1").alias("number"),
        F.concat(F.lit("For this question, refer to the "), "name", F.lit(" case study. "), "said").alias("description"),
        "options",
        introductory_info(F.col("text")).alias("case_study_info"),
        F.lit(1).alias("page_number"),
        "source_file",
        F.lit(0.85).alias("confidence_score"),
        F.col("answers.community").alias("community_answer"),
        F.col("answers.highly").alias("highly_voted_answer"),
        F.col("answers.recent").alias("most_recent_answer"),
        "back",
    ).withColumnRenamed("back", "comments").select(*_NAMES)


def robust_questions(pages: DataFrame) -> DataFrame:
    """Page questions; for files without any, their case-study question."""
    found = page_questions(pages)
    rest = pages.join(found.select("source_file").distinct(), "source_file", "left_anti")
    return found.unionByName(case_study_questions(file_texts(rest)))
