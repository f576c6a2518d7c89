"""Segmentation of pages into question blocks.

Everything happens within a page's row, on its array of lines, so no line is
shuffled: pages are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..config import DEFAULT, EngineConfig
from ..functions import text as T


def lines_of(c: Column) -> Column:
    """The text's lines without white space at their ends."""
    return F.transform(F.split(c, "\n"), T.strip)


def is_marker(c: Column) -> Column:
    return c.rlike(R.MARKER)


def question_blocks(pages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row per question marker: source_file, start_page, start_line, question_header, content_lines, full_content.

    pages has source_file, page_number and text. A block is the context before
    its marker (at most look_back lines, without short lines, headers, votes and
    user times), the marker's line, and the non-blank lines up to the next
    marker or look_ahead lines on; a question never crosses a page. Lines that
    the question before has taken are no context. Pages without a marker, or
    with a null text, give no block.
    """
    base = pages.select("source_file", "page_number", lines_of(F.coalesce("text", F.lit(""))).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.when(is_marker(x), i))
    base = base.withColumn("marks", F.filter(numbered, lambda x: x.isNotNull()))
    rows = base.select("source_file", "page_number", "lines", "marks", F.posexplode("marks").alias("k", "at"))
    before = F.coalesce(F.get("marks", F.col("k") - 1) + config.look_ahead, F.lit(0))
    start = F.greatest(F.col("at") - config.look_back, before)
    end = F.least(F.coalesce(F.get("marks", F.col("k") + 1), F.size("lines")), F.col("at") + config.look_ahead)
    piece = lambda a, b: F.slice("lines", a + 1, F.greatest(b - a, F.lit(0)))
    context = F.filter(
        piece(start, F.col("at")), lambda x: (F.length(x) >= config.min_context_chars) & ~x.rlike(R.CONTEXT_ARTIFACT) & ~x.rlike(R.USER_TIME_LINE)
    )
    following = F.filter(piece(F.col("at") + 1, end), lambda x: x != "")
    header = F.get("lines", F.col("at"))
    content = F.concat(context, F.array(header), following)
    return rows.select(
        "source_file",
        F.col("page_number").alias("start_page"),
        F.col("at").alias("start_line"),
        header.alias("question_header"),
        content.alias("content_lines"),
        F.array_join(content, "\n").alias("full_content"),
    )


def file_texts(pages: DataFrame) -> DataFrame:
    """source_file and full_text: each file's pages in order, each behind a line ``--- PAGE n ---``."""
    page = F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))
    joined = F.transform(
        F.array_sort(F.collect_list(page)), lambda p: F.concat(F.lit("\n--- PAGE "), p["page_number"].cast("string"), F.lit(" ---\n"), p["text"])
    )
    return pages.groupBy("source_file").agg(F.array_join(joined, "").alias("full_text"))


def marker_spans(pages: DataFrame) -> DataFrame:
    """source_file, page_number, number, span: the text from each ``Question #n`` to the next one of the page."""
    parts = F.filter(F.split("text", r"(?i)(?=Question\s*#\s*\d+)"), lambda x: x.rlike(r"(?i)^Question\s*#\s*\d+"))
    spans = pages.select("source_file", "page_number", F.posexplode(parts).alias("at", "span"))
    return spans.select("source_file", "page_number", "at", F.regexp_extract("span", r"(?i)^Question\s*#\s*(\d+)", 1).alias("number"), "span")


def page_text_dump(pages: DataFrame) -> DataFrame:
    """value: each page's text under a banner of file and page."""
    bar = "=" * 50
    return pages.select(
        F.concat(
            F.lit(f"\n{bar}\nSource: "), "source_file", F.lit("\nPage: "), F.col("page_number").cast("string"), F.lit(f"\n{bar}\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")
        ).alias("value")
    )
