"""Field extraction: question blocks become questions and comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from ..config import DEFAULT, EngineConfig
from ..functions import scores
from ..functions import text as T
from .segment import is_marker, lines_of


def any_match(c: Column, patterns, flags: str = "(?i)") -> Column:
    return c.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def first_of(*found: Column) -> Column:
    """The first non-empty string, or an empty one."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def is_comment(line: Column) -> Column:
    """Whether a line is a community comment: an icon glyph, or one of the comment patterns, or a known user's name first."""
    users = r"^(?:" + "|".join(R.USERNAMES) + ")"
    line = T.strip(line)
    return (line != "") & (line.rlike(R.COMMENT_ICONS) | any_match(line, (*R.COMMENT_PATTERNS, users)))


def question_number(block: Column) -> Column:
    pick = lambda p: F.regexp_extract(block, p, 1)
    return first_of(pick(r"(?i)Question\s*#\s*(\d+)"), pick(r"(?i)Question\s+(\d+)"), pick(r"(\d+)\.\s"))


def topic(block: Column) -> Column:
    """``Topic N``, else the first known service that the text names, else General."""
    n = F.regexp_extract(block, r"(?i)Topic\s+(\d+)", 1)
    out = F.when(n != "", F.concat(F.lit("Topic "), n))
    for s in R.SERVICES:
        out = out.when(F.contains(F.lower(block), F.lit(s.lower())), F.lit(s))
    return out.otherwise(F.lit("General"))


def description(block: Column) -> Column:
    """The text between marker and options, after the last five fitting lines before the marker."""
    lines = F.filter(lines_of(F.replace(block, F.lit("\\n"), F.lit("\n"))), lambda x: (x != "") & ~is_comment(x) & ~x.rlike(R.ARTIFACT_LINE))

    def of(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, is_marker), F.lit(True)).cast("int")
        intro = F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(lines)
        intro = F.filter(
            intro,
            lambda x: ~x.rlike(r"(?i)^Topic\s+\d+")
            & ~x.rlike(R.USER_TIME_LINE)
            & (F.length(x) > 20)
            & ((F.length(x) > 30) | any_match(x, R.INTRO_INDICATORS)),
        )
        intro = F.filter(F.slice(intro, F.greatest(F.size(intro) - 4, F.lit(1)), F.lit(5)), lambda x: ~x.rlike(r"Question Set|Topic \d+"))
        body = F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.slice(lines, F.lit(1), F.lit(0)))
        body = F.filter(body, lambda x: ~is_marker(x))
        stop = F.array_position(F.transform(body, lambda x: x.rlike(r"^[A-F][.)]\s")), F.lit(True)).cast("int")
        body = F.when(stop > 0, F.slice(body, F.lit(1), stop - 1)).otherwise(body)
        return F.array_join(F.concat(intro, body), " ")

    joined = F.transform(F.array(lines), of)[0]
    return T.guarded_fold(T.squeeze(T.strip(joined)), R.OCR_DESCRIPTION)


def options(block: Column) -> Column:
    """array<struct(pos, letter, text)>, by first appearance; of several texts of a letter the longest, then the first."""
    votes = r"(?i)is the answer|upvoted|months ago|weeks ago|days ago|Selected Answer"
    found = F.transform(
        lines_of(block),
        lambda x, i: F.struct(
            i.alias("pos"),
            F.upper(F.regexp_extract(x, r"(?i)^([A-F])[.)]\s*(.+)", 1)).alias("letter"),
            T.strip(F.regexp_extract(x, r"(?i)^([A-F])[.)]\s*(.+)", 2)).alias("text"),
        ),
    )
    fits = F.filter(
        found,
        lambda o: (o["letter"] != "") & ~o["text"].rlike(votes) & (F.length(o["text"]) >= 2) & ((F.length(o["text"]) >= 5) | o["text"].rlike(r"[~/\\.]")),
    )
    fits = F.transform(fits, lambda o: F.struct(o["pos"].alias("pos"), o["letter"].alias("letter"), T.guarded_fold(o["text"], R.OCR_OPTION).alias("text")))

    def best(all_options: Column, letter: str) -> Column:
        own = F.filter(all_options, lambda o: o["letter"] == letter)
        top = F.array_max(F.transform(own, lambda o: F.struct(F.length(o["text"]).alias("n"), (-o["pos"]).alias("p"), o["text"].alias("t"))))
        first = F.array_min(F.transform(own, lambda o: o["pos"]))
        return F.when(F.size(own) > 0, F.struct(first.alias("pos"), F.lit(letter).alias("letter"), top["t"].alias("text")))

    one = F.transform(F.array(fits), lambda o: F.array_sort(F.filter(F.array(*[best(o, x) for x in R.LETTERS]), lambda b: b.isNotNull())))
    return one[0]


#: Kinds of community answers by the labels that name them; a line counts for the first that it holds.
LABELS = (("community", ("selected answer", "correct answer")), ("highly", ("highly voted",)), ("recent", ("most recent",)))


def community_answers(block: Column) -> Column:
    """struct(community, highly, recent, latest_date).

    An answer is the letter after its label, or else at the next line's start;
    the last line that has one counts. latest_date is the last line's relative
    time or date, as it stands.
    """
    lines = lines_of(block)

    def answers(arr: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            low = F.lower(x)
            kind = F.lit("")
            for name, labels in reversed(LABELS):
                kind = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in labels]), name).otherwise(kind)
            here = F.regexp_extract(F.upper(x), r"(?:SELECTED ANSWER|CORRECT ANSWER|HIGHLY VOTED|MOST RECENT).*?\b([A-F])(?=\s|$|\.)", 1)
            there = F.regexp_extract(F.upper(F.coalesce(F.get(arr, i + 1), F.lit(""))), r"^([A-F])(?=\s|$|\.)", 1)
            return F.struct(kind.alias("kind"), F.when(kind != "", first_of(here, there)).otherwise(F.lit("")).alias("letter"))

        found = F.transform(arr, line)
        dates = F.transform(
            arr,
            lambda x: first_of(
                *[F.regexp_extract(F.lower(x), p, 1) for p in (r"(\d{1,2}\s+(?:days?|weeks?|months?|years?)\s+ago)", r"(\d{1,2}/\d{1,2}/\d{2,4})", r"(\d{4}-\d{2}-\d{2})")]
            ),
        )
        last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
        of_kind = lambda n: F.filter(found, lambda f: (f["kind"] == n) & (f["letter"] != ""))
        return F.struct(
            *[last(F.transform(of_kind(n), lambda f: f["letter"])).alias(n) for n, _ in LABELS],
            last(F.filter(dates, lambda d: d != "")).alias("latest_date"),
        )

    return F.transform(F.array(lines), answers)[0]


def introductory_info(c: Column) -> Column:
    """The first introduction pattern that matches, squeezed, without page artifacts, 2000 characters at most."""
    found = first_of(*[T.strip(F.regexp_extract(c, "(?is)" + p, 1)) for p in R.INTRO_PATTERNS])
    found = F.regexp_replace(F.regexp_replace(T.squeeze(found), r"Page\s+\d+", ""), r"ExamTopics[^\n]*", "")
    # every pattern needs one of the hints, so other texts cost one search
    return F.when(c.rlike(R.INTRO_HINT), F.left(T.strip(found), F.lit(2000))).otherwise(F.lit(""))


def with_own_number(rows: DataFrame) -> DataFrame:
    """rows with own: the number, or for a question without one a counter of its file."""
    counter = Window.partitionBy("source_file", F.col("number") == "").orderBy("start_page", "start_line")
    numbered = rows.filter("number <> ''").withColumn("own", F.col("number"))
    counted = rows.filter("number = ''").withColumn("own", F.row_number().over(counter).cast("string"))
    return numbered.unionByName(counted)


def unique_id() -> Column:
    return F.concat(F.lit("Q"), F.col("start_page").cast("string"), F.lit("_"), F.col("own"))


def parse_questions(blocks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Questions (see schemas.QUESTIONS) of the blocks that are long and complete enough, in no order.

    unique_id is ``Q{page}_{number}``; a question without a number takes a
    counter of its file. The key of a question is (source, unique_id, start_line).
    Missing strings are empty, never null.
    """
    text = F.col("full_content")
    rows = blocks.filter(F.length(T.strip(text)) >= config.min_block_chars).select(
        "*",
        question_number(text).alias("number"),
        topic(text).alias("topic"),
        description(text).alias("description"),
        options(text).alias("options"),
        community_answers(text).alias("answers"),
    )
    rows = with_own_number(rows)
    answers = [F.col("answers")[n] for n, _ in LABELS]
    confidence = scores.question_confidence(F.col("description"), F.size("options"), answers, F.col("number"), F.col("topic"))
    out = rows.select(
        unique_id().alias("unique_id"),
        F.col("number").alias("original_number"),
        "description",
        "options",
        answers[0].alias("community_answer"),
        answers[1].alias("highly_voted_answer"),
        answers[2].alias("most_recent_answer"),
        F.lit("").alias("llm_answer"),
        F.lit("").alias("llm_reasoning"),
        F.col("answers")["latest_date"].alias("latest_date"),
        "topic",
        F.col("start_page").alias("page_number"),
        confidence.alias("confidence_score"),
        F.col("source_file").alias("source"),
        F.col("full_content").alias("raw_content"),
        F.concat(F.lit(config.input_directory.rstrip("/") + "/"), F.col("source_file")).alias("source_pdf_path"),
        introductory_info(text).alias("introductory_info"),
        F.lit(False).alias("has_llm_answer"),
        "start_line",
    )
    return out.filter(F.col("confidence_score") >= F.lit(config.min_confidence))


def parse_comments(blocks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Comments (see schemas.COMMENTS) of all blocks that are long enough, also of those whose question is dropped later."""
    text = F.col("full_content")
    rows = blocks.filter(F.length(T.strip(text)) >= config.min_block_chars)
    rows = with_own_number(rows.select("source_file", "start_page", "start_line", "full_content", question_number(text).alias("number"))).select(
        unique_id().alias("question_id"),
        F.explode(F.filter(lines_of(text), is_comment)).alias("content"),
        F.col("start_page").alias("page_number"),
        F.col("source_file").alias("source"),
    )
    user = r"^\s*([A-Za-z][A-Za-z0-9_]{2,})\s+(\d+\s+(?:years?|months?|weeks?|days?),?\s*(?:\d+\s+(?:months?|weeks?|days?))?\s+ago)"
    c = F.col("content")
    vote = F.lit("")
    for name in ("Selected Answer", "Most Recent", "Highly Voted"):
        vote = F.when(c.rlike(f"(?i){name}"), name).otherwise(vote)
    return rows.select(
        "question_id",
        F.regexp_extract(c, user, 1).alias("username"),
        "content",
        F.regexp_extract(c, user, 2).alias("timestamp"),
        F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)upvoted\s+(\d+)\s+times?", 1), F.lit("")).cast("int"), F.lit(0)).alias("vote_count"),
        vote.alias("vote_type"),
        "page_number",
        "source",
    )


def without_comments(block: Column) -> Column:
    """The block's text without its comment lines."""
    return F.array_join(F.filter(F.split(block, "\n"), lambda x: ~is_comment(x)), "\n")
