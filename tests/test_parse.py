import pytest
from pyspark.sql import functions as F

from examlake.config import EngineConfig
from examlake.functions import scores
from examlake.operators import parse, robust, segment
from examlake.sources.readers import with_text

BLOCK = """Question #1 Topic 1

Which service should you use to store the archive data of a company at low cost?

A. Compute Engine disks
B. Cloud SQL database
C. Cloud Storage buckets
D. Local disks only

Selected Answer: C
Highly Voted: C
Most Recent: C"""


def pages(spark, *texts):
    return with_text(spark.createDataFrame([("Questions_1.pdf", i + 1, t) for i, t in enumerate(texts)], "source_file string, page_number int, raw_text string"))


def questions(spark, *texts, **config):
    c = EngineConfig(**config)
    return parse.parse_questions(segment.question_blocks(pages(spark, *texts), c), c)


def test_well_formed_question(spark):
    q = questions(spark, BLOCK).first()
    assert (q.original_number, q.topic, q.unique_id) == ("1", "Topic 1", "Q1_1")
    assert [(o.letter, o.text) for o in q.options] == [("A", "Compute Engine disks"), ("B", "Cloud SQL database"), ("C", "Cloud Storage buckets"), ("D", "Local disks only")]
    assert (q.community_answer, q.highly_voted_answer, q.most_recent_answer) == ("C", "C", "C")
    assert q.description.startswith("Which service") and q.confidence_score == 0.9999999999999999
    assert (q.llm_answer, q.introductory_info, q.has_llm_answer) == ("", "", False)


@pytest.mark.parametrize(
    "line,kept",
    [("A. ~/b", "~/b"), ("A. yes", None), ("a) lower case letter", "lower case letter"), ("A. C is the answer", None), ("A. upvoted 3", None), ("A. x", None)],
)
def test_option_filter(spark, line, kept):
    df = spark.createDataFrame([(line,)], "t string").select(parse.options(F.col("t")).alias("o"))
    assert [o.text for o in df.first().o] == ([kept] if kept else [])


def test_longest_option_wins_and_keeps_its_place(spark):
    text = "B. second option\nA. short one\nB. second option, longer\nA. other"
    o = spark.createDataFrame([(text,)], "t string").select(parse.options(F.col("t")).alias("o")).first().o
    assert [(x.letter, x.text) for x in o] == [("B", "second option, longer"), ("A", "short one")]


def test_two_questions_on_a_page_do_not_leak(spark):
    second = BLOCK.replace("#1", "# 2").replace("archive", "log").replace("D. Local disks only\n", "")
    a, b = questions(spark, BLOCK + "\n" + second).orderBy("start_line").collect()
    assert (a.original_number, b.original_number) == ("1", "2")
    assert len(a.options) == 4 and len(b.options) == 3 and "archive" not in b.description


def test_blocks_without_marker_or_text(spark):
    assert questions(spark, "No question here", "", "x").count() == 0
    assert questions(spark, "Question #3 short").count() == 0


def test_counter_for_questions_without_number(spark):
    blocks = spark.createDataFrame([("f", 1, i, "", ["x"], "A long block without a numeral in its text, but with options\nA. first option\nB. second option") for i in range(3)], "source_file string, start_page int, start_line int, question_header string, content_lines array<string>, full_content string")
    assert sorted(r.unique_id for r in parse.parse_questions(blocks).collect()) == ["Q1_1", "Q1_2", "Q1_3"]


def test_context_and_crlf_and_literal_breaks(spark):
    text = "Acme is a company that sells many things\r\nQuestion #7\r\nWhat should the team do with data\\nof the second line of this text?\r\nA. First option\r\nB. Second option"
    q = questions(spark, text).first()
    assert q.description == "Acme is a company that sells many things What should the team do with data of the second line of this text?"


def test_comments(spark):
    text = BLOCK + "\n  someone\nkopper2019 says hello\nsam_1 2 years, 3 months ago\nupvoted 12 times\n- dash\nhttps://x.y/z"
    rows = {r.content: r for r in parse.parse_comments(segment.question_blocks(pages(spark, text))).collect()}
    assert len(rows) == 9
    assert rows["sam_1 2 years, 3 months ago"].timestamp == "2 years, 3 months ago" and rows["sam_1 2 years, 3 months ago"].username == "sam_1"
    assert rows["upvoted 12 times"].vote_count == 12 and rows["Highly Voted: C"].vote_type == "Highly Voted"


def test_answers_on_the_next_line_and_last_wins(spark):
    text = "Most Recent\nB. because\nHighly Voted 1 year ago\nSelected Answer: A\n3 months ago\nSelected Answer: D\n2020-01-02"
    a = spark.createDataFrame([(text,)], "t string").select(parse.community_answers(F.col("t")).alias("a")).first().a
    assert (a.community, a.highly, a.recent, a.latest_date) == ("D", "", "B", "2020-01-02")


@pytest.mark.parametrize("length,options,answers,number,want", [(19, 1, 0, "", 0.05), (20, 2, 1, "1", 0.2 + 0.15 + 0.1 + 0.1), (49, 3, 0, "1", 0.2 + 0.15 + 0.1), (50, 4, 0, "1", 0.7999999999999999), (50, 6, 3, "1", 0.9999999999999999)])
def test_confidence(spark, length, options, answers, number, want):
    given = [F.lit("A" if i < answers else "") for i in range(3)]
    c = scores.question_confidence(F.lit("x" * length), F.lit(options), given, F.lit(number), F.lit("General"))
    assert spark.range(1).select(c.alias("c")).first().c == want


def test_buckets(spark):
    df = spark.createDataFrame([(0.8,), (0.7999999999999999,), (0.5,), (0.49,), (None,)], "c double")
    assert [r[0] for r in df.select(scores.bucket(F.col("c"))).collect()] == ["high", "medium", "medium", "low", "low"]


def test_look_back_and_look_ahead_limits(spark):
    lines = [f"context line number {i} of the page" for i in range(30)] + ["Question #1"] + [f"body line number {i}" for i in range(60)]
    b = segment.question_blocks(pages(spark, "\n".join(lines))).first()
    assert len(b.content_lines) == 20 + 1 + 49 and b.content_lines[0] == lines[10] and b.content_lines[-1] == "body line number 48"


def test_robust_extractor(spark):
    page = "Question #4 Topic 2\nWhich of these should the company choose first?\nA. The first way\nB. The second way\nuser_x Highly Voted 1 year ago\nSelected Answer: B"
    case = "Company Overview - Acme sells things. Question\nFor this question, refer to the Acme case study.\nWhat should Acme do with its data now?\nA. Keep it\nB. Drop it\nsomeone Highly Voted 3 months ago\nB is right"
    df = spark.createDataFrame([("a", 1, page), ("b", 1, "text only"), ("b", 2, case), ("c", 1, None)], "source_file string, page_number int, text string")
    a, b = robust.robust_questions(df).orderBy("source_file").collect()
    assert (a.id, a.community_answer, a.highly_voted_answer, len(a.options), a.confidence_score) == ("Q1_4", "B", "B", 2, 0.8)
    assert (b.id, b.community_answer, b.confidence_score, b.page_number) == ("case_study_acme_1", "B", 0.85, 1)
    assert b.description == "For this question, refer to the Acme case study. What should Acme do with its data now?"
    assert b.case_study_info.startswith("Acme sells things")
