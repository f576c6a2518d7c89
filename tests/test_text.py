import pytest
from pyspark.sql import functions as F

from examlake import rules as R
from examlake.functions import text as T


def apply(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_enhance_golden(spark):
    assert apply(spark, T.enhance, "This   is  a    test   with     excessive   spacing", "", None) == ["This is a test with excessive spacing.", "", ""]


def test_clean_page(spark):
    raw = "https://www.examtopics.com/x 1\n12\nPage 4 of text\n\n\n\nbro-\nken    word\r\nq\nend"
    assert apply(spark, T.clean_page, raw, None) == ["1\n\n of text\n\nbroken  word\nend", ""]


@pytest.mark.parametrize(
    "f,before,after",
    [
        (T.drop_icons, "a  b█  c", "a b c"),
        (T.join_page_breaks, "exam-\nple lines\nmeet\nA.\nXyz", "example lines meet\nA. Xyz"),
        (T.standardize, "*  question 5  topic 2", "• Question #5 Topic 2"),
        (T.standardize, "b)  text", "B. text"),
        (T.fix_grammar, "an house, and  a apple ;x. one.  two", "a house, and an apple; x. One.  Two"),
        (T.case_terms, "use bigquery and CLOUD SQL near diameter", "use BigQuery and Cloud SQL near diameter"),
        (lambda c: T.case_terms(c, "reference"), "diameter", "dIAMeter"),
        (lambda c: T.fix_ocr(c, "reference"), "0pen 10 x", "Open lo x"),
        (T.fix_ocr, "C1oud in 10 parts ,of app1ication file.txt", "Cloud in 10 parts, of application file.txt"),
        (T.final_clean, "Wait....  what??  really !! yes , a much longer text", "Wait... what? really! yes, a much longer text."),
        (T.final_clean, "short", "short"),
        (T.repair_encoding, "itâ€™s Ã©t", "it's ét"),
        (T.comparable, " ExamTopics - Professional Page 3  traOc  ", "traffic"),
        (T.escape_markdown, "a|b*c_d`e#", "a\\|b\\*c\\_d\\`e\\#"),
        (lambda c: T.truncate(c, 8), "0123456789", "01234..."),
        (lambda c: T.truncate(c, 8), "01234567", "01234567"),
        (T.escape_html, "<a & b>", "&lt;a &amp; b&gt;"),
        (T.enhance_question, "Question #3. what is it", "what is it?"),
        (T.enhance_option, "B. deploy it", "Deploy it"),
        (T.enhance_option, "", ""),
    ],
)
def test_steps(spark, f, before, after):
    assert apply(spark, f, before) == [after]


@pytest.mark.parametrize("pattern,new", R.OCR_DESCRIPTION)
def test_every_dictionary_rule(spark, pattern, new):
    import re

    sample = {r"Data\^ow": "Data^ow", r"\^at\s+Kles": "^at  Kles", r"ll\s+months?\s+ago": "ll months ago"}.get(pattern, pattern)
    if pattern.startswith("^"):
        sample = "user 3 months ago said"
    got = apply(spark, lambda c: T.fold(c, [(pattern, new)], "(?i)"), f"{sample}")[0]
    assert got == re.sub(pattern, new, sample, flags=re.I)


def test_nested_values_only(spark):
    df = spark.createDataFrame([({"k": "v"}, [("a", 1), None], None)], "m map<string,string>, s array<struct<x:string,n:int>>, t string")
    row = T.clean_nested(df).first()
    assert row.m == {"k": "v"} and row.s[0].x == "a" and row.s[0].n == 1 and row.s[1] is None and row.t is None


def test_enhancement_check(spark):
    df = spark.createDataFrame([("BigQuery has 10 parts", "it has lo parts"), ("same", "same")], "a string, b string")
    one, two = [r[0] for r in df.select(T.enhancement_check(F.col("a"), F.col("b"))).collect()]
    assert one.numbers_changed and one.terms_lost and one.valid and two.valid and not two.numbers_changed


def test_a_lost_term_counts_beside_one_within_a_word(spark):
    rows = [("key AKIAMD62 BigQuery 17", "key AKIAMD62 x 17"), ("UNGKEIT BigQuery", "UNGKEIT BigQuery"), ("a diamond", "a diamond"), ("a bigquery", "a table"), ("no term", "none"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    lost = lambda **given: [r[0] for r in df.select(T.enhancement_check(F.col("a"), F.col("b"), **given)["terms_lost"]).collect()]
    assert lost() == [True, False, True, True, False, None]
    assert lost(rule_set="reference") == [False, False, True, True, False, None]
