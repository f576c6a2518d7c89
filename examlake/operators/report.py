"""Statistics and report rows over questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import scores
from ..functions import text as T


def _has(c: str) -> Column:
    return F.count_if(F.col(c) != "")


def confidence_stats(questions: DataFrame, by: str | None = None) -> DataFrame:
    """questions, average, minimum, maximum and the counts of the high, medium and low bucket; of each value of ``by``, if given.

    Without a row, an overall result has 0 questions and nulls.
    """
    level = scores.bucket(F.col("confidence_score"))
    aggs = [
        F.count(F.lit(1)).alias("questions"),
        F.avg("confidence_score").alias("average"),
        F.min("confidence_score").alias("minimum"),
        F.max("confidence_score").alias("maximum"),
        *[F.count_if(level == n).alias(n) for n in ("high", "medium", "low")],
    ]
    return questions.groupBy(by).agg(*aggs) if by else questions.agg(*aggs)


def count_by(questions: DataFrame, column: str, missing: str = "Unknown") -> DataFrame:
    """value, questions of a column, with a name for empty values."""
    return questions.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("questions"))


def by_source(questions: DataFrame) -> DataFrame:
    return count_by(questions, "source").orderBy("value")


def by_topic(questions: DataFrame) -> DataFrame:
    return count_by(questions, "topic").orderBy(F.desc("questions"), "value")


def completeness(questions: DataFrame) -> DataFrame:
    """total and the counts of questions with a description, options, each kind of answer and high confidence."""
    return questions.agg(
        F.count(F.lit(1)).alias("total"),
        _has("description").alias("descriptions"),
        F.count_if(F.size("options") > 0).alias("with_options"),
        _has("community_answer").alias("community_answers"),
        _has("highly_voted_answer").alias("highly_voted_answers"),
        _has("most_recent_answer").alias("most_recent_answers"),
        _has("llm_answer").alias("llm_answers"),
        F.count_if(F.col("confidence_score") >= F.lit(0.8)).alias("high_confidence"),
        F.count_if(F.col("confidence_score") < F.lit(0.5)).alias("low_confidence"),
        F.avg("confidence_score").alias("average_confidence"),
    )


def shares(questions: DataFrame) -> DataFrame:
    """completeness() as percentages of the total (null without questions)."""
    c = completeness(questions)
    names = ("descriptions", "with_options", "community_answers", "llm_answers", "high_confidence")
    return c.select("total", *[(F.col(n) * F.lit(100.0) / F.nullif(F.col("total"), F.lit(0))).alias(f"{n}_percent") for n in names])


def recommendations(questions: DataFrame) -> DataFrame:
    """rank, recommendation: what the figures call for, if anything."""
    c = completeness(questions)
    low, missing = F.col("low_confidence"), F.col("total") - F.col("llm_answers")
    say = F.array(
        F.when(low > 0, F.concat(F.lit("Review "), low.cast("string"), F.lit(" low confidence questions for manual validation"))),
        F.when(missing > 0, F.concat(F.lit("Consider reprocessing "), missing.cast("string"), F.lit(" questions missing model analysis"))),
        F.when(F.col("community_answers") < F.col("total") * F.lit(0.8), F.lit("Community answer extraction could be improved - review parsing logic")),
    )
    return c.select(F.posexplode(say).alias("rank", "recommendation")).filter("recommendation IS NOT NULL")


def tabular(questions: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The report's columns, named as configured; descriptions and options are cut, a missing number is the id."""
    c = [
        F.coalesce(F.nullif(F.col("original_number"), F.lit("")), F.col("unique_id")),
        T.truncate(F.col("description"), config.description_chars),
        T.truncate(T.options_text(F.col("options")), config.options_chars),
        F.col("community_answer"),
        F.col("highly_voted_answer"),
        F.col("most_recent_answer"),
        F.col("llm_answer"),
        F.col("latest_date"),
        F.col("topic"),
        F.col("page_number").cast("string"),
        F.col("source"),
    ]
    return questions.select(*[x.alias(n) for x, n in zip(c, config.columns, strict=True)])


def markdown_rows(questions: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """value: a row of a Markdown table for each question."""
    table = tabular(questions, config)
    row = F.concat(F.lit("| "), F.array_join(F.array(*[T.escape_markdown(F.col(f"`{n}`")) for n in config.columns]), " | "), F.lit(" |"))
    return table.select(row.alias("value"))


def distinct_columns() -> list[Column]:
    """Aggregates: the sorted distinct sources and non-empty topics."""
    return [F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set(F.nullif(F.col("topic"), F.lit("")))).alias("topics")]


def distinct_lists(questions: DataFrame) -> DataFrame:
    """One row: the sorted distinct sources and non-empty topics."""
    return questions.agg(*distinct_columns())


def web_question(questions: DataFrame, *keep: str) -> DataFrame:
    """keep, and a column q: each question as the web document nests it."""
    return questions.select(
        *keep,
        F.struct(
            F.col("unique_id").alias("id"),
            F.col("original_number").alias("number"),
            F.col("description"),
            T.options_map(F.col("options")).alias("options"),
            F.struct(
                F.col("community_answer").alias("community"),
                F.col("highly_voted_answer").alias("highly_voted"),
                F.col("most_recent_answer").alias("most_recent"),
                F.col("llm_answer").alias("claude"),
            ).alias("answers"),
            F.col("llm_reasoning").alias("claude_reasoning"),
            F.struct(
                F.col("topic"),
                F.col("page_number").alias("page"),
                F.col("source"),
                F.col("latest_date").alias("date"),
                F.col("confidence_score").alias("confidence"),
            ).alias("metadata"),
        ).alias("q")
    )


def score_exam(questions: DataFrame, responses: DataFrame, pass_mark: float = 0.7) -> DataFrame:
    """user, answered, correct, skipped, score, passed of responses (user, unique_id, answer, and source) against the community answer.

    An id names a question within its source; responses without a source are taken only if one source alone has the id. An empty or null answer is skipped; a question without a community answer doesn't count; an unknown id doesn't either.
    """
    key = questions.filter("community_answer <> ''").groupBy("unique_id", "source").agg(F.min("community_answer").alias("community_answer"))
    if "source" in responses.columns:
        both = responses.join(key, ["unique_id", "source"])
    else:
        one = key.groupBy("unique_id").agg(F.min("community_answer").alias("community_answer"), F.count(F.lit(1)).alias("sources"))
        both = responses.join(one.filter("sources = 1"), "unique_id")
    given = F.coalesce("answer", F.lit("")) != ""
    return (
        both.groupBy("user")
        .agg(F.count_if(given).alias("answered"), F.count_if(F.col("answer") == F.col("community_answer")).alias("correct"), F.count_if(~given).alias("skipped"), F.count(F.lit(1)).alias("n"))
        .withColumn("score", F.col("correct") / F.col("n"))
        .withColumn("passed", F.col("score") >= pass_mark)
        .drop("n")
    )
