"""Faceted search over a question store, and updates of it by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores
from ..functions.text import escape_html

ANSWERS = ("community_answer", "highly_voted_answer", "most_recent_answer", "llm_answer")


@dataclass(frozen=True)
class Filters:
    """An empty string is no filter."""

    search: str = ""
    topic: str = ""
    source: str = ""
    answer: str = ""
    confidence: str = ""


def search_text(questions: DataFrame) -> Column:
    """What full-text search looks in: description, option texts, topic and reasoning, in lower case."""
    texts = F.array_join(F.transform("options", lambda o: o["text"]), " ")
    return F.lower(F.concat_ws(" ", "description", texts, "topic", "llm_reasoning"))


def filter_questions(questions: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Rows that fit all filters: a literal substring, topic, source, any of four answers, and the confidence bucket."""
    out = questions
    if filters.search:
        out = out.filter(F.contains(search_text(out), F.lit(filters.search.lower())))
    if filters.topic:
        out = out.filter(F.col("topic") == filters.topic)
    if filters.source:
        out = out.filter(F.col("source") == filters.source)
    if filters.answer:
        out = out.filter(F.array_contains(F.array(*[F.coalesce(a, F.lit("")) for a in ANSWERS]), filters.answer))
    if filters.confidence:
        out = out.filter(scores.bucket(F.col("confidence_score")) == filters.confidence)
    return out


def facet_values(questions: DataFrame) -> DataFrame:
    """facet, value in order: the distinct non-empty topics and sources, and the answer letters."""
    topics = questions.select(F.lit("topic").alias("facet"), F.col("topic").alias("value"))
    sources = questions.select(F.lit("source").alias("facet"), F.col("source").alias("value"))
    letters = questions.sparkSession.range(6).select(F.lit("answer").alias("facet"), F.char(F.col("id") + 65).alias("value"))
    return topics.unionByName(sources).filter("value <> ''").distinct().unionByName(letters).orderBy("facet", "value")


def cards(questions: DataFrame) -> DataFrame:
    """What a result card shows: title, topic, answer and confidence label with their fallbacks, the text escaped for HTML."""
    part = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    return questions.select(
        F.concat(F.lit("Question "), part("original_number", F.col("unique_id"))).alias("title"),
        part("topic", F.lit("General")).alias("topic"),
        part("community_answer", F.lit("N/A")).alias("answer"),
        F.initcap(scores.bucket(F.col("confidence_score"))).alias("confidence"),
        escape_html(F.col("description")).alias("description"),
    )


def export_filtered(questions: DataFrame, filters: Filters, exported_at: str) -> DataFrame:
    """One row: exported_at, filters_applied, total_questions, questions (JSON lines sorted by id)."""
    rows = filter_questions(questions, filters).select(F.struct("unique_id", F.to_json(F.struct(*[questions[c] for c in questions.columns])).alias("json")).alias("q"))
    applied = F.to_json(F.struct(*[F.lit(getattr(filters, n)).alias(n) for n in ("search", "topic", "source", "answer", "confidence")]))
    return rows.agg(
        F.lit(exported_at).alias("exported_at"),
        applied.alias("filters_applied"),
        F.count(F.lit(1)).alias("total_questions"),
        F.transform(F.array_sort(F.collect_list("q")), lambda q: q["json"]).alias("questions"),
    )


def merge_updates(store: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, errors): the store with updates (schemas.UPDATES) merged by id, and id, status of updates that failed.

    number, description and options are replaced where the update has them;
    metadata keys are merged over the old ones. Of several updates of one id the
    last in the table counts, and of several rows of an id the first is updated.
    Both tables' order is that of their scan. An update without an id is status
    400, one of an unknown id 404. store has id, number, description, options
    (map) and metadata (map).
    """
    good = updates.filter(F.coalesce("id", F.lit("")) != "")
    at = good.withColumn("at", F.monotonically_increasing_id())
    one = at.groupBy("id").agg(F.max_by(F.struct("number", "description", "options", "metadata"), "at").alias("u"))
    ranked = store.withColumn("at", F.monotonically_increasing_id()).withColumn("row", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    joined = ranked.join(one, "id", "left").withColumn("u", F.when(F.col("row") == 1, F.col("u")))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(
        F.map_filter(F.coalesce("metadata", empty), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("u.metadata"), k), F.lit(False))), F.coalesce("u.metadata", empty)
    )
    out = joined.select(
        "id",
        F.coalesce("u.number", "number").alias("number"),
        F.coalesce("u.description", "description").alias("description"),
        F.coalesce("u.options", "options").alias("options"),
        merged.alias("metadata"),
    )
    missing = updates.filter(F.coalesce("id", F.lit("")) == "").select("id", F.lit(400).alias("status"))
    unknown = good.join(store.select("id").distinct(), "id", "left_anti").select("id", F.lit(404).alias("status"))
    return out, missing.unionByName(unknown)
