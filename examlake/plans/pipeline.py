"""The extraction pipeline: pages to questions, comments, answers, duplicates and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..operators.answers import apply_responses, parse_responses
from ..operators.dedup import duplicate_pairs
from ..operators.parse import parse_comments, parse_questions
from ..operators.segment import question_blocks
from ..sources.writers import write_all


@dataclass
class Extraction:
    questions: DataFrame
    comments: DataFrame

    @cached_property
    def duplicates(self) -> DataFrame:
        """Pairs of near-duplicate questions; they are looked for when this is first read."""
        keyed = self.questions.withColumn("key", F.concat_ws("|", "source", "unique_id", F.col("start_line").cast("string")))
        return duplicate_pairs(keyed, "key")


def enhance_questions(questions: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Descriptions and option texts rewritten by the configured steps."""
    option = lambda o: o.withField("text", T.enhance_option(o["text"], config.enhance, config.rule_set))
    return questions.withColumn("description", T.enhance_question(F.col("description"), config.enhance, config.rule_set)).withColumn(
        "options", F.transform("options", option)
    )


def extract(pages: DataFrame, responses: DataFrame | None = None, config: EngineConfig = DEFAULT) -> Extraction:
    """Questions, comments and duplicate pairs of cleaned pages; responses (question_id, response_text, error) add model answers."""
    blocks = question_blocks(pages, config)
    questions = parse_questions(blocks, config)
    if config.max_questions:
        questions = questions.orderBy("source", "page_number", "start_line").limit(config.max_questions)
    if config.enhance:
        questions = enhance_questions(questions, config)
    if responses is not None and config.use_model:
        questions = apply_responses(questions, parse_responses(responses))
    return Extraction(questions, parse_comments(blocks, config))


def run(pages: DataFrame, folder: str, formats: tuple[str, ...] = ("csv", "md", "json", "web"), responses: DataFrame | None = None, config: EngineConfig = DEFAULT) -> dict[str, str]:
    """extract() and write the formats; {} if there is no question."""
    found = extract(pages, responses, config)
    questions = found.questions.persist()
    try:
        return write_all(questions, folder, formats, found.comments)
    finally:
        questions.unpersist()
