"""Model answers: prompts, a pluggable provider, response parsing and the merge into questions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..config import DEFAULT, EngineConfig
from ..functions import scores
from ..functions import text as T
from .parse import first_of

#: What asks a model: a prompt in, its text out (None: no answer); RateLimited or another exception on failure.
Provider = Callable[[str], str | None]


class RateLimited(Exception):
    """The provider wants to be asked later."""


def _fill(template: str, **parts: Column) -> Column:
    c = F.lit(template)
    for name, x in parts.items():
        c = F.replace(c, F.lit("{%s}" % name), x)
    return c


def option_lines(options: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(options), lambda o: F.concat(o["letter"], F.lit(". "), o["text"])), "\n")


def template_of(document: dict) -> str:
    """The prompt of a document of templates: system prompt, blank line, user template; the default one where it has none."""
    own = document.get("question_analysis") or {}
    if not own.get("user_template"):
        return R.PROMPT
    user = own["user_template"].replace("{question_text}", "{question}").replace("{options_text}", "{options}")
    return "\n\n".join(x for x in (own.get("system_prompt", ""), user) if x)


def prompts(questions: DataFrame, with_topic: bool = False, template: str | None = None) -> DataFrame:
    """question_id, source, prompt for each question that has a description and options; template has {question} and {options}, and may have {topic}."""
    ready = questions.filter((F.col("description") != "") & (F.size("options") > 0))
    if template is not None:
        prompt = _fill(template, topic=F.col("topic"), options=option_lines(F.col("options")), question=F.col("description"))
    elif with_topic:
        prompt = _fill(R.CONTEXT_PROMPT, topic=F.col("topic"), options=option_lines(F.col("options")), question=F.col("description"))
    else:
        prompt = _fill(R.PROMPT, options=option_lines(F.col("options")), question=F.col("description"))
    return ready.select(F.col("unique_id").alias("question_id"), "source", prompt.alias("prompt"))


def ask(provider: Provider, prompt: str, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """Text and error of one request: a limited rate waits 5 * 2**k seconds and gives up silently, other errors 2**k."""
    error: str | None = "request failed"
    for k in range(attempts):
        try:
            text = provider(prompt)
            return (text, None) if text else ("", "request failed")
        except RateLimited:
            error = "rate limited"
            if k + 1 < attempts:
                wait(5 * 2**k)
        except Exception as e:
            error = str(e) or type(e).__name__
            if k + 1 < attempts:
                wait(2**k)
    return "", error


def query_model(asked: DataFrame, provider: Provider, config: EngineConfig = DEFAULT, wait: Callable[[float], None] = time.sleep, workers: int = 1) -> DataFrame:
    """question_id, source, response_text, error of prompts(); workers partitions share the rate limit evenly. Never raises for a failed request."""
    gap = 60.0 * workers / config.requests_per_minute

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p in frame["prompt"]:
                rows.append(ask(provider, p, config.model_attempts, wait))
                wait(gap)
            yield pd.DataFrame({"question_id": frame["question_id"], "source": frame["source"], "response_text": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return asked.repartition(workers).mapInPandas(run, "question_id string, source string, response_text string, error string")


def parse_responses(responses: DataFrame) -> DataFrame:
    """responses (response_text, error, and any keys) with correct_answer, reasoning, confidence and analysis.

    An answer is the first capital letter A to F that stands alone and fits one
    of four patterns in turn; reasoning is the first two hits of the first of
    three patterns that hits, else the first paragraph of over 30 characters,
    500 at most. A failed response has empty fields and confidence 0.
    """
    t = F.coalesce(F.col("response_text"), F.lit(""))
    answer = first_of(*[F.regexp_extract(t, p, 1) for p in R.ANSWER_PATTERNS])
    hits = [F.array_join(F.slice(F.regexp_extract_all(t, F.lit(p), 1), F.lit(1), F.lit(2)), " ") for p in R.REASONING_PATTERNS]
    paragraph = F.coalesce(F.get(F.filter(F.transform(F.split(t, "\n\n"), T.strip), lambda x: F.length(x) > 30), F.lit(0)), F.lit(""))
    ok = F.col("error").isNull() & (t != "")
    out = responses.withColumn("correct_answer", F.when(ok, answer).otherwise(F.lit("")))
    out = out.withColumn("raw_reasoning", F.when(ok, first_of(*hits, paragraph)).otherwise(F.lit("")))
    out = out.withColumn("confidence", F.when(ok, scores.response_confidence(t, F.col("correct_answer"), F.col("raw_reasoning"))).otherwise(F.lit(0.0)))
    out = out.withColumn("reasoning", F.left(T.strip(T.squeeze(F.col("raw_reasoning"))), F.lit(500)))
    return out.withColumn("analysis", F.left(t, F.lit(1000))).drop("raw_reasoning")


def apply_responses(questions: DataFrame, parsed: DataFrame) -> DataFrame:
    """questions with llm_answer, llm_reasoning and has_llm_answer of successful responses (question_id, and source if there)."""
    keys = ["question_id"] + (["source"] if "source" in parsed.columns else [])
    one = parsed.filter("error IS NULL AND correct_answer <> ''").groupBy(*keys).agg(F.min(F.struct("correct_answer", "reasoning")).alias("r"))
    one = one.withColumnRenamed("question_id", "unique_id")
    rest = [c for c in questions.columns if c not in ("llm_answer", "llm_reasoning", "has_llm_answer")]
    joined = questions.select(*rest).join(one, ["unique_id"] + keys[1:], "left")
    return joined.select(
        *rest,
        F.coalesce("r.correct_answer", F.lit("")).alias("llm_answer"),
        F.coalesce("r.reasoning", F.lit("")).alias("llm_reasoning"),
        F.col("r").isNotNull().alias("has_llm_answer"),
    ).select(*questions.columns)


def run_counters(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """One row: questions, eligible, processed, failed."""
    none = F.lit(0).cast("long")
    ready = (F.col("description") != "") & (F.size("options") > 0)
    q = questions.agg(F.count(F.lit(1)).alias("questions"), F.count_if(ready).alias("eligible"), none.alias("processed"), none.alias("failed"))
    done = F.col("error").isNull()
    r = responses.agg(none.alias("questions"), none.alias("eligible"), F.count_if(done).alias("processed"), F.count_if(~done).alias("failed"))
    return q.unionByName(r).agg(*[F.sum(c).alias(c) for c in q.columns])
