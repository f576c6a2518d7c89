"""Scores as sums of doubles, added in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R


def _step(value: Column, *steps: tuple[float, float]) -> Column:
    """The score of the first bound that value reaches; 0 below all."""
    out = F.when(value >= steps[0][0], F.lit(float(steps[0][1])))
    for bound, score in steps[1:]:
        out = out.when(value >= bound, F.lit(float(score)))
    return out.otherwise(F.lit(0.0))


def is_answer(c: Column) -> Column:
    """Whether a non-empty string is a part of ABCDEF."""
    return (c != "") & F.contains(F.lit(R.LETTERS), c)


def question_confidence(description: Column, options: Column, answers: list[Column], number: Column, topic: Column) -> Column:
    """Completeness of a question: description .4, options .3, answers .2, number and topic .1; 1 at most."""
    valid = sum((F.when(is_answer(a), 1).otherwise(0) for a in answers), F.lit(0))
    named = F.when(number != "", 1).otherwise(0) + F.when(topic != "", 1).otherwise(0)
    total = (
        _step(F.length(description), (50, 0.4), (20, 0.2))
        + _step(options, (4, 0.3), (2, 0.15))
        + _step(valid, (2, 0.2), (1, 0.1))
        + _step(named, (2, 0.1), (1, 0.05))
    )
    return F.least(total, F.lit(1.0))


def response_confidence(text: Column, answer: Column, reasoning: Column) -> Column:
    """Quality of a model's response: a valid answer .4, reasoning .35, length .15, a domain term .1; 1 at most."""
    low = F.lower(text)
    term = F.lit(False)
    for t in R.MODEL_TERMS:
        term = term | F.contains(low, F.lit(t))
    total = (
        F.when(is_answer(answer), F.lit(0.4)).otherwise(F.lit(0.0))
        + _step(F.length(reasoning), (100, 0.35), (50, 0.2))
        + _step(F.length(text), (200, 0.15), (100, 0.1))
        + F.when(term, F.lit(0.1)).otherwise(F.lit(0.0))
    )
    return F.least(total, F.lit(1.0))


def bucket(confidence: Column) -> Column:
    """high from 0.8, medium from 0.5, else low; a missing score counts as 0."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= F.lit(0.8), "high").when(c >= F.lit(0.5), "medium").otherwise("low")
