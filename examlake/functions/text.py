"""Text rewriting as Column expressions: ordered folds over rule tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as R

#: A character that occurs in no text here; it marks where a sentence begins.
_MARK = "\x01"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def fold(c: Column, table: Iterable[tuple[str, str]], flags: str = "") -> Column:
    """Apply (pattern, replacement) rules one after the other."""
    for pattern, new in table:
        c = F.regexp_replace(c, flags + pattern, new)
    return c


def guarded_fold(c: Column, table: Iterable[tuple[str, str]], flags: str = "(?i)") -> Column:
    """fold(), but a text that no rule can touch costs one search only. Every rule's pattern must be able to match in the original text."""
    table = tuple(table)
    any_of = flags + "|".join(f"(?:{p})" for p, _ in table)
    return let(c, lambda x: F.when(x.rlike(any_of), fold(x, table, flags)).otherwise(x))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def clean_page(c: Column) -> Column:
    """Page artifacts: site addresses, digit-only lines, page numbers, spare blank lines and spaces, hyphens at line ends, one-letter lines."""
    return strip(fold(F.coalesce(c, F.lit("")), R.PAGE_CLEAN))


def drop_icons(c: Column, keep_lines: bool = False) -> Column:
    """Without private-use glyphs and block characters; white space is squeezed unless lines are to be kept."""
    c = F.regexp_replace(F.translate(c, R.ICONS, ""), r"[\x{F000}-\x{F8FF}]", "")
    return strip(F.regexp_replace(c, r"[^\S\n]+", " ") if keep_lines else squeeze(c))


def clean_nested(df: DataFrame) -> DataFrame:
    """drop_icons() for every string value in any column, however deep; keys and names stay."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return drop_icons(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[clean(df[f.name], f.dataType).alias(f.name) for f in df.schema.fields])


def join_page_breaks(c: Column) -> Column:
    return fold(c, R.PAGE_BREAKS)


def fix_ocr(c: Column, rule_set: str = "safe") -> Column:
    """OCR confusions. "reference" also turns digits at word ends into letters and spaces out every full stop; "safe" leaves numbers and names alone."""
    if rule_set == "reference":
        return fold(c, (*R.OCR_DIGITS, *R.OCR_WORDS, *R.OCR_SPACES), "(?iU)")
    return fold(guarded_fold(c, R.OCR_WORDS), R.OCR_SPACES_SAFE, "(?iU)")


def standardize(c: Column) -> Column:
    """Single spaces, bullets at the start, and one form of ``Question #N``, ``Topic N`` and a leading option letter."""
    c = F.regexp_replace(squeeze(c), r"^[*+\-]\s*", "• ")
    c = F.regexp_replace(c, r"(?i)question\s*#?\s*(\d+)", "Question #$1")
    c = F.regexp_replace(c, r"(?i)topic\s*(\d+)", "Topic $1")

    def letter(x: Column) -> Column:
        lead = F.regexp_extract(x, r"^([A-Fa-f])[.)]\s*", 0)
        return F.when(lead != "", F.concat(F.upper(F.left(x, F.lit(1))), F.lit(". "), F.substring(x, F.length(lead) + 1, F.length(x)))).otherwise(x)

    return let(c, letter)


def capitalize(c: Column) -> Column:
    """The first character in upper case; the rest stays."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, F.lit(2), F.length(c)))


def fix_grammar(c: Column) -> Column:
    """Articles before vowels and consonants, spaces of ``, and`` and ``;``, and a capital after a full stop."""
    c = fold(c, R.GRAMMAR, "(?U)")
    parts = F.split(F.regexp_replace(c, r"(\.\s+)(?=[a-z])", "$1" + _MARK), _MARK)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i > 0, capitalize(x)).otherwise(x)), "")


def case_terms(c: Column, rule_set: str = "safe") -> Column:
    """Technical terms in their own spelling. "safe" changes whole words only."""
    edge = r"\b" if rule_set == "safe" else ""
    table = tuple((edge + t.replace("/", "/") + edge, t) for t in R.TERMS)
    return guarded_fold(c, table)


def final_clean(c: Column) -> Column:
    """Runs of punctuation, spaces around it, and a full stop after more than 20 characters without an end mark."""
    return let(strip(fold(c, R.FINAL_CLEAN)), lambda x: F.when((F.length(x) > 20) & ~x.rlike(r"[.!?]$"), F.concat(x, F.lit("."))).otherwise(x))


STEPS = ("page_breaks", "ocr", "format", "grammar", "terms", "cleanup")


def enhance(c: Column, steps: Iterable[str] = STEPS, rule_set: str = "safe") -> Column:
    """All rewriting steps in their fixed order, each of which can be left out; an empty or null text is ""."""
    steps = set(steps)
    c = F.coalesce(c, F.lit(""))
    for name, step in (
        ("page_breaks", join_page_breaks),
        ("ocr", lambda x: fix_ocr(x, rule_set)),
        ("format", standardize),
        ("grammar", fix_grammar),
        ("terms", lambda x: case_terms(x, rule_set)),
        ("cleanup", final_clean),
    ):
        if name in steps:
            c = let(c, step)
    return c


def enhance_question(c: Column, steps: Iterable[str] = STEPS, rule_set: str = "safe") -> Column:
    """Without a leading ``Question #N``, with a question mark if nothing ends it, then enhance()."""
    c = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^Question\s*#?\d+\.?\s*", ""))
    ended = let(c, lambda x: F.when((x != "") & ~x.rlike(r"[?!.]$"), F.concat(x, F.lit("?"))).otherwise(x))
    return let(ended, lambda x: F.when(x == "", F.lit("")).otherwise(enhance(x, steps, rule_set)))


def enhance_option(c: Column, steps: Iterable[str] = STEPS, rule_set: str = "safe") -> Column:
    """Without its letter, with a capital first, then enhance()."""
    c = strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^[A-F][.)]\s*", ""))
    return let(c, lambda x: F.when(x == "", F.lit("")).otherwise(enhance(capitalize(x), steps, rule_set)))


def repair_encoding(c: Column, rule_set: str = "safe") -> Column:
    """UTF-8 read as a one-byte code page, put right for the usual characters."""
    c = F.coalesce(c, F.lit(""))
    for bad, good in R.MOJIBAKE_SAFE if rule_set == "safe" else R.MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def enhancement_check(before: Column, after: Column, rule_set: str = "safe") -> Column:
    """struct(valid, length_change, word_count_change, numbers_changed, terms_lost) of a rewritten text.

    Terms are lost if there were any, however spelled, and none is left. "safe" also counts the loss of one term
    in its own spelling: what looks like another one within a word (IAM in a key) doesn't make up for it.
    """
    numbers = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)))
    had, has, gone = F.lit(False), F.lit(False), F.lit(False)
    for t in R.TERMS:
        had = had | F.contains(F.lower(before), F.lit(t.lower()))
        has = has | F.contains(after, F.lit(t))
        gone = gone | (F.contains(before, F.lit(t)) & ~F.contains(after, F.lit(t)))
    lost = had & ~has if rule_set == "reference" else (had & ~has) | gone
    change = F.length(after) - F.length(before)
    return F.struct(
        (F.abs(change) <= F.length(before) * F.lit(0.3)).alias("valid"),
        change.alias("length_change"),
        (F.size(words(after)) - F.size(words(before))).alias("word_count_change"),
        (numbers(before) != numbers(after)).alias("numbers_changed"),
        lost.alias("terms_lost"),
    )


def comparable(c: Column) -> Column:
    """A text as the validator compares it: squeezed, without site header and page numbers, with OCR errors put right."""
    c = squeeze(strip(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(c, r"(?i)ExamTopics.*?Professional", "")
    c = F.regexp_replace(c, r"Page\s+\d+", "")
    return strip(guarded_fold(c, R.OCR_COMPARE))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[|*_`#]", r"\\$0")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def options_text(options: Column) -> Column:
    """``A: x; B: y`` of an options array, in the order of first appearance."""
    ordered = F.array_sort(options)
    return F.array_join(F.transform(ordered, lambda o: F.concat(o["letter"], F.lit(": "), o["text"])), "; ")


def options_map(options: Column) -> Column:
    return F.map_from_entries(F.transform(options, lambda o: F.struct(o["letter"], o["text"])))
