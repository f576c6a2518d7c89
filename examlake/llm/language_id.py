"""Language identification by Bayesian evidence fusion.

A naive Bayes model over byte trigrams gives each text's likelihood under every
language. It is fused with the declared markup language, the address suffix and
a prior of the host. Declared languages and suffixes count by how often they go
with each language in the corpus; a host's prior is smoothed towards its parent
domain's, and that one towards the whole corpus's. All these counts come from
grouped aggregation over every row, with the text model's own decision as label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, lower_ascii, materialize, small_batches
from .tokens import slices_by_bytes
from .url_filter import url_parts

SLOTS = 1 << 16
#: Trigrams that are looked up at once under 64 languages (fewer under more), and the figures that makes.
CHUNK = 1 << 20
LOOKED_UP = CHUNK * 65
#: Rows of each language that the text model is fitted to.
FIT_ROWS = 400
#: Parts that a language's rows are ranked in first.
PARTS = 16
#: Rows of the sample, up to which its hashes are broadcast.
BROADCAST_ROWS = 1_000_000
#: Longer texts are taken into that sample, shortest first, only where a language has too few others.
FIT_CHARS = 20_000
#: A text's trigrams lean on each other; beyond this many, evidence grows no more.
MOST_EVIDENCE = 64.0
#: Pseudo-counts: of a host's parent in its prior, of a label without evidence.
SMOOTH = 5.0


#: Byte table: digits, ASCII punctuation and white space to spaces; they tell no language.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))


def trigram_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's hashed byte trigrams, lower-cased and between spaces; where each text's begin; its letters' bytes."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    none, one, two = (pa.scalar(" " * k, pa.large_string()) for k in range(3))
    low = pc.binary_join_element_wise(two, low, one, none)  # so that no text's trigrams depend on the next text
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    offsets, body = offsets - offsets[0], low.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]].translate(_LETTERS) if len(low) else b""
    raw = np.frombuffer(body + b"  ", np.uint8).astype(np.uint32)
    letters = np.concatenate([[0], np.cumsum(raw != 32)])[offsets]
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code *= np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.int64), offsets, np.diff(letters)


@dataclass
class TextModel:
    languages: list[str]
    log_prob: np.ndarray  # [SLOTS, languages + 1]; the last column is the uniform model of no language

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], alpha: float = 0.1) -> "TextModel":
        texts: dict[str, list[str]] = {}
        for t, lang in rows:
            texts.setdefault(lang, []).append(t)
        return cls.of_counts({lang: np.bincount(trigram_slots(pa.array(x, pa.string()))[0], minlength=SLOTS) for lang, x in texts.items()}, alpha)

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray], alpha: float = 0.1) -> "TextModel":
        """The model of each language's counts of trigrams by slot."""
        languages = sorted(counts)
        table = np.full((SLOTS, len(languages) + 1), -np.log(SLOTS), np.float32)
        for i, lang in enumerate(languages):
            n = counts[lang] + alpha
            table[:, i] = np.log(n / n.sum())
        return cls(languages, table)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood of a trigram under each language and none [texts, languages + 1], and each text's bytes of letters."""
        slots, begin, letters = trigram_slots(texts)
        if not len(letters):
            return np.zeros((0, len(self.languages) + 1)), letters
        sums = np.zeros((len(letters), self.log_prob.shape[1]))
        chunk = max(1, min(CHUNK, LOOKED_UP // self.log_prob.shape[1]))
        for at in range(0, int(begin[-1]), chunk):
            end = min(at + chunk, int(begin[-1]))
            first, last = np.searchsorted(begin, [at, end - 1], side="right") - 1
            cuts = np.maximum(begin[first : last + 1] - at, 0)
            sums[first : last + 1] += np.add.reduceat(self.log_prob[slots[at:end]], cuts, axis=0, dtype=np.float64)
        return sums / np.diff(begin)[:, None], letters


def fit_text_model(labelled: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text", label: str = "lang") -> TextModel:
    """Fit to at most fit_rows labelled rows of each language: those of up to FIT_CHARS characters with the smallest hashes, then the shortest longer ones.

    Copies of a text count once. Every label with a text is fitted. This sample is the only bounded one;
    everything else covers all rows.
    """
    t, long = F.col(text), F.when(F.length(text) > FIT_CHARS, F.length(text)).otherwise(0)
    rows = labelled.filter(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("lang"), F.xxhash64(t).alias("h"), long.alias("long"), t.alias("t"))
    # the first rows of each of a language's parts, then of the language: one task gets PARTS * fit_rows rows at most
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("long", "h"))).filter(F.col("rank") <= fit_rows).drop("rank")
    parted = rows.select("lang", "long", "h").distinct().withColumn("part", F.pmod("h", F.lit(PARTS)))
    taken = first(first(parted, "lang", "part"), "lang").select("lang", "h")
    taken = materialize(taken, "language-sample")
    few = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken  # so that texts stay where they are
    sample = rows.join(few, ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t")).select("lang", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, n = None, np.zeros(SLOTS, np.int64)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n.tobytes()], pa.binary())], ["lang", "n"])

        for batch in batches:
            for at, size in slices_by_bytes(batch.column(1), 2_000_000):
                part = batch.slice(at, size)
                names = part.column(0).to_pylist()
                cuts = [0] + [i for i in range(1, size) if names[i] != names[i - 1]] + [size]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if names[x] != lang:
                        if lang is not None:
                            yield counted()
                        lang, n = names[x], np.zeros(SLOTS, np.int64)
                    n += np.bincount(trigram_slots(part.column(1).slice(x, y - x))[0], minlength=SLOTS)
        if lang is not None:
            yield counted()

    counts = sample.repartition("lang").sortWithinPartitions("lang").mapInArrow(run, "lang string, n binary").collect()  # a row for each language
    return TextModel.of_counts({r["lang"]: np.frombuffer(r["n"], np.int64) for r in counts})


def page_evidence(pages: DataFrame) -> DataFrame:
    """id, text, declared, host, suffix of each web page: its visible text, <html lang>, host and the host's last label."""
    host, _ = url_parts(F.col("url"))
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = lower_ascii(F.regexp_extract(html, "(?i)<html\\b[^>]*\\blang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    return pages.select(
        F.col("page_id").alias("id"),
        text.alias("text"),
        F.when(declared != "", declared).alias("declared"),
        F.when(host != "", host).alias("host"),
        F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"),
    )


def document_evidence(docs: DataFrame, *keep: Column) -> DataFrame:
    """The same columns of a document, and keep: its source is the host, and there is no address.

    The text model is fitted to the label lang, so that is no evidence here: it
    would count twice.
    """
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("id"), "text", none.alias("declared"), F.col("source").alias("host"), none.alias("suffix"), *keep)


def _counts(n: int) -> list[Column]:
    return [F.sum(F.when(F.col("guess") == i, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(n)]


def identify(rows: DataFrame, model: TextModel, least: float = 0.5, most_evidence: float = MOST_EVIDENCE) -> DataFrame:
    """id, language, probability, accepted, declared, text_language and the key column (if any) for every row.

    rows has id, text, declared, host, suffix (see page_evidence). A row is
    accepted if its text is likelier under its language than under a uniform
    model and its posterior is ``least`` or more. The text's mean log-likelihood
    of a trigram counts as often as it has bytes of letters, most_evidence times
    at most: the whole text is read, but its trigrams lean on each other, and a
    long text would else outweigh all other evidence. A text without a letter (or a
    null) has no likelihood: its language comes from the other evidence, and it
    isn't accepted. Missing evidence (null) counts as none. Repeated rows repeat; an
    empty table gives an empty result. Other columns of rows pass through if
    their names start with ``keep_``.
    """
    langs = model.languages
    n = len(langs)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages
    keep = [c for c in rows.columns if c.startswith("keep_")]

    @F.arrow_udf("struct<mean:array<double>,letters:long>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        width = m.log_prob.shape[1]
        for texts in batches:
            done = [(np.zeros((0, width)), np.zeros(0, np.int64))] + [m.scores(texts.slice(at, size)) for at, size in slices_by_bytes(texts, 2_000_000)]
            mean, letters = (np.concatenate(x) for x in zip(*done, strict=True))
            lists = pa.ListArray.from_arrays(np.arange(len(mean) + 1, dtype=np.int32) * width, mean.ravel())
            yield pa.StructArray.from_arrays([lists, pa.array(letters, pa.int64())], ["mean", "letters"])
            give_back()

    # only the text goes to Python; the other columns stay where they are
    scored = rows.select("id", "declared", "host", "suffix", *keep, score("text").alias("score"))
    scored = scored.select("id", "declared", "host", "suffix", *keep, "score.mean", "score.letters")
    own = F.slice("mean", 1, n)
    scored = scored.withColumn("guess", F.when(F.col("letters") > 0, F.array_position(own, F.array_max(own)).cast("int") - 1))
    with small_batches(rows.sparkSession):
        scored = materialize(scored, "language-scores")
    cells = materialize(scored.filter("guess IS NOT NULL").groupBy("declared", "host", "suffix", "guess").agg(F.count(F.lit(1)).alias("n")), "language-cells")
    whole = cells.agg(*_counts(n), F.count(F.lit(1))).first()
    seen = [whole[i] or 0.0 for i in range(n)]
    base = [(x + 1.0) / (sum(seen) + n) for x in seen]
    parent = F.substring_index("host", ".", -2)

    def goes_with(column: str) -> DataFrame:
        """log P(value | language) of each value; smoothed as if every language had seen each value SMOOTH times its overall share."""
        kinds = cells.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"{column}_of")).agg(*_counts(n), F.sum("n").alias("n"))
        share = (F.col("n") + 1.0) / F.lit(sum(seen) + 1.0)
        return kinds.select(
            f"{column}_of", F.array(*[F.log((F.col(f"n{i}") + SMOOTH * share) / F.lit(seen[i] + SMOOTH)) for i in range(n)]).alias(f"{column}_log")
        )

    hosts = cells.filter("host IS NOT NULL").withColumn("parent", parent)
    parents = hosts.groupBy("parent").agg(*_counts(n), F.sum("n").alias("n"))
    parents = parents.select("parent", F.array(*[(F.col(f"n{i}") + SMOOTH * base[i]) / (F.col("n") + SMOOTH) for i in range(n)]).alias("up"))
    priors = hosts.groupBy(F.col("host").alias("host_of"), "parent").agg(*_counts(n), F.sum("n").alias("n")).join(parents, "parent")
    priors = priors.select("host_of", F.array(*[F.log((F.col(f"n{i}") + SMOOTH * F.col("up")[i]) / (F.col("n") + SMOOTH)) for i in range(n)]).alias("host_log"))

    out = scored
    for column, table in (("declared", goes_with("declared")), ("suffix", goes_with("suffix")), ("host", priors)):
        table = materialize(table, f"language-{column}", whole[n])
        out = out.join(table, out[column] == table[f"{column}_of"], "left").drop(f"{column}_of")
    none, prior = F.array(*[F.lit(0.0)] * n), F.array(*[F.lit(float(np.log(b))) for b in base])
    weight = F.when(F.col("letters") > 0, F.least(F.col("letters").cast("double"), F.lit(float(most_evidence)))).otherwise(F.lit(0.0))
    parts = [(F.col("mean"), weight), (F.coalesce("declared_log", none), F.lit(1.0)), (F.coalesce("suffix_log", none), F.lit(1.0)), (F.coalesce("host_log", prior), F.lit(1.0))]
    total = F.array(*[sum((a[i] * w for a, w in parts), F.lit(0.0)) for i in range(n)])
    out = out.withColumn("total", total).withColumn("best", F.array_max("total")).withColumn("at", F.array_position("total", F.col("best")).cast("int"))
    odds = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    names = F.array(*[F.lit(x) for x in langs])
    return out.withColumn("probability", F.lit(1.0) / odds).select(
        "id",
        F.element_at(names, F.col("at")).alias("language"),
        "probability",
        ((F.col("letters") > 0) & (F.element_at("mean", F.col("at")) > F.lit(float(-np.log(SLOTS)))) & (F.col("probability") >= least)).alias("accepted"),
        "declared",
        F.when(F.col("guess").isNotNull(), F.element_at(names, F.col("guess") + 1)).alias("text_language"),
        *keep,
    )


def accepted_documents(docs: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """The rows of docs that identify() accepts, whole, with lang set to the language found."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("keep_doc")
    found = identify(document_evidence(docs, whole), model, least).filter("accepted")
    return found.select(*[(F.col("language") if c == "lang" else F.col("keep_doc")[c]).alias(c) for c in docs.columns])
