"""Line dedup with a suffix array over line-ID sequences.

Lines get identifiers, each document becomes a sequence of them, and the
suffixes of all sequences are ranked by distributed prefix doubling: the rank
by 2h lines is the rank of the pair (rank by h lines here, rank by h lines h
lines further on). Suffixes that share a rank at depth h are an interval of the
suffix array whose common prefix has at least h lines. A run of any length l is
one interval too: that of the pair of ranks of its first and its last h lines,
h being the largest power of two up to l. Where such an interval has an earlier
member, the run is a later copy and is deleted.

A repeated run counts if it has at least ``min_words`` words. Only the
shortest such runs need a test: those from each line forward and those from
each line backward. Together they cover all lines of every longer repeated run
and no other line, so merging those that are later copies gives the maximal
runs to delete. It also bounds the depth of doubling by ``min_words``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType
from pyspark.sql.window import Window

from .common import discard, materialize

MIN_WORDS = 50
NULL_ID = -(2**63)


def _did(doc_id: Column, kind: DataType) -> Column:
    """A document's id as a key without nulls, in the order of ids with null first; ids that aren't integers are ordered as strings."""
    if isinstance(kind, IntegralType):
        return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    """The row's key: its id and a hash of its text; rows that agree in both are one document."""
    return docs.withColumn("did", _did(F.col("doc_id"), docs.schema["doc_id"].dataType)).withColumn("th", F.xxhash64("text"))


def _ranked(rows: DataFrame, by: list[str], label: str, most: int | None = None) -> DataFrame:
    """Each distinct combination's rank: integers in sort order, with gaps between partitions."""
    return materialize(rows.select(*by).distinct().orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), label, most)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """did, th, first, last: the maximal line ranges (from 0, inclusive) of each document that are later copies.

    Only lines that occur twice at least enter the suffix array; what lies
    between two others ends a run.
    """
    w = int(min_words)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(" \t\r\x0b\x0c")).alias("t")))
    rows = (
        _keyed(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
        .select("did", "th", F.posexplode(F.filter(lines, lambda x: x["t"] != "")).alias("pos", "x"))
        .select(
            "did",
            "th",
            "pos",
            F.col("x.line").alias("line"),
            F.xxhash64("x.t").alias("h1"),
            F.xxhash64(F.lit(1), F.col("x.t")).alias("h2"),
            F.least(F.regexp_count("x.t", F.lit("[^ \\t\\r\\x0b\\x0c]+")), F.lit(w)).alias("words"),
        )
    )
    rows = materialize(rows, "lines")
    twice = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranks = _ranked(twice, ["h1", "h2"], "line-ids")
    doc = Window.partitionBy("did", "th").orderBy("pos")
    known = rows.join(ranks, ["h1", "h2"]).groupBy("did", "th", "pos").agg(F.first("line").alias("line"), F.first("words").alias("words"), F.first("rank").alias("rank"))
    known = known.withColumn("isle", F.col("pos") - F.row_number().over(doc))
    isle = Window.partitionBy("did", "th", "isle")
    by_pos = isle.orderBy("pos")
    known = known.withColumn("after", F.sum("words").over(by_pos)).withColumn("before", F.col("after") - F.col("words"))
    known = known.withColumn("total", F.sum("words").over(isle)).filter(F.col("total") >= w)
    near = isle.orderBy("before").rangeBetween(w, 2 * w)
    far = isle.orderBy("after").rangeBetween(-2 * w, -w)
    known = (
        known.withColumn("isle_first", F.min("pos").over(isle))
        .withColumn("isle_end", F.max("pos").over(isle) + 1)
        .withColumn("end", F.coalesce(F.min("pos").over(near), F.when(F.col("total") - F.col("before") >= w, F.col("isle_end"))))
        .withColumn("start", F.coalesce(F.max("pos").over(far) + 1, F.when(F.col("after") >= w, F.col("isle_first"))))
    )
    suffixes = materialize(
        known.select("did", "th", "isle", "pos", "line", "start", "end", F.array("rank").alias("ranks")), "suffixes-1"
    )
    discard(rows, ranks)

    longest, n = suffixes.agg(F.max(F.greatest(F.col("end") - F.col("pos"), F.col("pos") + 1 - F.col("start"))), F.count(F.lit(1))).first()
    longest = longest or 1
    h = 1
    while 2 * h <= longest:
        pair = suffixes.withColumn("a", F.element_at("ranks", -1)).withColumn("b", F.coalesce(F.lead("a", h).over(by_pos), F.lit(-1)))
        ranks = _ranked(pair, ["a", "b"], f"ranks-{2 * h}", n)
        longer = materialize(
            pair.join(ranks, ["a", "b"]).select(
                "did", "th", "isle", "pos", "line", "start", "end", F.concat("ranks", F.array("rank")).alias("ranks")
            ),
            f"suffixes-{2 * h}",
            n,
        )
        discard(suffixes, ranks)
        suffixes, h = longer, 2 * h

    def level(length):
        return F.floor(F.log2(length.cast("double") + 0.5)).cast("int")

    forward = suffixes.filter("end IS NOT NULL").select("did", "th", F.col("pos").alias("i"), "end")
    backward = suffixes.filter("start IS NOT NULL").select("did", "th", F.col("start").alias("i"), (F.col("pos") + 1).alias("end"))
    run = forward.unionByName(backward).distinct().withColumn("length", F.col("end") - F.col("i")).withColumn("level", level(F.col("length")))
    head = suffixes.select("did", "th", F.col("pos").alias("i"), F.col("ranks").alias("head"))
    tail = suffixes.select("did", "th", F.col("pos").alias("j"), F.col("ranks").alias("tail"))
    run = (
        run.withColumn("j", F.col("end") - F.pow(F.lit(2.0), F.col("level")).cast("int"))
        .join(head, ["did", "th", "i"])
        .join(tail, ["did", "th", "j"])
    )
    run = materialize(
        run.select(
            "did", "th", "i", "end", "length", F.element_at("head", F.col("level") + 1).alias("a"), F.element_at("tail", F.col("level") + 1).alias("b")
        ),
        "runs",
        2 * n,
    )
    at = F.struct("did", "th", "i")
    first = materialize(
        run.groupBy("length", "a", "b").agg(F.min(at).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "intervals", n
    )
    later = run.join(first, ["length", "a", "b"]).filter(at > F.col("earliest")).select("did", "th", "i", "end")
    order = Window.partitionBy("did", "th").orderBy("i", "end")
    later = later.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("part", F.sum(F.when(F.col("i") <= F.col("reach"), 0).otherwise(1)).over(order))
    merged = later.groupBy("did", "th", "part").agg(F.min("i").alias("i"), (F.max("end") - 1).alias("z"))
    line = suffixes.select("did", "th", "pos", "line")
    merged = merged.join(line.select("did", "th", F.col("pos").alias("i"), F.col("line").alias("first")), ["did", "th", "i"])
    merged = merged.join(line.select("did", "th", F.col("pos").alias("z"), F.col("line").alias("last")), ["did", "th", "z"])
    return materialize(merged.select("did", "th", "first", "last"), "later-copies", n)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every column of docs with the text freed of later copies of repeated line runs, and removed_lines.

    Lines are compared without white space at their ends; blank lines are no
    lines of a run, but one between two deleted lines goes with them. The first copy in the
    order of doc_id (null first, others than integers as strings), then a hash of the text, then the line stays;
    copies within one document count too, overlapping ones included. A run has
    to have min_words words at least (words are parted by ASCII white space).
    Rows that agree in doc_id and text are one document and keep the same lines.
    A null text stays null, a text of which all lines go becomes empty. If docs
    has a column n_chars, it is the new text's length. A column removed_lines of
    docs is replaced. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "removed_lines"]
    runs = repeated_runs(docs, min_words).groupBy("did", "th").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = runs.select(F.col("did").alias("run_did"), F.col("th").alias("run_th"), "runs")
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"))
    text = F.col("doc")["text"]
    rows = rows.withColumn("did", _did(F.col("doc")["doc_id"], docs.schema["doc_id"].dataType)).withColumn("th", F.xxhash64(F.coalesce(text, F.lit(""))))
    # always a merge join: it costs in proportion at every size, and no list of runs has to fit anywhere
    rows = rows.join(runs.hint("merge"), (F.col("did") == F.col("run_did")) & (F.col("th") == F.col("run_th")), "left")
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.exists("runs", lambda r: i.between(r["first"], r["last"])))
    new = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(left, "\n"))
    gone = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    rows = rows.withColumn("new", new).withColumn("gone", F.when(F.col("runs").isNull(), F.lit(0)).otherwise(gone))
    cols = [
        F.col("new").alias(c) if c == "text" else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("doc")[c].alias(c)
        for c in names
    ]
    return rows.select(*cols, F.col("gone").cast("int").alias("removed_lines"))
