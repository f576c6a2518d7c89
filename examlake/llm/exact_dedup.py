"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks. The distinct blocks are sorted and get
integer names; then adjacent pairs of names are sorted and named again, round
by round, until each document has one name. Two documents have the same name
(and block count) if and only if their texts are equal: names stand for
contents, never for hashes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

WHITE = " \t\n\x0b\x0c\r"


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """An integer name for each row, in sorted order within the row's partition; fixed by being written."""
    return materialize(
        distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "names"
    )


def block_identities(docs: DataFrame, block_chars: int = 8192, hash_of=F.xxhash64) -> DataFrame:
    """One row per input row: row, doc_id, chars, text_sha256, blocks, name.

    (blocks, name) identifies the normalised text without collisions. A null
    text counts as empty and has one empty block. Of docs only doc_id and text
    are read. Equal blocks are counted before the shuffle, so a text with any
    number of copies crosses it once per map task. hash_of only routes blocks;
    distinct blocks that share a hash are told apart by their content.
    """
    norm = F.translate(F.coalesce(F.col("text"), F.lit("")), WHITE, "")
    cut = F.regexp_extract_all(F.col("norm"), F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    texts = docs.select("doc_id", F.length(F.coalesce(F.col("text"), F.lit(""))).alias("chars"), norm.alias("norm"))
    blocks = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut)

    distinct = texts.select(F.explode(blocks).alias("block")).select(hash_of("block").alias("h"), "block").distinct()
    names = materialize(
        distinct.sortWithinPartitions("block").select("h", "block", F.monotonically_increasing_id().alias("name")), "blocks"
    )
    shared = names.groupBy("h").count().filter("count > 1").select("h")

    found = (
        texts.withColumn("row", F.monotonically_increasing_id())
        .withColumn("text_sha256", F.sha2("norm", 256))
        .withColumn("cut", blocks)
        .select(
            "row",
            "doc_id",
            "chars",
            F.size("cut").alias("blocks"),
            F.col("text_sha256"),
            F.posexplode("cut").alias("pos", "block"),
        )
        .withColumn("text_sha256", F.when(F.col("pos") == 0, F.col("text_sha256")))
        .withColumn("h", hash_of("block"))
    )
    if not shared.isEmpty():  # distinct blocks with one hash
        mark = shared.withColumn("shared", F.lit(True))
        own = F.when(F.col("shared"), F.col("block")).otherwise(F.lit(""))
        found = found.join(mark, "h", "left").withColumn("own", own).drop("block", "shared")
        known = names.join(mark, "h", "left").withColumn("own", own).drop("block", "shared")
        found = found.join(known, ["h", "own"])
    else:
        found = found.drop("block").join(names.select("h", "name"), "h")
    base = materialize(found.select("row", "doc_id", "chars", "blocks", "text_sha256", "pos", "name"), "occurrences")
    discard(names)

    heads = base.filter("pos = 0").select("row", "doc_id", "chars", "text_sha256", "blocks")
    done = base.filter("blocks = 1").select("row", "doc_id", "chars", "text_sha256", "blocks", "name")
    longest = base.agg(F.max("blocks")).first()[0] or 1
    if longest == 1:
        return done
    left = base.filter("blocks > 1").select("row", "blocks", F.col("blocks").alias("left"), "pos", "name")
    finals = []
    while longest > 1:
        pairs = left.groupBy("row", "blocks", "left", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        up = materialize(
            pairs.join(names, ["a", "b"]).select("row", "blocks", F.ceil(F.col("left") / 2).cast("int").alias("left"), "pos", "name"), "pairs"
        )
        discard(names)
        finals.append(up.filter("left = 1").select("row", "name"))
        left = up.filter("left > 1")
        longest = -(-longest // 2)
    named = finals[0]
    for x in finals[1:]:
        named = named.unionByName(x)
    return done.unionByName(heads.filter("blocks > 1").join(named, "row"))


def exact_dedup(docs: DataFrame, block_chars: int = 8192) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical without white space (space, tab to carriage
    return). Of equal texts the row with the most code points in its original
    text stays, then the one with the smallest doc_id (null before all), then
    the first in the input. A null text counts as empty; empty texts are one
    group. Repeated rows are members like others and exactly one row of a group
    is kept. An empty table gives an empty result. Other columns are not read.
    """
    ident = block_identities(docs, block_chars)
    groups = materialize(
        ident.groupBy("blocks", "name")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").alias("keep_id"), "row")).alias("first"))
        .filter("group_size > 1")
        .select("blocks", "name", "group_size", "first.keep_id", F.col("first.row").alias("keep_row")),
        "groups",
    )
    one = F.col("group_size").isNull()
    return ident.join(groups, ["blocks", "name"], "left").select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
