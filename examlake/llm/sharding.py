"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard. At each node
every child draws ``-ln(u) / weight`` with u hashed from the row's key and the
child's path, and the smallest draw wins (weighted rendezvous). A child's draw
depends on nothing but the key, its path and its weight, so a changed weight
moves rows only into or out of that child's subtree. A new shard that opens a
region of its own therefore takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unit_hash

SHARDS_PER_RACK = 2
RACKS_PER_REGION = 2


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number; an inner node's weight is its children's sum."""

    name: str
    own_weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default_factory=tuple)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def grid(shards: int) -> Node:
    """Regions of two racks of two shards each, all of weight 1; the last ones may be smaller."""
    regions = []
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    for r in range(0, shards, per_region):
        racks = []
        for k in range(r, min(r + per_region, shards), SHARDS_PER_RACK):
            leaves = tuple(Node(f"shard{s}", 1.0, s) for s in range(k, min(k + SHARDS_PER_RACK, r + per_region, shards)))
            racks.append(Node(f"rack{k}", children=leaves))
        regions.append(Node(f"region{r}", children=tuple(racks)))
    return Node("root", children=tuple(regions))


def leaves(tree: Node) -> list[Node]:
    return [x for c in tree.children for x in leaves(c)] if tree.children else [tree]


def grow(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    s = max(x.shard for x in leaves(tree)) + 1
    leaf = Node(f"shard{s}", weight, s)
    return Node(tree.name, children=(*tree.children, Node(f"region{s}", children=(Node(f"rack{s}", children=(leaf,)),))))


def shard_of(tree: Node, *key: Column, path: str = "") -> Column:
    """The shard that the key's descent ends in."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    at = f"{path}/{tree.name}"
    if len(tree.children) == 1:
        return shard_of(tree.children[0], *key, path=at)
    draws = [
        F.struct((-F.log(unit_hash(F.lit(f"{at}/{c.name}"), *key)) / F.lit(float(c.weight))).alias("draw"), F.lit(i).alias("i"))
        for i, c in enumerate(tree.children)
    ]
    won = F.array_min(F.array(*draws))["i"]
    out = shard_of(tree.children[-1], *key, path=at)
    for i, c in reversed(list(enumerate(tree.children[:-1]))):
        out = F.when(won == i, shard_of(c, *key, path=at)).otherwise(out)
    return out


def with_shard(docs: DataFrame, tree: Node, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs, texts and all, with the shard of each row; no shuffle. Write it with partitionBy(name) for shard files.

    A null key draws like any other value. Rows of one key share a shard.
    """
    return docs.withColumn(name, shard_of(tree, F.col(key)).cast("int"))


def placement(docs: DataFrame, tree: Node, rows_per_bucket: int = 20_000, copies_per_task: int = 100_000) -> DataFrame:
    """Where each row goes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 1. slot counts the rows of
    a shard from 0 without gaps, ordered by a hashed bucket, doc_id, size and
    checksum, so it doesn't depend on the input's partitioning. Rows that agree
    in all three are counted before the shuffle and written out again in blocks,
    so even a third of all rows under one doc_id meets in no single task. Nulls:
    a null doc_id is a key like others. An empty table gives an empty result.
    Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("shard", shard_of(tree, F.col("doc_id")).cast("int"))
        .withColumn("grown_shard", shard_of(grow(tree), F.col("doc_id")).cast("int"))
    )
    buckets = max(1, -(-docs.count() // (rows_per_bucket * len(leaves(tree)))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "bucket")
        .agg(F.sum("n").alias("rows"))
        .select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(copies_per_task).cast("long"))))
    copies = F.sequence(F.col("block"), F.least(F.col("block") + copies_per_task, F.col("n")) - 1)
    return blocks.withColumn("copy", F.explode(copies)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("within") + F.col("copy")).cast("long").alias("slot"),
        "grown_shard",
    )
