"""N-gram Jaccard join by grouped prefixes.

Each document is a set of word shingles in one global order: rare ones first
(frequent ones, found by counting over all documents, come last), by hash
within them. Two sets of sizes x and y with Jaccard similarity t or more share
a shingle among the first ``n - ceil(t n) + 1`` of each. Documents with the
same prefix and size are collapsed into one group, and only groups are joined:

1. Groups that share a prefix shingle are linked to the least of them if size
   and position filters allow; these group pairs are expanded to one member
   each and verified, as are the members of a group against its first. This
   finds most links with as many candidates as there are documents.
2. Whatever pairs of members share enough prefix shingles and still lie in
   different components are verified one and all, so no link between
   components is lost. Rows of a shingle's largest component are met only by
   the others, never by each other.

Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, give_back, materialize, release, small_batches
from .components import connected_components
from .shingles import Shingler, overlap
from .tokens import slices_by_bytes

WORDS = 5
#: The similarity from which two documents link, as a fraction of integers.
SIMILAR = (75, 100)
#: At most so many frequent shingles go last in the order. Any number gives the same result; it only steers how many candidates there are.
FREQUENT = 1 << 18
#: Shingles counted together before they are sent on, and candidates up to which a list of ids is broadcast.
COUNTED_ROWS, BROADCAST_ROWS = 2_000_000, 1_000_000
#: Groups whose prefix a task remembers having sent.
SENT_GROUPS = 100_000
#: Bytes of text that are shingled at once.
SLICE = 2_000_000
#: Rows that share a frequent shingle and meet in one task.
TOKEN_ROWS = 5_000


def frequent_shingles(docs: DataFrame, words: int = WORDS, least: int = 8, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many documents hold, and their counts, from all documents.

    Each task counts its documents in large batches and passes on what it saw
    twice; the sums rank the shingles. The bounded list is an order, not a filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(words), [], 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

        for batch in batches:
            texts = batch.column(0)
            for at, rows in slices_by_bytes(texts, SLICE):
                for s in shingler.sets(texts.slice(at, rows)):
                    held.append(s)
                    size += len(s)
                if size >= COUNTED_ROWS:
                    yield counted()
                    held, size = [], 0
            give_back()
        if held:
            yield counted()
        held = []
        give_back()

    sums = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    with small_batches(docs.sparkSession):
        top = sums.orderBy(F.col("n").desc(), "h").limit(most).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


class Order:
    """The global order of shingles: rank of each set's members."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, self.counts = hashes, counts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def ordered(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """A sorted set in the global order, by frequency (0 unless listed), then hash; the frequencies; and how many aren't listed."""
        may = np.flatnonzero(self.maybe[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(self.hashes) or not len(may):
            return s, np.zeros(len(s), np.int64), len(s)
        at = np.minimum(np.searchsorted(self.hashes, s[may]), len(self.hashes) - 1)
        listed = self.hashes[at] == s[may]
        n = np.zeros(len(s), np.int64)
        n[may[listed]] = self.counts[at[listed]]
        order = np.argsort(n, kind="stable")
        return s[order], n[order], len(s) - int(listed.sum())


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, th (hash of the text), n, f1 and f2 (of the whole set), gkey (of size and prefix), rare, prefix, for every row.

    rare is the number of shingles that aren't frequent: among near copies, the
    text that the others were made of has the least. Each shingle of prefix has
    a number of parts to deal the rows that share it to, by how frequent it is.
    A task gives a group's prefix with the first of its rows only.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(order)  # FREQUENT entries at most
    num, den = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rank, seen = Shingler(words), Order(*shared.value), set()
        for batch in batches:
            texts = batch.column(2)
            for at, rows in slices_by_bytes(texts, SLICE):
                n, f1, f2, g, r, prefix, parts = [], [], [], [], [], [], []
                for s in shingler.sets(texts.slice(at, rows)):
                    size = len(s)
                    p, often, rare = rank.ordered(s)
                    room = size - -(-num * size // den) + 1 if size else 0
                    p, often = p[:room], often[:room]
                    a, b = _digest(s.tobytes())
                    n.append(size), f1.append(a), f2.append(b), r.append(rare)
                    g.append(_digest(size.to_bytes(8, "little") + p.tobytes())[0])
                    room = 0 if g[-1] in seen else room
                    prefix.append(p[:room].view(np.int64)), parts.append(-(-often[:room] // TOKEN_ROWS))
                    seen.add(g[-1])
                if len(seen) > SENT_GROUPS:  # a prefix sent again changes nothing
                    seen = set()
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(prefix)), pa.array(np.concatenate(parts).astype(np.int32))], ["token", "parts"])
                lists = pa.ListArray.from_arrays(pa.array(ends), pairs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), batch.column(1).slice(at, rows)] + [pa.array(x, pa.int64()) for x in (n, f1, f2, g, r)] + [lists],
                    ["doc_id", "th", "n", "f1", "f2", "gkey", "rare", "prefix"],
                )
            give_back()

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, th long, n long, f1 long, f2 long, gkey long, rare long, prefix array<struct<token:long,parts:int>>")


def may_link(n: Column, i: Column, m: Column, j: Column, similar: tuple[int, int] = SIMILAR) -> Column:
    """Whether sets of sizes n and m can link if their first common shingle has positions i and j."""
    num, den = similar
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & ((F.least(n - i, m - j)) * (num + den) >= num * (n + m))


def least_shared(n: Column, m: Column, similar: tuple[int, int] = SIMILAR) -> Column:
    """How many shingles the prefixes of two sets of sizes n <= m share at least if the sets link.

    The set whose prefix ends first shares nothing else with the other but what
    follows its prefix: ``ceil(t n) - 1`` shingles at most.
    """
    num, den = similar
    return F.ceil((n + m) * num / F.lit(float(num + den))) - F.ceil(m * num / F.lit(float(den))) + 1


def verified(
    pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR, chunk: int = 64
) -> DataFrame:
    """The rows of pairs (a, b: long) whose nodes' documents link.

    The members b of an a are dealt into chunks, each with a's text once, so a
    node with very many partners is spread over tasks. Texts are read from docs
    and cross one shuffle, to where their pairs are.
    """
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / chunk)).alias("part"))
    asked = dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("node")).distinct().unionByName(dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("node")))
    asked = materialize(asked.join(nodes, "node").select("a", "part", "role", "node", F.col("row.doc_id").alias("d"), F.col("row.th").alias("t")), "asked")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).join(few, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("a", "part", "role", "node", "text").repartition(n, "a", "part").sortWithinPartitions("a", "part", "role").select("a", "role", "node", "text")
    num, den = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, head = Shingler(words), np.zeros(0, np.uint64)
        for batch in batches:
            for at, size in slices_by_bytes(batch.column(3), SLICE):
                part = batch.slice(at, size)
                found = []
                cols = (part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), shingler.sets(part.column(3)))
                for a, role, node, s in zip(*cols, strict=True):
                    if role == 0:
                        head = s
                        continue
                    same = overlap(head, s)
                    if den * same >= num * (len(head) + len(s) - same):
                        found.append((a, node))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            give_back()

    return rows.mapInArrow(run, "a long, b long")


def jaccard_join(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept for every row of docs.

    Two documents link when |A & B| / |A | B| is at least ``similar`` over their
    sets of distinct shingles (see Shingler). component_id is the smallest
    doc_id reachable by links, the own one included; a document without words
    (or with a null text) links with nothing. kept marks the document that
    stays of each component: that of the smallest doc_id, then the smallest
    hash th of the text. Rows with equal sets are one node, so copies are never
    paired with each other; repeated rows share all columns. A null doc_id
    counts as larger than others. An empty table gives an empty result. Other
    columns of docs are not read.
    """
    order = frequent_shingles(docs, words)
    with small_batches(docs.sparkSession):
        sig = materialize(signatures(docs, order, words, similar), "signatures")
    # one node for each distinct set; row: a document that holds it
    row = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("th"))
    nodes = sig.filter("n > 0").groupBy("f1", "f2").agg(F.min(row).alias("row"), F.min("n").alias("n"), F.min("gkey").alias("gkey"), F.min("rare").alias("rare"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    group = F.struct("rare", "node", "n")
    groups = materialize(nodes.groupBy("gkey").agg(F.min(group).alias("head"), F.count(F.lit(1)).alias("members")), "groups")

    # shingles that two groups hold in their prefixes; each row has its shingle's group of the fewest rare ones, or
    # that of its part, where the rows of a shingle are dealt to several
    tokens = sig.select("gkey", "n", "rare", F.posexplode("prefix").alias("pos", "x")).select("gkey", "n", "rare", "pos", "x.token", "x.parts")
    tokens = tokens.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("gkey"), F.col("parts"))).otherwise(F.lit(0)))
    by_token = Window.partitionBy("token", "part")
    me = F.struct("rare", "gkey", "n", "pos")
    tokens = tokens.withColumn("least", F.min(me).over(by_token)).withColumn("lo", F.min("gkey").over(by_token)).withColumn("hi", F.max("gkey").over(by_token))
    tokens = tokens.withColumn("again", F.row_number().over(Window.partitionBy("token", "part", "gkey").orderBy("pos")))
    tokens = tokens.filter("again = 1 AND (lo < hi OR parts > 1)").select("token", "parts", "gkey", "n", "pos", "least")
    tokens = materialize(tokens, "tokens")
    release(docs.sparkSession)
    tops = tokens.filter("parts > 1").select("token", "least").distinct()
    top = tops.groupBy("token").agg(F.min("least").alias("top"))
    across = tops.join(top, "token").filter("least.gkey <> top.gkey").select(F.col("top.gkey").alias("ga"), F.col("least.gkey").alias("gb"))
    star = tokens.filter("gkey <> least.gkey").filter(may_link(F.col("n"), F.col("pos"), F.col("least.n"), F.col("least.pos"), similar))
    pairs = star.select(F.col("least.gkey").alias("ga"), F.col("gkey").alias("gb")).unionByName(across).distinct()
    heads = groups.select("gkey", F.col("head.node").alias("node"))
    pairs = pairs.join(heads.select(F.col("gkey").alias("ga"), F.col("node").alias("a")), "ga").join(heads.select(F.col("gkey").alias("gb"), F.col("node").alias("b")), "gb").select("a", "b")
    inside = nodes.join(groups.filter("members > 1").select("gkey", F.col("head.node").alias("a")), "gkey").filter("node <> a").select("a", F.col("node").alias("b"))
    pairs = materialize(pairs.unionByName(inside), "pairs")

    with small_batches(docs.sparkSession):
        links = materialize(verified(pairs, nodes, docs, words, similar), "links")
    comp = connected_components(links)
    comp = materialize(nodes.select("node", "gkey", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "components")

    # what still lies apart: members of groups that share a shingle, or of one group
    member = comp.select("gkey", "node", "comp", "n")
    many = groups.filter("members > 1").select("gkey")
    held = tokens.select("token", "gkey", "pos").join(member, "gkey").select("token", "pos", "node", "comp", "n", "gkey")
    held = held.unionByName(many.join(member, "gkey").select(F.col("gkey").alias("token"), F.lit(0).alias("pos"), "node", "comp", "n", "gkey"))
    share = held.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = share.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    held = materialize(held.join(main.select("token", F.col("top.comp").alias("main")), "token"), "held")
    x = held.filter("comp <> main").select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "comp", "n", "pos")])
    y = held.select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "comp", "n", "pos", "main")])
    apart = (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("y_main")) | (F.col("x_node") < F.col("y_node")))
    met = x.join(y, (x["token"] == y["token"]) & apart & may_link(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos"), similar))
    met = met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    own = held.groupBy("node").agg(F.collect_list("token").alias("tokens"), F.first("n").alias("n"), F.first("gkey").alias("gkey"))
    both = met.join(own.select(F.col("node").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"), F.col("gkey").alias("ga")), "a")
    both = both.join(own.select(F.col("node").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"), F.col("gkey").alias("gb")), "b")
    # members of one group share their whole prefix, of which held has only what other groups hold too
    enough = (F.col("ga") == F.col("gb")) | (F.size(F.array_intersect("ta", "tb")) >= least_shared(F.least("na", "nb"), F.greatest("na", "nb"), similar))
    rest = materialize(both.filter(enough).select("a", "b"), "rest")
    discard(tokens, held, pairs)
    with small_batches(docs.sparkSession):
        more = materialize(verified(rest, nodes, docs, words, similar), "links")
    discard(rest)
    if not more.isEmpty():
        ends = more.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        joined = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        joined = materialize(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "joined")
        comp = materialize(comp.join(joined, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components")

    least = nodes.join(comp.select("node", "comp"), "node")
    first = materialize(least.groupBy("comp").agg(F.min("row").alias("first")), "first")
    node = materialize(least.join(first, "comp").select("f1", "f2", "first"), "node-components")
    out = sig.select("doc_id", "th", "n", "f1", "f2").join(node, ["f1", "f2"], "left")
    alone = F.col("first").isNull()
    return out.select(
        "doc_id",
        "th",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).alias("kept"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The rows of docs that jaccard_join() keeps, whole; of repeated rows with words, one."""
    keep = materialize(jaccard_join(docs, words, similar).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("th").alias("keep_th"), "n_shingles").distinct(), "kept")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    row = row.withColumn("th", F.xxhash64(F.coalesce(F.col("doc")["text"], F.lit(""))))
    out = row.join(keep, F.col("doc")["doc_id"].eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th")))
    again = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not again:
        same = out.filter("n_shingles > 0").dropDuplicates(["keep_id", "keep_th"])
        out = out.filter("n_shingles = 0").unionByName(same)
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
