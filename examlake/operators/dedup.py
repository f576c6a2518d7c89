"""Near-duplicate pairs by Jaccard similarity of word sets.

Rows with equal sets are one node; only nodes are compared, and their pairs
are given for all rows at the end. Words have one global order, rare ones
first. Of two linked sets, the smaller one's index prefix and the larger one's
prefix share SHARED words (or all that the sets share): what the nodes' prefixes
share is counted, and whole sets are compared where that is enough.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT

#: Words are counted in so many buckets (a power of two); any number gives the same result, as it only steers the order of words.
BUCKETS = 1 << 22
#: Words that two prefixes have to share. Any number gives the same result; more of them cost longer prefixes and leave fewer pairs to compare.
SHARED = 3
#: Pairs that are compared in one block, and pairs up to which the list of texts to fetch is broadcast.
BLOCK_PAIRS, BROADCAST_PAIRS = 4096, 1_000_000
#: Rows with whole texts that go to Python at a time, and those whose words are parted at once.
TEXT_ROWS, SLICE_ROWS = 2_000, 200
#: Sets whose prefix a task remembers having sent.
SENT_SETS = 100_000

#: Byte table: white space as the pattern \s has it (tab to carriage return) to a space.
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def word_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct word hashes."""
    for at in range(0, len(texts), SLICE_ROWS):
        part = texts.slice(at, SLICE_ROWS).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        body = part.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]].translate(_SPACES) if part.buffers()[2] is not None else b""
        plain = pa.Array.from_buffers(pa.large_string(), len(part), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(body)])
        words = pc.split_pattern(plain, " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        distinct, codes, bounds = coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds - bounds[0]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
        real = np.fromiter((w != "" for w in distinct), bool, len(distinct))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.unique(codes[a:b])
            yield np.sort(hashes[own[real[own]]])


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Within it, plans that run send TEXT_ROWS rows to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stored(df: DataFrame, folder: str) -> DataFrame:
    """df written to a new table under folder, and read back."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_levels(texts: DataFrame) -> np.ndarray:
    """For each bucket of word hashes, how many rows hold its words, as 6 * log2; 0 for one row or none. From all rows of texts (one column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for s in word_sets(batch.column(0)):
                np.add.at(n, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        held = np.flatnonzero(n)
        for at in range(0, len(held), 100_000):
            part = held[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], ["bucket", "n"])

    sums = texts.mapInArrow(run, "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1")
    found = sums.select("bucket", F.least(F.lit(1) + F.floor(6 * F.log2("n")), F.lit(255)).cast("short").alias("level")).toArrow()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[found.column("bucket").to_numpy()] = found.column("level").to_numpy().astype(np.uint8)
    return levels


def word_signatures(rows: DataFrame, levels: np.ndarray, num: int, den: int) -> DataFrame:
    """id, th, f (hash of the whole set), n (its size), short and prefix of all rows (id, th, text) with words.

    prefix has the first words in the global order, with their places, but not
    those of one row only; a task gives it with the first row of a set. Places
    below short are the index prefix.
    """
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(levels)  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        for batch in batches:
            at, f, n, short, words, places = [], [], [], [], [], []
            for k, s in enumerate(word_sets(batch.column(2))):
                if not len(s):
                    continue
                size, own = len(s), int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                often = level[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[: 0 if own in seen else min(size, size - -(-num * size // den) + SHARED)]
                place = np.flatnonzero(often[order])
                at.append(k), f.append(own), n.append(size), words.append(s[order[place]]), places.append(place)
                short.append(min(size, size - -(-2 * num * size // (num + den)) + SHARED))
                seen.add(own)
            if len(seen) > SENT_SETS:  # a prefix sent again changes nothing
                seen = set()
            if not at:
                continue
            ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(words).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["w", "i"])
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(f, pa.int64()), pa.array(n, pa.int64()), pa.array(short, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), each)],
                ["id", "th", "f", "n", "short", "prefix"],
            )

    return rows.mapInArrow(run, f"id {kind}, th long, f long, n long, short int, prefix array<struct<w:long,i:int>>")


def met_pairs(signatures: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, key: all nodes that can link, a's set not larger than b's, and half the hash of the least word that their prefixes share."""
    # n, place and whether it is in the index prefix in one number: both sides of the join need the same columns, and so share one shuffle
    packed = F.shiftleft("n", 32).bitwiseOR(F.shiftleft(F.col("x.i").cast("long"), 1)).bitwiseOR((F.col("x.i") < F.col("short")).cast("long"))
    words = signatures.select("f", "n", "short", F.explode("prefix").alias("x")).select("x.w", "f", packed.alias("p"))
    words = words.repartition("w").groupBy("w", "f").agg(F.min("p").alias("p"))
    a = words.filter(F.col("p").bitwiseAND(F.lit(1)) == 1).select("w", F.col("f").alias("a"), F.col("p").alias("p_a"))
    b = words.select(F.col("w").alias("w_b"), F.col("f").alias("b"), F.col("p").alias("p_b"))
    n_a, n_b = F.shiftright("p_a", 32), F.shiftright("p_b", 32)
    i_a, i_b = (F.shiftright(F.col(c).bitwiseAND(F.lit((1 << 32) - 1)), 1) for c in ("p_a", "p_b"))
    smaller = (n_a < n_b) | ((n_a == n_b) & (F.col("a") < F.col("b")))
    # holds for the first SHARED words that two linked sets share
    enough = (F.least(n_a - i_a, n_b - i_b) + SHARED - 1) * (num + den) >= num * (n_a + n_b)
    met = a.join(b, (F.col("w") == F.col("w_b")) & smaller & (n_a * den >= n_b * num) & enough)
    least = F.least(F.lit(SHARED).cast("long"), F.floor((num * (n_a + n_b) + num + den - 1) / F.lit(num + den)))
    met = met.select("a", "b", F.shiftright("w", 32).cast("int").alias("key"), least.alias("least"))
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("same"), F.min("key").alias("key"), F.min("least").alias("least"))
    return met.filter("same >= least").select("a", "b", "key")


def verified_pairs(met: DataFrame, signatures: DataFrame, rows: DataFrame, num: int, den: int, folder: str) -> DataFrame:
    """a, b, similarity of those pairs of met whose sets are above the threshold.

    Pairs meet at their common word, dealt into blocks where it has many, so a
    text is sent once for each block and not for each of its pairs.
    """
    often = met.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > BLOCK_PAIRS)
    cuts = F.coalesce(F.ceil(F.sqrt(F.col("k") / BLOCK_PAIRS)), F.lit(1))
    place = ["key", F.pmod(F.xxhash64("a"), cuts).alias("ga"), F.pmod(F.xxhash64("b"), cuts).alias("gb")]
    dealt = met.join(often, "key", "left").select(*place, "a", "b")
    first = dealt.select("key", "ga", "gb", F.lit(0).alias("role"), F.col("a").alias("node"), F.array().cast("array<long>").alias("others")).distinct()
    second = dealt.groupBy("key", "ga", "gb", F.col("b").alias("node")).agg(F.collect_list("a").alias("others"))
    asked = first.unionByName(second.withColumn("role", F.lit(1)))
    held = signatures.groupBy(F.col("f").alias("node")).agg(F.min(F.struct("id", "th")).alias("row"))
    asked = _stored(asked.join(held, "node").select("key", "ga", "gb", "role", "node", "others", F.col("row.id").alias("d"), F.col("row.th").alias("t")), folder)
    few = F.broadcast(asked) if met.count() <= BROADCAST_PAIRS else asked
    texts = rows.join(few, (F.col("id") == F.col("d")) & (F.col("th") == F.col("t"))).select("key", "ga", "gb", "role", "node", "others", "text")
    texts = texts.repartition("key", "ga", "gb").sortWithinPartitions("key", "ga", "gb", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}
        for batch in batches:
            found = []
            for *here, role, node, others, s in zip(*[batch.column(i).to_pylist() for i in range(6)], word_sets(batch.column(6)), strict=True):
                if here != block:
                    block, held = here, {}
                if role == 0:
                    held[node] = s
                for a in others:
                    small = held[a]
                    same = int(np.count_nonzero(s[np.minimum(np.searchsorted(s, small), len(s) - 1)] == small))
                    either = len(small) + len(s) - same
                    if same * den > num * either:
                        found.append((a, node, same / either))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return texts.mapInArrow(run, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def duplicate_pairs(rows: DataFrame, key: str = "unique_id", text: str = "description", threshold: tuple[int, int] = DEFAULT.duplicate_threshold) -> DataFrame:
    """id_1 < id_2 and similarity of all pairs whose word sets have a Jaccard similarity above threshold (a fraction).

    Words are parted by white space and compared in lower case, sets as 64-bit
    hashes of words, equal sets by a 64-bit hash of all; null and empty texts
    and null keys pair with nothing. rows is read several times, when this is
    called; tables between the steps lie in the folder of spark.checkpoint.dir.
    """
    spark, (num, den) = rows.sparkSession, threshold
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{base.rstrip('/') if base else 'file://' + tempfile.mkdtemp(prefix='examlake-')}/duplicates"
    rows = rows.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")
    with _small_batches(spark):
        signatures = _stored(word_signatures(rows, word_levels(rows.select("text")), num, den), folder)
        met = _stored(met_pairs(signatures, num, den), folder)
        found = _stored(verified_pairs(met, signatures, rows, num, den, folder), folder)
    copies = signatures.groupBy("f").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("f").alias("a"), F.col("f").alias("b"), F.lit(1.0).alias("similarity"))
    one, two = (signatures.select(F.col("f").alias(x), F.col("id").alias(f"id_{x}")) for x in "ab")
    pairs = found.unionByName(copies).join(one, "a").join(two, "b")
    # the rows of one node meet both ways round
    pairs = pairs.filter(F.when(F.col("a") == F.col("b"), F.col("id_a") < F.col("id_b")).otherwise(F.col("id_a") != F.col("id_b")))
    return pairs.select(F.least("id_a", "id_b").alias("id_1"), F.greatest("id_a", "id_b").alias("id_2"), "similarity")


def drop_duplicates_of(rows: DataFrame, pairs: DataFrame, key: str = "unique_id") -> DataFrame:
    """rows without those that are the later one of a pair."""
    return rows.join(pairs.select(F.col("id_2").alias(key)).distinct(), key, "left_anti")
