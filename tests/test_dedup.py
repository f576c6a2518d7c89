import random

import pyarrow as pa
from pyspark.sql import functions as F

from examlake.operators import dedup

SCHEMA = "unique_id long, description string"


def brute(rows, num=4, den=5):
    sets = [(k, set(t.lower().split())) for k, t in rows if k is not None and t and t.split()]
    out = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and len(x & y) * den > num * len(x | y):
                out.append((min(a, b), max(a, b), len(x & y) / len(x | y)))
    return sorted(out)


def found(df, **given):
    return sorted(tuple(r) for r in dedup.duplicate_pairs(df, **given).collect())


def texts(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for size in (1, 2, 4, 5, 6, 9, 10, 30, 120):
        base = [f"w{rng.randrange(40)}x{size}" if rng.random() < 0.5 else f"c{rng.randrange(30)}" for _ in range(size)]
        for _ in range(n // 6):
            own = list(base)
            for _ in range(rng.randrange(1 + max(1, size // 8))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(1000)}"
            own += [f"more{rng.randrange(9)}"] * rng.randrange(2)
            rng.shuffle(own)
            out.append(" \t".join(own))
    return out


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "w1 w2"), (900, ""), (901, None), (902, " \n"), (903, "ÄÖ É"), (904, "äö\vé"), (905, "w1 w2")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == brute(rows) and len(brute(rows)) > 50
    assert found(df, threshold=(1, 2)) == brute(rows, 1, 2) and found(df, threshold=(1, 10)) == brute(rows, 1, 10)
    assert found(df.limit(0)) == []


def test_neither_buckets_nor_blocks_change_pairs(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(90, 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in (("BLOCK_PAIRS", 3), ("BROADCAST_PAIRS", 1), ("SHARED", 1)):
        monkeypatch.setattr(dedup, name, value)
        assert found(df) == brute(rows)


def test_words_cross_no_shuffle(spark):
    """What is stored between the steps is a fraction of the words: no row for each word of each text."""
    rows = spark.range(400).select(F.col("id").alias("unique_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7919 + i * i) % 1500))).alias("description"))
    num, den = 4, 5
    own = rows.select(F.col("unique_id").alias("id"), F.xxhash64("description").alias("th"), F.col("description").alias("text"))
    words = sum(len(s) for s in dedup.word_sets(pa.array([r.text for r in own.collect()])))
    sent = dedup.word_signatures(own, dedup.word_levels(own.select("text")), num, den).agg(F.sum(F.size("prefix"))).first()[0]
    assert sent < 0.25 * words


def test_copies_are_one_node(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(20))) for i in range(50)] + [(i, " ".join(f"w{j}" for j in range(19))) for i in range(50, 60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    own = df.select(F.col("unique_id").alias("id"), F.xxhash64("description").alias("th"), F.col("description").alias("text"))
    signatures = dedup.word_signatures(own, dedup.word_levels(own.select("text")), 4, 5)
    assert dedup.met_pairs(signatures, 4, 5).count() == 1 and found(df) == brute(rows)
