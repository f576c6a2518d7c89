import math

import pytest

from pyspark.sql import functions as F

from examlake.llm.mixing import mix, poisson_inverse

SCHEMA = "doc_id long, text string, source string, copy string, order_key string, rate string"


def test_inverse_of_the_distribution(spark):
    rows = [(u / 97, mean) for u in range(97) for mean in (0.0, 0.3, 1.0, 7.5, 60.0, 250.0)]
    got = spark.createDataFrame(rows, "u double, mean double").select("u", "mean", poisson_inverse(F.col("u"), F.col("mean")).alias("k")).collect()
    for r in got:
        k, p = 0, math.exp(-r.mean)
        c = p
        while c <= r.u:
            k += 1
            p *= r.mean / k
            c += p
        assert r.k == k


def test_weights_and_order(spark):
    rows = [(i, "x" * (10 if i % 10 else 500), "big" if i % 5 else "small", "c", "o", "r") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df)
    assert got.columns == ["doc_id", "text", "source", "rate", "copy", "order_key"]
    out = got.collect()
    total = sum(len(r[1]) for r in rows)
    share = {s: sum(len(r.text) for r in out if r.source == s) / total for s in ("big", "small")}
    assert abs(share["big"] - 0.5) < 0.1 and abs(share["small"] - 0.5) < 0.1
    keys = [r.order_key for r in out]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by.values())
    assert [tuple(r) for r in mix(df.repartition(7)).collect()] == [tuple(r) for r in out]
    assert {r.source for r in mix(df, {"small": 1.0}).collect()} == {"small"}


def test_a_large_rate(spark):
    df = spark.createDataFrame([(1, "a", "rare", "", "", "")] + [(i, "b" * 100, "big", "", "", "") for i in range(2, 30)], SCHEMA)
    n = mix(df, {"rare": 1.0, "big": 1.0}).filter("source = 'rare'").count()
    assert 1200 < n < 1600


def test_copies_in_blocks(spark):
    df = spark.createDataFrame([(i, "a", "rare", "", "", "") for i in range(4)] + [(10, "b" * 40_000, "big", "", "", "")], SCHEMA)
    got = [tuple(r) for r in mix(df).collect()]  # about 5000 copies of each short row
    assert 18_000 < len(got) < 22_500
    assert [tuple(r) for r in mix(df, copies_per_task=37).collect()] == got


def test_weights_that_keep_nothing(spark):
    df = spark.createDataFrame([(1, "a", "s", "", "", ""), (2, "", "t", "", "", "")], SCHEMA)
    assert mix(df, {"s": 0.0}).count() == 0 and mix(df, {"t": 0.0, "s": 1.0}).filter("source = 't'").count() == 0
    with pytest.raises(ValueError):
        mix(df, {"s": -1.0})


def test_edge_cases(spark):
    rows = [(None, "abc", None, "", "", ""), (1, None, "s", "", "", ""), (1, None, "s", "", "", ""), (2, "", "t", "", "", "")]
    out = mix(spark.createDataFrame(rows, SCHEMA), total=3.0).collect()
    assert len([r for r in out if r.doc_id == 1]) % 2 == 0
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
