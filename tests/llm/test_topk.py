import math

import numpy as np
import pytest

from examlake.llm.topk import BitSlicedIndex, add_slices, quantised, search, signed_digits, top_rows

SCHEMA = "vec_id long, embedding array<float>, rank string, q string, block string, part string, role string, body string"


def brute(rows, k=5, each=50):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % each == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * (0.02 if i % 3 else 0.5))]) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(20)]  # ties
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2051, [float("nan")] * 6), (2052, [float("inf")] * 6), (2100, [0.0] * 6), (2101, [-100.0] * 6)]
    df = spark.createDataFrame([(i, v, *"xyzuvw") for i, v in rows], SCHEMA)
    v = quantised(df)
    got = search(v, v.filter("vec_id % 50 = 0"), block_rows=200, query_rows=7).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows)


def test_few_rows_and_none(spark):
    v = quantised(spark.createDataFrame([(0, [0.5], *"xyzuvw"), (1, [0.25], *"xyzuvw"), (2, [0.25], *"xyzuvw")], SCHEMA))
    assert [(r.query_id, r.rank, r.vec_id) for r in search(v, v.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    none = quantised(spark.createDataFrame([], SCHEMA))
    assert search(none, none).count() == 0


@pytest.mark.parametrize("n", [0, 1, -1, 7, -256, 255, 1023])
def test_signed_digits(n):
    assert sum(s * 2**j for j, s in signed_digits(n)) == n


def test_slice_arithmetic():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, size=(130, 9))
    query = rng.integers(-300, 300, size=9)
    index = BitSlicedIndex.unpacked(*BitSlicedIndex.of(np.arange(130), vectors).packed())
    total, extra = index.scores(query)
    bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little")[:130] for s in total]).astype(object)
    sums = (bits * (2 ** np.arange(len(total), dtype=object))[:, None]).sum(axis=0)
    assert {int(a - b) for a, b in zip(sums, (vectors @ query).astype(object))} == {extra}
    assert add_slices({}, 3) == []
    assert sorted(top_rows(total, index.real, index.ids, 4).tolist()) == sorted(np.lexsort((np.arange(130), -(vectors @ query)))[:4].tolist())


def test_shorter_vectors_and_repeated_rows(spark):
    rows = [(i, [float(i % 5) - 2.0] * (1 + i % 3)) for i in range(60)] + [(7, [2.0, 2.0, 2.0])] * 40
    v = quantised(spark.createDataFrame([(i, x, *"xyzuvw") for i, x in rows], SCHEMA))
    got = search(v, v.filter("vec_id % 50 = 0"), k=9, block_rows=16, query_rows=1).collect()
    wide = [(i, [math.floor(256 * x) for x in v] + [0] * (3 - len(v))) for i, v in rows]
    for q in (0, 50):
        own = dict(wide)[q]
        best = sorted((-sum(a * b for a, b in zip(own, x)), i) for i, x in wide if i != q)[:9]
        assert sorted((-r.score, r.vec_id) for r in got if r.query_id == q) == best
