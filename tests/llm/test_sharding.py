import zlib

from examlake.llm.sharding import grid, grow, leaves, placement, with_shard

SCHEMA = "doc_id long, text string, shard string, slot string"


def test_law_and_slots(spark):
    rows = [(i, f"text {i % 7} é", "a", "b") for i in range(3000)] + [(5, "text 5 é", "", "")] * 40 + [(5, "other", "", ""), (None, None, "", ""), (9, "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = placement(df, grid(8), rows_per_bucket=50, copies_per_task=7).collect()
    want = sorted((repr(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots, at = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert at.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(300 < len(s) < 500 for s in slots.values())
    again = placement(df.repartition(3), grid(8), rows_per_bucket=50).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_changed_weight_moves_rows_into_its_subtree_only(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    old, new = grid(9), grid(10)  # the third region gets a second shard
    a = {r.doc_id: r.shard for r in with_shard(df, old).collect()}
    b = {r.doc_id: r.shard for r in with_shard(df, new).collect()}
    assert all(b[k] in (8, 9) for k in a if a[k] != b[k])
    assert [x.shard for x in leaves(grow(grid(8)))] == list(range(9))


def test_weights(spark):
    tree = grow(grid(4), weight=4.0)
    n = with_shard(spark.range(4000).withColumnRenamed("id", "doc_id"), tree).filter("shard = 4").count()
    assert 1800 < n < 2200


def test_empty_table(spark):
    assert placement(spark.createDataFrame([], SCHEMA), grid(8)).count() == 0
