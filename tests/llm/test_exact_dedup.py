import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from examlake.llm.exact_dedup import block_identities, exact_dedup

SCHEMA = "doc_id long, text string, name string, row string"


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def brute(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(norm(r[1]), []).append(i)
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is not None, rows[i][0] or 0))
        for i in members:
            out.append((rows[i][0], rows[best][0], len(members), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    base = ["", None, " \n\t", "a b", "ab", "ü é 𝄞", "x" * 100, "x" * 101, "y " * 57] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rows = [(i, rng.choice(base), "n", "r") for i in range(200)]
    return rows + [rows[0], (None, "ab ", "", ""), (7, "another text", "", "")]


@pytest.mark.parametrize("block", [4, 7, 8192])
def test_matches_brute_force(spark, block):
    rows = corpus()
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), block).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(r[1]) for r in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_names_do_not_rest_on_hashes(spark):
    rows = corpus()
    ident = block_identities(spark.createDataFrame(rows, SCHEMA), 5, hash_of=lambda c: F.length(c).cast("long") % 2)
    seen = {}
    for r in ident.collect():
        assert seen.setdefault((r.blocks, r.name), r.text_sha256) == r.text_sha256
    assert len(seen) == len({norm(r[1]) for r in rows})


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
