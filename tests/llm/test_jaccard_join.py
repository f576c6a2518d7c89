import random
import re

import numpy as np
import pyarrow as pa
import pytest

from examlake.llm.jaccard_join import jaccard_join, one_of_each
from examlake.llm.components import connected_components
from examlake.llm.shingles import Shingler

SCHEMA = "doc_id long, text string, n string, comp string"


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def brute(rows):
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted([(r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)], key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(40)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.7:
            text = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                if text:
                    k = rng.randrange(len(text))
                    text[k : k + 1] = rng.choice([[], [rng.choice(words)], [text[k], rng.choice(words)]])
            if rng.random() < 0.3:
                base.append(text)
        else:
            text = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 60, 100]))]
            base.append(text)
        if rng.random() < 0.3:
            text = text + common
        rows.append((i * 3 % n, rng.choice([" ", "\t", "\n "]).join(text).replace("w1", "W1") + " ", "x", "y"))
    return rows + [(None, rows[0][1], "", ""), (500, None, "", ""), (501, "", "", ""), (502, " \n", "", ""), rows[5], (503, "é È", "", "")]


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA))
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=repr) == brute(rows)


def test_a_chain_and_one_of_each(spark):
    words = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(30):  # neighbours link, far ones don't
        words[(i * 3) % 100] = f"x{i}"
        rows.append((i, " ".join(words), "", ""))
    rows += [(100, "", "a", ""), (101, None, "b", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join(df).collect()) == sorted((a, c) for a, _, c in brute(rows))
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_members_of_a_group_that_link_past_its_head(spark):
    # frequent words come last, and a text with one has the fewest rare ones: "often" makes a group's head
    words = [f"u{i}" for i in range(120)]
    by_hash = [words[i] for i in np.argsort([s[0] for s in Shingler(1).sets(pa.array(words))])]
    rows, linked = [], []
    for head in range(3):
        w = by_hash[head * 40 : head * 40 + 40]  # all three share the prefix w[:3] and no other group holds it; b and c link
        h, b, c = w[:3] + w[10:17], w[:3] + w[20:27], w[:3] + w[20:26] + [w[27]]
        (h, b, c)[head][-1] = "often"
        rows += [(10 * head + i, " ".join(t), "", "") for i, t in enumerate((h, b, c))]
        linked += [(10 * head, 10 * head), (10 * head + 1, 10 * head + 1), (10 * head + 2, 10 * head + 1)]
    rows += [(100 + i, " ".join(["often"] + [f"f{i}x{j}" for j in range(9)]), "", "") for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard_join(spark.createDataFrame(rows, SCHEMA).coalesce(1), words=1).collect()}
    assert [(i, got[i]) for i, _ in linked] == linked


def test_members_that_link_past_their_head_at_many_sizes(spark):
    words = [f"u{i}" for i in range(6000)]
    by_hash = [words[i] for i in np.argsort([s[0] for s in Shingler(1).sets(pa.array(words))])]
    rows, want, at = [], {}, 0
    for n in (8, 9, 13, 24, 50, 100):
        prefix = n - -(-3 * n // 4) + 1
        for head in range(3):  # the text with a frequent word has the fewest rare ones and becomes the head
            w, at = by_hash[at : at + 3 * n], at + 3 * n
            own = n - prefix
            h, b = w[:prefix] + w[prefix : prefix + own], w[:prefix] + w[prefix + own : prefix + 2 * own]
            c = b[:-1] + [w[-1]]
            (h, b, c)[head][-1] = "often"
            i = len(rows)
            rows += [(i + k, " ".join(t), "", "") for k, t in enumerate((h, b, c))]
            want |= {i: i, i + 1: i + 1, i + 2: i + 1}
    rows += [(9000 + i, " ".join(["often"] + [f"f{i}x{j}" for j in range(9)]), "", "") for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard_join(spark.createDataFrame(rows, SCHEMA).coalesce(1), words=1).collect()}
    assert {i: got[i] for i in want} == want


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}
