import random

import pytest

from examlake.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, n_chars long, first string"


def brute(rows, least):
    """Delete every line that lies in a run of `least` words or more with an earlier copy, by trying all pairs of positions."""
    docs, seen = [], set()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in order:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            docs.append(r)
    seq = []
    for d, r in enumerate(docs):
        k = 0
        for i, line in enumerate((r[1] or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                seq.append((d, k, i, line.strip(" \t\r\x0b\x0c")))
                k += 1
    drop = {d: set() for d in range(len(docs))}
    for a in range(len(seq)):
        for b in range(a):
            n = words = 0
            while a + n < len(seq) and b + n < len(seq) and seq[a + n][0] == seq[a][0] and seq[b + n][0] == seq[b][0] and seq[a + n][3] == seq[b + n][3]:
                words += len(seq[a + n][3].split())
                n += 1
            if words >= least:
                drop[seq[a][0]] |= set(range(seq[a][2], seq[a + n - 1][2] + 1))
    for d in drop:  # a blank line between two deleted lines goes
        own = [i for e, _, i, _ in seq if e == d]
        for i, j in zip(own, own[1:]):
            if i in drop[d] and j in drop[d]:
                drop[d] |= set(range(i, j))
    at = {(r[0], r[1]): d for d, r in enumerate(docs)}
    out = []
    for r in rows:
        gone = drop[at[(r[0], r[1])]]
        text = r[1] if not gone else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)
        out.append((r[0], text, None if text is None else len(text), len(gone)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(1, 4))) for _ in range(6)] + ["", "  "]
    runs = [[rng.choice(lines) for _ in range(rng.randint(2, 9))] for _ in range(3)]
    rows = []
    for i in range(25):
        body = []
        for _ in range(rng.randint(0, 4)):
            body += rng.choice(runs) if rng.random() < 0.6 else [f"own {i} {rng.random()}"]
        rows.append((i if i != 7 else None, "\n".join(body) if i != 9 else None, 0, "x"))
    return rows + [rows[3], (5, rows[2][1], 0, "y"), (30, "x y\n" * 12, 0, "z"), (31, "", 0, "z")]


@pytest.mark.parametrize("seed,least", [(0, 5), (1, 7), (2, 12), (3, 1)])
def test_matches_brute_force(spark, seed, least):
    rows = corpus(seed)
    got = line_dedup(spark.createDataFrame(rows, SCHEMA), least)
    assert got.columns == ["doc_id", "text", "n_chars", "first", "removed_lines"]
    found = sorted([(r.doc_id, r.text, r.n_chars, r.removed_lines) for r in got.collect()], key=repr)
    # documents of one doc_id are ordered by a hash of their text: compare those apart
    want = brute(rows, least)
    clear = lambda x: [r for r in x if r[0] != 5]
    assert clear(found) == clear(want)


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_passage(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"head {i}\n{passage}\ntail {i}", 0, "") for i in range(40)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == f"head {i}\ntail {i}" and got[i].n_chars == len(got[i].text) for i in range(1, 40))


def test_ids_that_are_strings(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(k, f"{k}\n{passage}\nend", 0, "") for k in ("b", "a", None, "10")]
    df = spark.createDataFrame(rows, SCHEMA.replace("doc_id long", "doc_id string"))
    assert {r.doc_id: r.removed_lines for r in line_dedup(df).collect()} == {None: 0, "10": 1, "a": 1, "b": 1}


def test_very_long_text(spark):
    passage = "\n".join(f"w{i} x y" for i in range(40))
    rows = [(0, "\n".join(f"own line {i}" for i in range(60_000)) + "\n" + passage, 0, ""), (1, passage + "\n" + "z " * 300_000, 0, "")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].removed_lines == 0 and got[1].removed_lines == 40 and got[1].text == "z " * 300_000
