import hashlib
import math
import random

import corpus_pipeline
from examlake.llm.mixing import SEED
from examlake.llm.queries import tokenizer_path
from examlake.llm.tokens import WordEncoder

from .test_jaccard_join import brute as brute_groups
from .test_line_dedup import brute as brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in that it is was for with by from this are".split(), "de": "der die und zu den das nicht von sie ist mit auf dem ein".split()}


def corpus():
    rng = random.Random(5)
    passage = " ".join(rng.choice(WORDS["en"]) + str(i) for i in range(60))
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        text = [rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing"]) for _ in range(rng.randint(20, 80))]
        if i % 10 == 9:
            base = rows[i - 6][1].split("\n")[0].split(" ")
            text = base[:-1] + ["edited"]
        body = " ".join(text) + (f"\n{passage}\nend of {i}" if i % 7 == 1 else "")
        rows.append((i, body, lang, f"s{i % 2}", len(body)))
    rows += [(100, "12345 67890 !!", "en", "s0", 14), (101, None, "en", "s1", 0), (102, passage, "en", "s1", len(passage))]
    return rows


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def copies(doc_id, rate):
    u, k, p = draw(SEED, doc_id, 1), 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_matches_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if r[0] not in (100, 101)]  # without a letter
    lines = {r[0]: r[1] for r in brute_lines(kept, 50)}
    kept = [(i, lines[i], lang, s, 0) for i, t, lang, s, _ in kept if lines[i].strip() or lines[i] == t]
    groups = {r[0]: r[2] for r in brute_groups(kept)}
    kept = [r for r in kept if groups[r[0]] == r[0]]
    assert 102 not in {r[0] for r in kept} and len(kept) < 61
    size = {s: sum(len(r[1]) for r in kept if r[3] == s) for s in ("s0", "s1")}
    encoder = WordEncoder(tokenizer_path())
    tokens = {}
    for i, text, _, source, _ in kept:
        n = len(encoder.tokenizer.encode(text, add_special_tokens=False).ids) + 1
        tokens[i] = (n, n * copies(i, sum(size.values()) / 2 / size[source]))
    found = {}
    for r in got:
        assert r.doc_tokens == tokens[r.doc_id][0]
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == {i: total for i, (_, total) in tokens.items() if total}


def test_stages_return_documents(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
