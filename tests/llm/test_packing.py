import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from examlake.llm.packing import Bm25Index, Corpus, counted, fill_windows, pack, powers_of_two
from examlake.llm.queries import tokenizer_path
from examlake.llm.tokens import WordEncoder

SCHEMA = "doc_id long, text string, shard string, length string"


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(tokenizer_path())


def direct(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aB'sl. ,\n\t1é<|endoftext|>…İΣς\u0301\u00a0", max_size=40)), max_size=4))
def test_ids_are_the_tokenizer_s(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [direct(encoder, t) for t in texts]


def test_round_trip(spark, encoder):
    rng = random.Random(0)
    words = "the of and retrieval packing window tokens licence corpus é 12 don't".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(150)] + ["long text, " * 3000, "", None, " \n"]
    rows = [(i, t, "s", "l") for i, t in enumerate(texts)]
    got = pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), window=128, shard_docs=40, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t, _, _ in rows:
        own = sorted(pieces[i], key=lambda r: r.start)
        ids = [x for r in own for x in r.ids]
        assert ids == direct(encoder, t or "") + [1] and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert {r.doc_tokens for r in own} == {len(ids)}
    for s in sequences.values():
        s = sorted(s, key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        size = sum(r.length for r in s)
        assert size <= 128 and size & (size - 1) == 0
    slim = pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), window=128, shard_docs=40)
    assert slim.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sum(r.length for r in slim.collect()) == sum(r.length for r in got)


def test_repeated_rows_and_empty_table(spark):
    got = pack(spark.createDataFrame([(1, "a b", "", "")] * 3 + [(None, "c", "", "")], SCHEMA), tokenizer_path()).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 9 and sum(r.length for r in got if r.doc_id is None) == 2
    assert pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_neighbours_come_first():
    a, b = [np.array([1, 2, 3, 4, 5, 9]) for _ in range(3)], [np.array([11, 12, 13, 14, 15, 9]) for _ in range(3)]
    docs = [x for pair in zip(a, b) for x in pair]
    scores = Bm25Index(docs).scores(0)
    assert min(scores[[0, 2, 4]]) > max(scores[[1, 3, 5]])
    windows = fill_windows(docs, 18)
    assert [sorted({d % 2 for d, _, _ in w}) for w in windows] == [[0], [1]]


def test_weights_know_all_documents():
    docs = [np.array(x) for x in ([1, 2, 9], [1, 3, 9], [1, 1, 4, 9], [5, 6, 7, 8, 9])]
    corpus = Corpus(4, 3.75, np.bincount([1, 2, 9, 1, 3, 9, 1, 4, 9, 5, 6, 7, 8, 9]))
    assert np.allclose(Bm25Index(docs[:2], corpus=corpus).scores(0), Bm25Index(docs).scores(0)[:2])
    tails = [d[-1:] for d in docs]
    assert np.allclose(Bm25Index(tails, held=(*counted(docs), np.array([3, 3, 4, 5]))).scores(0), Bm25Index(docs).scores(0))


def test_near_documents_meet_beyond_a_shard(spark):
    rng = random.Random(1)
    words = [a + b + c for a in "bdgklmnprst" for b in "aeiou" for c in "bdgklmnprst"]
    rows = []
    for i in range(100):
        text = [rng.choice(words) for _ in range(40)]
        rows += [(i, " ".join(text), "", ""), (100 + i, " ".join(text[:-1] + [rng.choice(words)]), "", "")]
    sequences = {}
    for r in pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), window=512, shard_docs=20).collect():
        sequences.setdefault(r.doc_id, set()).add(r.sequence_id)
    assert len(sequences) == 200
    assert sum(bool(sequences[i] & sequences[100 + i]) for i in range(100)) >= 60


def test_powers_of_two():
    out = powers_of_two([(0, 3, 10), (1, 0, 6)])
    assert [sum(b - a for _, a, b in s) for s in out] == [8, 4, 1]
    assert [p for s in out for p in s] == [(0, 3, 10), (1, 0, 1), (1, 1, 5), (1, 5, 6)]
