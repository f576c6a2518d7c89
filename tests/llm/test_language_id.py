import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from examlake.llm.language_id import TextModel, accepted_documents, document_evidence, fit_text_model, identify, page_evidence

SCHEMA = "doc_id long, text string, lang string, source string, mean string"
WORDS = {"en": "the of and to in that it is was for with".split(), "de": "der die und zu den das nicht von sie ist mit".split(), "fr": "de la le et les des en un du une que".split()}


def docs(n=240, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 30))), lang, f"s{i % 4}.example.com", "x"))
    return rows


def test_held_out_accuracy(spark):
    rows = docs()
    model = fit_text_model(spark.createDataFrame(rows[:120], SCHEMA), 40)
    assert model.languages == ["de", "en", "fr"]
    got = {r.id: r for r in identify(document_evidence(spark.createDataFrame(rows[120:], SCHEMA)), model).collect()}
    assert sum(got[r[0]].text_language == r[2] for r in rows[120:]) >= 115
    assert all(got[r[0]].language == r[2] and got[r[0]].accepted for r in rows[120:])


def test_every_label_is_fitted(spark):
    rows = [(100 * k + i, f"common words {chr(97 + k % 26) * 3}{chr(97 + k // 26) * 4} {i}", f"l{k:02}", "s", "x") for k in range(70) for i in range(2)]
    rows.append((9999, "lange texte sind auch texte " * 1000, "zz", "s", "x"))  # all of its rows are long
    model = fit_text_model(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == [f"l{k:02}" for k in range(70)] + ["zz"]
    mean, _ = model.scores(pa.array([r[1] for r in rows]))
    assert [model.languages[i] for i in mean[:, :-1].argmax(axis=1)] == [r[2] for r in rows]


def test_copies_fill_no_sample(spark):
    rows = [(i, f"text {i}", "en", "s", "x") for i in range(20)]
    by_hash = spark.createDataFrame(rows, SCHEMA).orderBy(F.xxhash64("text")).collect()
    rows += [(100 + i, by_hash[0].text, "en", "s", "x") for i in range(50)]
    model = fit_text_model(spark.createDataFrame(rows, SCHEMA), 10)
    want = TextModel.fit([(r.text, "en") for r in by_hash[:10]])
    assert (model.log_prob == want.log_prob).all()


def test_edge_cases(spark):
    rows = docs(60) + [(100, None, "en", "s1", ""), (101, "", None, None, ""), (102, "123 456 !!", "de", "s1", ""), (103, "the of and to", None, None, ""), (3, "und der die", "de", "s2", ""), (None, "le la les des", "fr", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_text_model(df)
    got = identify(document_evidence(df), model)
    assert got.count() == len(rows)
    by = {r.id: r for r in got.collect()}
    assert not by[100].accepted and not by[101].accepted and not by[102].accepted
    assert by[103].accepted and by[103].language == "en" and by[None].language == "fr"
    kept = accepted_documents(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    none = spark.createDataFrame([], SCHEMA)
    assert identify(document_evidence(none), model).count() == 0
    assert fit_text_model(none).languages == []


def test_pages_fuse_evidence(spark):
    model = TextModel.fit([(t, x) for _, t, x, _, _ in docs(100)])
    page = lambda i, lang, text, host: (i, f"http://{host}/p{i}", f'<html lang="{lang}"><style>das ist</style><p>{text}</p></html>' if text is not None else None)
    rows = [page(i, "de", "und der die das nicht von sie mit", "a.site.de") for i in range(30)] + [page(i + 30, "en", "the of and that was with for", "b.site.org") for i in range(30)]
    rows += [page(60, "de", "in", "a.site.de"), page(61, "en", None, "b.site.org"), (62, None, "<p>the of and that</p>")]
    got = {r.id: r for r in identify(page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")), model).collect()}
    assert all(got[i].language == ("de" if i < 30 else "en") for i in range(60))
    assert got[60].language == "de" and got[62].language == "en" and not got[61].accepted


def fused(pages, model, most=64.0, smooth=5.0):
    """Posterior of every language for rows (id, text, declared, host, suffix), by plain counting."""
    langs = range(len(model.languages))
    mean, letters = model.scores(pa.array([p[1] for p in pages]))
    guess = [int(np.argmax(m[:-1])) if k else None for m, k in zip(mean, letters)]
    count = lambda at, value: [sum(g == i for p, g in zip(pages, guess) if value is None or at(p) == value) for i in langs]
    parent = lambda h: h and ".".join(h.split(".")[-2:])
    seen = count(None, None)
    base = [(x + 1) / (sum(seen) + len(seen)) for x in seen]
    out = {}
    for p, m, k in zip(pages, mean, letters):
        score = [m[i] * min(k, most) for i in langs] if k else [0.0 for _ in langs]
        for column in (2, 4):
            own = count(lambda r: r[column], p[column]) if p[column] else []
            if sum(own):
                share = (sum(own) + 1) / (sum(seen) + 1)
                score = [s + math.log((own[i] + smooth * share) / (seen[i] + smooth)) for i, s in zip(langs, score)]
        own = count(lambda r: r[3], p[3]) if p[3] else []
        up = count(lambda r: parent(r[3]), parent(p[3])) if p[3] else []
        prior = base
        if sum(own):
            prior = [(own[i] + smooth * (up[i] + smooth * base[i]) / (sum(up) + smooth)) / (sum(own) + smooth) for i in langs]
        score = [s + math.log(x) for s, x in zip(score, prior)]
        top = max(score)
        out[p[0]] = (model.languages[score.index(top)], 1 / sum(math.exp(s - top) for s in score))
    return out


@pytest.mark.parametrize("most", [64.0, 3.0])
def test_the_posterior_is_that_of_plain_counting(spark, most):
    rng = random.Random(2)
    model = TextModel.fit([(t, x) for _, t, x, _, _ in docs(100)])
    pages = []
    for i in range(150):
        lang = rng.choice(sorted(WORDS))
        text = rng.choice([" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 9))), "12", "", None])
        host = rng.choice(["a.x.de", "b.x.de", "x.de", "c.y.org", "y.org", "z", None])
        pages.append((i, text, rng.choice([lang, "en", "xx", None]), host, host.split(".")[-1] if host and "." in host else None))
    want = fused(pages, model, most)
    got = identify(spark.createDataFrame(pages, "id long, text string, declared string, host string, suffix string"), model, most_evidence=most).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.language, round(r.probability, 9)) == (want[r.id][0], round(want[r.id][1], 9))


def test_scores_of_slices():
    model = TextModel.fit([(t, x) for _, t, x, _, _ in docs(50)])
    texts = pa.array(["the of", None, "", "und der", "é"])
    whole, _ = model.scores(texts)
    for i in range(len(texts)):
        assert (model.scores(texts.slice(i, 1))[0][0] == whole[i]).all()
