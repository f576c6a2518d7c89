import numpy as np
from pyspark.sql import functions as F

from examlake.llm import url_filter
from examlake.llm.url_filter import MarkovModel, UrlFilter, _codes, judge_urls, log_ratio

SCHEMA = "page_id long, url string, host string, verdict string"
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[:cut]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_rules(spark):
    urls = [
        None, "", "no url", "://", "http://", "http://COM/", "http://com", "https://a.EXAMPLE.com/en/1?x#y", "http://www.example.com/en/", "http://x.www.example.com/en/a", "http://www.example.com/de/",
        "http://example.com/en", "http://aexample.com/en/", "ftp://a.net/es/", "http://a.net/fr/x", "http://a.net/de/", "http://net?/es/", "http://a.org#://b.net/es/", "a://b://c.com/", "http://é.com/ä\x00b/?q",
    ]
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(0, urls[7], "", ""), (None, urls[7], "", "")]
    got = {(r.page_id, r.host, r.path): r for r in judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, u, _, _ in rows:
        host, path, rule = brute(u)
        r = got[(i, host, path)]
        assert r.rule == rule and (r.verdict == RULES[rule] if rule else r.verdict in ("allow", "block"))


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_model_is_a_distribution():
    m = MarkovModel.fit(["abab", "abba", ""], 3)
    total = 0.0
    for x in [bytes([b]).decode("latin-1") for b in range(128)] + [""]:
        _, lengths, codes = _codes(["ab" + x] if x else ["ab"], 3)
        total += np.exp(m.scores(codes)[2])
    assert 0.4 < total <= 1.0 + 1e-9


def test_held_out_accuracy():
    rng = np.random.default_rng(0)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    good = [f"https://{word('abcde')}.org/{word('abcde')}" for _ in range(600)]
    bad = [f"http://{word('xyzab')}-win.org/{word('xyz')}" for _ in range(600)]
    f = UrlFilter.fit(good[:400], bad[:400])
    assert f.accepts(good[400:]).mean() > 0.97 and f.accepts(bad[400:]).mean() < 0.03
    assert f.accepts([]).tolist() == [] and UrlFilter.fit([], []).accepts(["x"]).all() and UrlFilter.fit(good, []).accepts(["x"]).all()
    assert abs(log_ratio(f.accepted, f.accepted, good)).max() == 0


def test_models_and_threshold_come_from_all_ruled_urls(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    urls = [f"http://{word('abcde')}.com/{word('abé')}" for _ in range(150)] + [f"http://{word('cdxyz')}.net/es/{word('xyzb')}" for _ in range(90)] + [f"http://{word('abcdexyz')}.org/{word('abxy')}" for _ in range(80)]
    rows = [(i, u, "", "") for i, u in enumerate([*urls, "", None, *urls[100:200]])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    half = {r.url: r.h for r in df.select("url", F.pmod(F.xxhash64("url"), F.lit(2)).alias("h")).collect()}
    ruled = {v: sorted({u for u in urls if RULES.get(brute(u)[2]) == v}) for v in ("allow", "block")}
    fit = lambda h: [MarkovModel.fit([u for u in ruled[v] if half[u] != h]) for v in ("allow", "block")]
    held = {h: fit(h) for h in (0, 1)}
    scores = {v: np.array([log_ratio(*held[half[u]], [u])[0] for u in ruled[v]]) for v in ruled}
    cuts = np.unique(np.concatenate(list(scores.values())))
    cut = min(cuts, key=lambda c: (round((scores["allow"] < c).mean() + (scores["block"] >= c).mean(), 9), c))
    whole = fit(None)
    for common, buckets in ((1 << 16, 4096), (5, 1)):
        monkeypatch.setattr(url_filter, "COMMON", common)
        monkeypatch.setattr(url_filter, "SCORE_BUCKETS", buckets)
        got = judge_urls(df).collect()
        assert len(got) == len(rows)
        for r in got:
            score, rule = log_ratio(*whole, [rows[r.page_id][1] or ""])[0], brute(rows[r.page_id][1])[2]
            assert abs(r.score - score) < 1e-8 and r.verdict == (RULES[rule] if rule else "allow" if score >= cut else "block")
