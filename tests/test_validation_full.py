import difflib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("made, whole, partial", [("questions", "validation_issues_full", "validation_issues"), ("_dirty", "validation_faults_full", "validation_faults")])
def test_full_checks_match_brute_force(spark, made, whole, partial):
    q = getattr(queries, made)(spark, SF)
    pages = {}
    for r in queries._cache(spark, SF).select("source_file", "page_number", T.comparable(F.col("text")).alias("text")).collect():
        pages.setdefault((r.source_file, r.page_number), set()).add(r.text)
    want = Counter()
    for r in q.select("source", "page_number", "description", T.comparable(F.col("description")).alias("text")).collect():
        if (r.source, r.page_number) in pages and len(r.description) >= 20:
            near = max(difflib.SequenceMatcher(None, r.text.lower(), p.lower()).ratio() if r.text and p else 0.0 for p in pages[r.source, r.page_number])
            if near < 0.9:
                want["text_accuracy", "major" if near < 0.7 else "minor"] += 1
    assert want
    run = queries.queries()
    tally = lambda name: Counter({(r.issue_type, r.severity): r["count" if made == "questions" else "issues"] for r in (run[name](spark, SF).groupBy("issue_type", "severity").count() if made == "questions" else run[name](spark, SF)).collect()})
    want += tally(partial)
    assert tally(whole) == want
    if made == "questions":
        level = Counter()
        for (_, s), n in want.items():
            level[s] += n
        assert {r.severity: r.issues for r in run["severity_breakdown_full"](spark, SF).collect()} == level
        got, n = run["validation_scores_full"](spark, SF).first(), q.count()
        assert (got.total, got.critical, got.major, got.minor) == (n, level["critical"], level["major"], level["minor"])
        text = sum(x for (k, _), x in want.items() if k == "text_accuracy")
        assert got.accuracy == pytest.approx(max(0.0, 1 - (text + 0.1 * want["ocr_error", "minor"]) / n))
        assert got.quality == pytest.approx(max(0.0, 1 - (0.3 * level["critical"] + 0.1 * level["major"] + 0.02 * level["minor"]) / n))
