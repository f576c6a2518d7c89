"""URL filters by the ratio of two character language models.

A variable-order Markov model is fitted to accepted URLs and another to
rejected ones. Each interpolates the orders 0 to ``order``: what a longer
context has seen is mixed with the next shorter one's estimate, the more the
less it has seen. A URL is judged by the difference of the two models'
log-likelihoods divided by its length, against a threshold calibrated on
labelled URLs held out from the fit.

On tables, models and threshold come from all rows that rules decide: counts
of codes are a table, each code's share of a score is worked out where its
context's codes meet, and URLs fetch the shares of their codes by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, materialize

# The rules of the contract, as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 5
#: Orders up to which contexts are few (one byte at most) and known to every task; the codes of longer ones meet by their last two bytes.
LOW_ORDERS = 2
#: The most frequent codes, whose shares are sent to all tasks; all others are joined. Any number gives the same result.
COMMON = 1 << 16
#: Codes that a task counts together before it sends them on.
COUNTED_CODES = 1_000_000
#: Shares of a score are integers of this fraction, so a sum doesn't depend on its order.
UNIT = 2.0**-32
#: Buckets for each unit of score when the threshold is looked for; any number gives the same result.
SCORE_BUCKETS = 4096


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract defines them; both empty for a null or a string without ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "(?s)^[^/?#]*", 0))
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _codes(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All URLs' bytes, each URL's length with its end mark, and for each order k the codes of the k bytes before and the byte.

    A byte is its value plus 1, an end mark 257 and what lies before a URL 0; nine bits each, so a code is exact.
    """
    parts = [np.frombuffer(u.encode("utf-8", "replace"), np.uint8).astype(np.uint64) + np.uint64(1) for u in urls]
    pad, end = np.zeros(order, np.uint64), np.array([257], np.uint64)
    line = np.concatenate([x for p in parts for x in (pad, p, end)]) if parts else np.zeros(0, np.uint64)
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    starts = np.cumsum(lengths + order) - lengths
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if parts else np.zeros(0, np.int64)
    codes, code = [], np.zeros(len(at), np.uint64)
    for k in range(order + 1):
        code = code | (line[at - k] << np.uint64(9 * k))
        codes.append(code.copy())
    return line[at], lengths, codes


@dataclass
class MarkovModel:
    """Counts of each order's (context, byte) codes and of its contexts."""

    order: int
    joint: list[tuple[np.ndarray, np.ndarray]]
    context: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, urls: list[str], order: int = ORDER) -> "MarkovModel":
        _, _, codes = _codes(urls, order)
        return cls.of_counts([np.unique(c, return_counts=True) for c in codes], order)

    @classmethod
    def of_counts(cls, joint: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> "MarkovModel":
        """From each order's sorted codes and their counts (above 0)."""
        context = []
        for seen, n in joint:
            ctx = np.unique(seen >> np.uint64(9))
            order_ = np.argsort(seen >> np.uint64(9), kind="stable")
            cuts = np.searchsorted((seen >> np.uint64(9))[order_], ctx)
            total = np.add.reduceat(n[order_], cuts) if len(ctx) else n
            kinds = np.diff(np.append(cuts, len(seen)))
            context.append((ctx, total, kinds))
        return cls(order, joint, context)

    def scores(self, codes: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each byte (Witten-Bell interpolation down to a uniform guess)."""
        p = np.full(len(codes[0]), 1 / 257.0)
        for c, (seen, n), (ctx, total, kinds) in zip(codes, self.joint, self.context, strict=True):
            p = self._mixed(p, c, seen, n, ctx, total, kinds)
        return np.log(p)

    @staticmethod
    def _mixed(p, c, seen, n, ctx, total, kinds):
        if not len(seen):
            return p
        i = np.minimum(np.searchsorted(seen, c), len(seen) - 1)
        count = np.where(seen[i] == c, n[i], 0)
        x = c >> np.uint64(9)
        j = np.minimum(np.searchsorted(ctx, x), len(ctx) - 1)
        known = ctx[j] == x
        t, k = np.where(known, total[j], 0), np.where(known, kinds[j], 1)
        return (count + k * p) / (t + k)


def log_ratio(accepted: MarkovModel, rejected: MarkovModel, urls: list[str]) -> np.ndarray:
    """Each URL's log-likelihood difference (accepted less rejected) per byte."""
    if not urls:
        return np.zeros(0)
    _, lengths, codes = _codes(urls, accepted.order)
    diff = accepted.scores(codes) - rejected.scores(codes)
    return np.add.reduceat(diff, np.cumsum(lengths) - lengths) / lengths


@dataclass
class UrlFilter:
    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float

    @classmethod
    def fit(cls, good: list[str], bad: list[str], order: int = ORDER) -> "UrlFilter":
        """Fit to every other URL of each class; the rest set the threshold at the least sum of both error rates.

        With a class missing, everything is accepted.
        """
        a, r = MarkovModel.fit(good[::2], order), MarkovModel.fit(bad[::2], order)
        g, b = np.sort(log_ratio(a, r, good[1::2] or good)), np.sort(log_ratio(a, r, bad[1::2] or bad))
        if not len(g) or not len(b):
            return cls(a, r, -np.inf)
        cuts = np.unique(np.concatenate([g, b]))
        loss = np.searchsorted(g, cuts) / len(g) + 1 - np.searchsorted(b, cuts) / len(b)
        return cls(a, r, float(cuts[np.argmin(loss)]))

    def accepts(self, urls: list[str]) -> np.ndarray:
        return log_ratio(self.accepted, self.rejected, urls) >= self.threshold


#: The groups that codes are counted in: verdict and half of the URLs.
GROUPS = ("allow_0", "allow_1", "block_0", "block_1")


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their n, where above 0."""
    seen, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, n, len(seen)).astype(np.int64)
    return seen[total > 0], total[total > 0]


def code_counts(urls: DataFrame) -> DataFrame:
    """code, n and a count for each of GROUPS of all codes of the highest order in urls (url, verdict, half); n counts URLs of no verdict, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(3)).view(np.int64)), pa.array((keys & np.uint64(7)).astype(np.int32)), pa.array(counts)], ["code", "kind", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                url, verdict, half = (c.to_pylist() for c in batch.slice(at, 2048).columns)
                kind = np.array([len(GROUPS) if v is None else GROUPS.index(f"{v}_{h}") for v, h in zip(verdict, half, strict=True)], np.uint64)
                _, lengths, codes = _codes(url, ORDER)
                more, n = np.unique((codes[ORDER] << np.uint64(3)) | np.repeat(kind, lengths), return_counts=True)
                keys, counts = _added(np.concatenate([keys, more]), np.concatenate([counts, n]))
                if len(keys) >= COUNTED_CODES:
                    yield sent()
                    keys, counts = keys[:0], counts[:0]
        yield sent()

    kinds = urls.select("url", "verdict", "half").mapInArrow(run, "code long, kind int, n long")
    return kinds.groupBy("code").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(g) for i, g in enumerate(GROUPS)])


def code_shares(counts: DataFrame) -> DataFrame:
    """code, n, whole, without_0, without_1: what a code adds to a URL's score under the models of all URLs, and of those that aren't of a half, in UNIT.

    Codes of one context lie in one task, as they meet by its last two bytes;
    the orders below have 2^18 codes at most, whose counts all tasks get.
    """
    spark = counts.sparkSession
    low_code = F.col("code").bitwiseAND((1 << 9 * LOW_ORDERS) - 1).alias("code")
    low = counts.groupBy(low_code).agg(*[F.sum(g).alias(g) for g in GROUPS]).toArrow()
    shared = spark.sparkContext.broadcast([low.column(c).to_numpy() for c in ("code", *GROUPS)])
    models = {"whole": (0, 1), "without_0": (1,), "without_1": (0,)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        here = [np.concatenate([b.column(i).to_numpy() for b in found]) for i in range(2 + len(GROUPS))]
        own, out = here[0].view(np.uint64), []
        masks = [np.uint64((1 << 9 * (k + 1)) - 1) for k in range(ORDER + 1)]
        for halves in models.values():
            log_p = {}
            for v in ("allow", "block"):
                rows = [1 + GROUPS.index(f"{v}_{h}") for h in halves]
                near, few = sum(here[1 + i] for i in rows), sum(shared.value[i] for i in rows)
                joint = [_added(shared.value[0].astype(np.uint64) & m, few) if k < LOW_ORDERS else _added(own & m, near) for k, m in enumerate(masks)]
                log_p[v] = MarkovModel.of_counts(joint).scores([own & m for m in masks])
            out.append(np.rint((log_p["allow"] - log_p["block"]) / UNIT).astype(np.int64))
        for at in range(0, len(own), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (here[0], here[1], *out)], ["code", "n", *models])

    ends = F.shiftright("code", 9).bitwiseAND((1 << 18) - 1)
    return counts.repartition(ends).mapInArrow(run, "code long, n long, whole long, without_0 long, without_1 long")


def url_scores(urls: DataFrame, shares: DataFrame) -> DataFrame:
    """uid, score, held_out for all urls (url, half, uid): the score under the models of all URLs, and under those that lack the URL's half."""
    top = shares.orderBy(F.col("n").desc(), "code").limit(COMMON).orderBy("code").toArrow()
    shared = urls.sparkSession.sparkContext.broadcast([top.column(c).to_numpy() for c in ("code", "whole", "without_0", "without_1")])  # COMMON rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, whole, *without = shared.value
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                half = part.column(1).to_numpy()
                _, lengths, codes = _codes(part.column(0).to_pylist(), ORDER)
                code, of, begin = codes[ORDER].view(np.int64), np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                common = known[at] == code
                sums = [np.add.reduceat(np.where(common, x, 0), begin) for x in (whole[at], np.where(half[of] == 0, without[0][at], without[1][at]))]
                uid, rest = part.column(2).to_numpy(), ~common
                some = np.concatenate([np.full(len(uid), -1), code[rest]])
                more = np.zeros(int(rest.sum()), np.int64)
                cols = (np.concatenate([uid, uid[of[rest]]]), some, np.concatenate([half, half[of[rest]]]), *(np.concatenate([x, more]) for x in sums), np.concatenate([lengths, more]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["uid", "code", "half", "whole", "held_out", "length"])

    each = materialize(urls.select("url", "half", "uid").mapInArrow(run, "uid long, code long, half int, whole long, held_out long, length long"), "url-codes")
    own = F.when(F.col("half") == 0, F.col("s.without_0")).otherwise(F.col("s.without_1"))
    rest = each.alias("e").filter("code >= 0").join(shares.alias("s"), "code").select("uid", F.col("s.whole").alias("whole"), own.alias("held_out"), "length")
    total = each.filter("code < 0").select("uid", "whole", "held_out", "length").unionByName(rest).groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("whole", "held_out", "length")])
    return total.select("uid", *[(F.col(c) * F.lit(UNIT) / F.col("length")).alias(n) for c, n in (("whole", "score"), ("held_out", "held_out"))])


def best_threshold(scores: DataFrame) -> float:
    """The least score of scores (score, verdict) with the least sum of both verdicts' error rates, if URLs are accepted from it on; -inf if a verdict is missing.

    Scores are summed up in buckets, and only within a bucket put in order.
    """
    n = F.sum((F.col("verdict") == "allow").cast("long")).alias("g"), F.sum((F.col("verdict") == "block").cast("long")).alias("b")
    each = scores.groupBy("score").agg(*n).withColumn("bucket", F.floor(F.col("score") * SCORE_BUCKETS))
    hist = sorted(each.groupBy("bucket").agg(F.sum("g"), F.sum("b")).collect())
    good, bad = sum(h[1] for h in hist), sum(h[2] for h in hist)
    if not good or not bad:
        return -np.inf
    before, g, b = [], 0, 0
    for h in hist:
        before.append((h[0], g, b))
        g, b = g + h[1], b + h[2]
    starts = scores.sparkSession.createDataFrame(before, "bucket long, g_before long, b_before long")
    below = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.col("g_before") + F.coalesce(F.sum("g").over(below), F.lit(0))
    caught = F.col("b_before") + F.coalesce(F.sum("b").over(below), F.lit(0))
    # both rates over one denominator, in integers: a tie is a tie
    loss = (lost.cast("decimal(19,0)") * F.lit(bad).cast("decimal(19,0)") - caught.cast("decimal(19,0)") * F.lit(good).cast("decimal(19,0)")).alias("loss")
    return each.join(F.broadcast(starts), "bucket").select(loss, "score").agg(F.min(F.struct("loss", "score")).alias("m")).first().m.score


def fitted_scores(ruled: DataFrame) -> tuple[DataFrame, float]:
    """url, score of all distinct urls of ruled (url, verdict; null: "" and none), and the threshold.

    Models are fitted to all URLs with a verdict. The threshold is that of
    their scores under models fitted to the other half of them.
    """
    urls = ruled.select(F.coalesce("url", F.lit("")).alias("url"), "verdict").distinct()
    urls = urls.withColumn("half", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")).withColumn("uid", F.monotonically_increasing_id())
    urls = materialize(urls, "urls")
    shares = materialize(code_shares(materialize(code_counts(urls), "url-code-counts")), "url-code-shares")
    if shares.isEmpty():
        return urls.select("url", F.lit(0.0).alias("score")), -np.inf
    scores = materialize(urls.join(url_scores(urls, shares), "uid").select("url", "verdict", "score", "held_out"), "url-scores")
    return scores.select("url", "score"), best_threshold(scores.filter("verdict IS NOT NULL").select(F.col("held_out").alias("score"), "verdict"))


def judge_urls(pages: DataFrame, rules=RULES, model: UrlFilter | None = None, batch_rows: int = 4096) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages.

    The longest fitting rule decides; without one, the model does. By default
    the model learns from all rows that rules decide. A null url has empty host
    and path, no rule and the model's verdict on an empty URL. score is the
    model's length-normalised log-likelihood difference, for all rows. Repeated
    rows repeat; an empty table gives an empty result; other columns aren't read.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("verdict", verdict)
    if model is None:
        scores, threshold = fitted_scores(ruled)
        of_model = F.when(F.col("score") >= F.lit(float(threshold)), "allow").otherwise("block")
        judged = ruled.withColumn("u", F.coalesce("url", F.lit(""))).join(scores.withColumnRenamed("url", "u"), "u")
        return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", of_model).alias("verdict"), "score")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                b = batch.slice(at, batch_rows)
                urls = [u or "" for u in b.column("url").to_pylist()]
                score = log_ratio(m.accepted, m.rejected, urls)
                own = np.where(score >= m.threshold, "allow", "block")
                verdicts = [v or o for v, o in zip(b.column("verdict").to_pylist(), own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdicts, pa.string()), pa.array(score, pa.float64())],
                    ["page_id", "host", "path", "rule", "verdict", "score"],
                )

    kind = ruled.schema["page_id"].dataType.simpleString()
    return ruled.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
