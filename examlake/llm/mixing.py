"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share of the corpus divided
by its present share. Each row draws a hash-seeded uniform number, which the
source's inverted Poisson distribution turns into a count of copies; the rows
are exploded by it and all copies are shuffled into one global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEED = 7
#: A mean above this is drawn as the sum of several smaller Poisson draws, since exp(-mean) runs out of digits.
LARGEST_MEAN = 256.0
#: Copies of a row that one task makes at a time.
COPIES_PER_TASK = 10_000


def md5_unit(*parts: Column) -> Column:
    """A number from [0, 1) with 52 bits, from the parts' MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative probability is above u; the table ends where the tail is below 1e-17."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(20.0)).cast("int")
    terms = F.transform(F.sequence(F.lit(1), last), lambda k: k.cast("double"))
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.when(u < F.exp(-mean), 0).otherwise(1).alias("k"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        c = a["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (a["k"] + F.when(u < c, 0).otherwise(1)).alias("k"))

    return F.aggregate(terms, zero, step, lambda a: a["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0) -> DataFrame:
    """source, rate: the mean number of copies of a source's documents.

    Shares are counted in characters. weights gives the target weights (sources
    that it doesn't name get 0; a negative one is an error; without a positive
    one nothing is kept); None gives all sources one weight. total is the
    expected size of the result as a multiple of the input. A source with a
    weight but without any character has rate total.
    """
    if weights and min(weights.values()) < 0:
        raise ValueError("weights must not be negative")
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        size = size.withColumn("weight", F.lit(1.0))
    else:
        named = F.lit(0.0)
        for k, v in weights.items():
            named = F.when(F.col("source") == k, F.lit(float(v))).otherwise(named)
        size = size.withColumn("weight", named)
    size = materialize(size, "sources")
    chars, weight = size.filter("chars > 0").agg(F.sum("chars"), F.sum("weight")).first()
    return size.select(
        "source",
        F.when(F.col("weight") <= 0, F.lit(0.0))
        .when(F.col("chars") > 0, F.lit(chars or 0.0) * F.lit(float(total)) * F.col("weight") / F.lit(weight or 1.0) / F.col("chars"))
        .otherwise(F.lit(float(total)))
        .alias("rate"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: int = SEED, copies_per_task: int = COPIES_PER_TASK) -> DataFrame:
    """Every column of docs, and copy (from 1) and order_key, in the order of order_key over the whole result.

    The count of copies depends on doc_id, seed and the source's rate alone:
    repeated rows of one doc_id get one count. A null source is a source like
    others; a null doc_id draws as an empty one; null and empty texts take part.
    Copies are made in blocks of copies_per_task; where a source's rate is
    above that, blocks are dealt to tasks first. Columns of docs named copy or
    order_key are replaced. An empty table gives an empty result.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}  # names that clash with none of the operator's
    row = docs.toDF(*own.values())
    doc_id, source = F.col(own["doc_id"]), F.col(own["source"])
    rate = rates(docs, weights, total).select(F.col("source").alias("rate_of"), "rate")
    highest = rate.agg(F.max("rate")).first()[0] or 0.0
    row = row.join(rate, source.eqNullSafe(F.col("rate_of")), "left").filter("rate > 0")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN).cast("int"))
    one = lambda i: poisson_inverse(md5_unit(F.lit(seed), doc_id, i), F.col("rate") / parts)
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0), lambda a, x: a + x)
    row = row.withColumn("copies", copies).filter("copies > 0")
    blocks = row.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("copies"), F.lit(copies_per_task))))
    if highest > copies_per_task:
        blocks = blocks.repartition(n, F.xxhash64(doc_id, "block"))
    last = F.least(F.col("block") + copies_per_task - 1, F.col("copies"))
    row = blocks.withColumn("copy", F.explode(F.sequence(F.col("block"), last)))
    keep = [F.col(own[c]).alias(c) for c in docs.columns if c not in ("copy", "order_key")]
    key = md5_unit(F.lit(f"order{seed}"), doc_id, F.col("copy"))
    out = row.select(*keep, F.col("copy").cast("int").alias("copy"), key.alias("order_key"))
    # order_key is uniform, so equal ranges of it are equal parts, in order; nothing is sampled
    return out.repartitionById(n, F.floor(F.col("order_key") * n).cast("int")).sortWithinPartitions("order_key")


def mix_sql(seed: int = SEED) -> str:
    """mix() of ``documents`` with its defaults in DuckDB's SQL (rates below LARGEST_MEAN)."""
    unit = "CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT) / 4503599627370496.0"
    return f"""
WITH size AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
whole AS (SELECT sum(chars) AS all_chars, CAST(count(*) AS DOUBLE) AS all_weight FROM size WHERE chars > 0),
rate AS (SELECT source, CASE WHEN chars > 0 THEN all_chars / all_weight / chars ELSE 1.0 END AS rate FROM size, whole),
cdf AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
        FROM rate, range(0, 400) AS t(k)),
draw AS (SELECT d.*, {unit.format(f"'{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|1'")} AS u FROM documents d),
n AS (SELECT doc_id, any_value(source) AS source, (SELECT count(*) FROM cdf WHERE cdf.source = draw.source AND c <= u) AS copies, lang, text, n_chars
      FROM draw GROUP BY doc_id, source, u, lang, text, n_chars)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       {unit.format(f"'order{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy")} AS order_key
FROM n, LATERAL (SELECT unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy)"""
