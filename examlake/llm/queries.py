"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, packing, sharding, topk, url_filter

SHARDS = 8


def tokenizer_path(name: str = packing.VOCABULARY) -> str:
    """Where the public vocabulary files lie; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with all evidence, and all documents with theirs (text and source; their label, to which the model is fitted, is only shown)."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = language_id.fit_text_model(docs)
    of_docs = language_id.identify(language_id.document_evidence(docs, F.col("lang").alias("keep_lang")), model).withColumn("declared", F.col("keep_lang"))
    of_pages = language_id.identify(language_id.page_evidence(pages), model)
    cols = ["language", "probability", "accepted", "declared", "text_language"]
    none = F.lit(None).cast("long")
    return of_docs.select(F.col("id").alias("doc_id"), none.alias("page_id"), *cols).unionByName(
        of_pages.select(none.alias("doc_id"), F.col("id").alias("page_id"), *cols)
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placement(_table(spark, sf_dir, "documents"), sharding.grid(SHARDS))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


#: What is planted in the documents: licence lines, each a line of its own. Nothing of the scan's tables or normalising is used.
OP1_SQL = """
WITH planted(line, id, licence) AS (VALUES
    ('Licensed under the Apache License, Version 2.0.', '<apache-short>', 'Apache-2.0'), ('Released under the MIT License.', '<mit-short>', 'MIT'),
    ('This work is licensed under the GNU General Public License, version 3.', '<gpl3-short>', 'GPL-3.0'),
    ('All rights reserved.', '<reserved>', 'All-Rights-Reserved'), ('Licensed under CC BY-NC 4.0.', '<cc-by-nc-short>', 'CC-BY-NC-4.0')),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, string_agg(id, '' ORDER BY i) AS ids, array_to_string(list_sort(list_distinct(list(licence))), ';') AS licences FROM l JOIN planted ON l.line = planted.line GROUP BY 1)
SELECT d.doc_id, coalesce(f.ids, '') AS sentence_ids, coalesce(f.licences, '') AS licenses, CAST(0 AS BIGINT) AS unruled FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS (SELECT l.vec_id AS query_id, r.vec_id AS vec_id, CAST(sum(l.x * r.x) AS BIGINT) AS score
      FROM a l JOIN a r ON l.i = r.i AND l.vec_id <> r.vec_id WHERE l.vec_id % 50 = 0 GROUP BY 1, 2),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""

OP6_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * same >= 75 * (nx.n + ny.n - same)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id"""

#: Runs are compared as text here, one by one; lines as arrays of (line number, trimmed line).
OP10_SQL = """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, ln, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM raw),
l AS (SELECT doc_id, ln, t, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos, len(regexp_extract_all(t, '[^ \\t\\r\\x0b\\x0c]+')) AS w FROM t WHERE t <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM l),
b AS (SELECT *, after - w AS before FROM c),
win AS (SELECT x.doc_id, x.pos AS i, min(y.pos) AS e FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.pos >= x.pos AND y.after - x.before >= 50 GROUP BY 1, 2
        UNION SELECT y.doc_id, max(x.pos) AS i, y.pos AS e FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.pos >= x.pos AND y.after - x.before >= 50 GROUP BY y.doc_id, y.pos),
k AS (SELECT win.doc_id, i, e, string_agg(t, chr(10) ORDER BY pos) AS k FROM win JOIN l ON l.doc_id = win.doc_id AND pos BETWEEN i AND e GROUP BY 1, 2, 3),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi FROM k WINDOW o AS (PARTITION BY k ORDER BY doc_id, i)),
gone AS (SELECT DISTINCT f.doc_id, l.pos, l.ln FROM f JOIN l ON l.doc_id = f.doc_id AND l.pos BETWEEN f.i AND f.e WHERE (f.doc_id, f.i) <> (f.fd, f.fi)),
mark AS (SELECT t.doc_id, t.ln, t.t = '' AS blank, gone.ln IS NOT NULL AS gone FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.ln = t.ln),
near AS (SELECT *, last_value(CASE WHEN NOT blank THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
         first_value(CASE WHEN NOT blank THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS down FROM mark),
cut AS (SELECT doc_id, ln, gone OR (blank AND coalesce(up, false) AND coalesce(down, false)) AS cut FROM near),
out AS (SELECT raw.doc_id, coalesce(string_agg(line, chr(10) ORDER BY raw.ln) FILTER (NOT cut), '') AS text, CAST(count(*) FILTER (cut) AS INTEGER) AS removed_lines
        FROM raw JOIN cut ON cut.doc_id = raw.doc_id AND cut.ln = raw.ln GROUP BY 1)
SELECT d.doc_id, o.text, d.lang, d.source, CAST(length(o.text) AS BIGINT) AS n_chars, coalesce(o.removed_lines, 0) AS removed_lines FROM documents d LEFT JOIN out o ON o.doc_id = d.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scans": OP1_SQL,
        "op3_exact_top_k": OP3_SQL,
        "op6_exact_dedup": OP6_SQL,
        "op7_mixing": mixing.mix_sql(),
        "op8_ngram_jaccard_join": OP8_SQL,
        "op10_line_dedup": OP10_SQL,
    }
