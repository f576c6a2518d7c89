"""Exam pages made of base columns, so that what is parsed can be held against those columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One page per part: a header, a marker with topic, a noisy description, two or four options, an optional vote, two comments.
PAGES_SQL = """
SELECT concat('Questions_', CAST(p_partkey % 13 + 1 AS STRING), '.pdf') AS source_file,
       CAST(p_partkey AS INT) + 1 AS page_number,
       concat('Header line with enough characters ', p_brand, chr(10),
              'Question #', CAST(p_partkey AS STRING), ' Topic ', CAST(p_size % 5 + 1 AS STRING), chr(10), chr(10),
              'Your team must ConKgure traOc for ', p_name, ' in region ', p_type, '. What should they do?', chr(10),
              'A. Deploy ', p_type, chr(10), 'B. Migrate ', p_name, chr(10),
              CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('C. ~/b', chr(10), 'D. Retain ', p_brand, chr(10)) END,
              CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('Selected Answer: ', substr('ABCD', CAST(p_partkey % 4 AS INT), 1), chr(10)) END,
              'user_', CAST(p_size AS STRING), ' ', CAST(p_size % 11 + 1 AS STRING), ' months ago', chr(10),
              'upvoted ', CAST(p_size AS STRING), ' times') AS raw_text
FROM {part}
"""

#: Two questions on each page.
DOUBLE_SQL = """
SELECT concat('Questions_', CAST(s_suppkey % 5 + 1 AS STRING), '.pdf') AS source_file,
       CAST(s_suppkey AS INT) + 1 AS page_number,
       concat('Question #', CAST(s_suppkey AS STRING), ' Topic 1', chr(10),
              'A first supplier asks how ', s_name, ' should store its archive data.', chr(10),
              'A. Keep one copy', chr(10), 'B. Keep two copies', chr(10), 'Highly Voted: B', chr(10),
              'Question # ', CAST(s_suppkey + 100000 AS STRING), ' Topic 2', chr(10),
              'A second supplier asks how ', s_name, ' should encrypt its archive data.', chr(10),
              'A. Use managed keys', chr(10), 'B. Use own keys', chr(10), 'C. Use no keys', chr(10), 'Most Recent', chr(10), 'C. because') AS raw_text
FROM {supplier}
"""


def exam_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, page_number, raw_text made of the table part; spread over tasks, as the table is one small file."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return spark.sql(PAGES_SQL, part=spread(part))


def double_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOUBLE_SQL, supplier=spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")))


def spread(df: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows dealt to all cores if the table has fewer partitions than they are; left alone otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *columns) if df.rdd.getNumPartitions() < cores else df
