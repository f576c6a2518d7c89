"""Sources: page tables, PDF files through a plug-in, and JSON documents."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.text import clean_page
from ..schemas import WEB, WEB_QUESTION

#: Decodes a PDF file's bytes: strategy -> the texts of its pages, or the exception that a page raised. No decoder is bundled.
Decoder = Callable[[bytes], dict[str, list[str | Exception]]]


def read_page_table(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """source_file, page_number, raw_text, text of a Parquet page table; optionally pages first+1 to last (0-based, half open)."""
    return with_text(spark.read.parquet(path), first, last)


def with_text(pages: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages with a cleaned text; pages without any raw text are left out."""
    if first is not None:
        pages = pages.filter(F.col("page_number") > first)
    if last is not None:
        pages = pages.filter(F.col("page_number") <= last)
    pages = pages.filter(F.coalesce("raw_text", F.lit("")) != "")
    return pages.select("source_file", "page_number", "raw_text", clean_page(F.col("raw_text")).alias("text"))


def read_text_pages(spark: SparkSession, folder: str, glob: str = "*.txt", page_break: str = "\f") -> DataFrame:
    """Pages of text files, parted by form feeds."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), "value")
    pages = files.select("source_file", F.posexplode(F.split("value", page_break)).alias("at", "raw_text"))
    return with_text(pages.select("source_file", (F.col("at") + 1).alias("page_number"), "raw_text"))


def read_pdf_cache(spark: SparkSession, folder: str, decoder: Decoder, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(cache, errors): source_file, page_number, strategy, text of all PDF files, and source_file, page_number (0: the file), error of what can't be decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", config.file_glob).load(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    found = [(i + 1, s, t) for s, texts in decoder(bytes(content)).items() for i, t in enumerate(texts)]
                    rows = [(name, i, s, "", f"{type(t).__name__}: {t}") if isinstance(t, Exception) else (name, i, s, t, None) for i, s, t in found]
                except Exception as e:
                    rows = [(name, 0, "", "", f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["source_file", "page_number", "strategy", "text", "error"])

    rows = files.select("path", "content").mapInPandas(run, "source_file string, page_number int, strategy string, text string, error string")
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("source_file", "page_number", "error")


def pages_of_cache(cache: DataFrame, strategy: str = "default") -> DataFrame:
    """Page rows of one strategy of a cache."""
    return with_text(cache.filter(F.col("strategy") == strategy).select("source_file", "page_number", F.col("text").alias("raw_text")))


def read_web_json(spark: SparkSession, path: str) -> DataFrame:
    """id, number, description, options (map), answers, claude_reasoning, metadata of a web document; a missing list gives no row.

    A document is one file, or a folder as write_web() makes it, whose question lines are read in parallel.
    """
    if _is_folder(spark, f"{path}/part=1"):
        lines = spark.read.text(f"{path}/part=1").select(F.from_json(F.regexp_replace("value", "^,", ""), WEB_QUESTION).alias("q"))
        return lines.select("q.*")
    doc = spark.read.schema(WEB).option("multiLine", True).json(path)
    return doc.select(F.explode("questions").alias("q")).select("q.*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """status, file, line: every line that a reader of the whole document gets (status 200), or one row of status 404."""
    if not _is_folder(spark, path):
        return spark.createDataFrame([(404, None, f"not found: {path}")], "status int, file string, line string")
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.lit(200).alias("status"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("line"))


def read_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document (a configuration, templates) from any file system; {} and a warning where it is missing."""
    if not _is_folder(spark, path):
        warnings.warn(f"no such document: {path}; defaults are used", stacklevel=2)
        return {}
    text = spark.read.option("wholetext", True).text(path).agg(F.array_join(F.collect_list("value"), "")).first()[0]
    return json.loads(text) if text else {}


def read_json_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): JSON lines that fit the schema, and those that don't as strings."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    rows = lines.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.filter("_bad IS NULL").drop("_bad"), rows.filter("_bad IS NOT NULL").select("_bad")


def source_and_page(df: DataFrame) -> DataFrame:
    """source and page of records that hold them at the top or under metadata."""
    top = [c for c in ("source", "page") if c in df.columns]
    pick = lambda n: F.coalesce(*([F.col(n)] if n in top else []), F.col(f"metadata.{n}"))
    return df.withColumn("source", pick("source")).withColumn("page", pick("page"))
