"""Incremental extraction: new page files become questions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..operators.parse import parse_questions
from ..operators.segment import question_blocks
from ..schemas import PAGES
from ..sources.readers import with_text


def stream_blocks(spark: SparkSession, folder: str, config: EngineConfig = DEFAULT, max_files: int = 1000) -> DataFrame:
    """A streaming table of question blocks of Parquet page files; segmentation works within rows, so it keeps no state."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(folder)
    return question_blocks(with_text(pages), config)


def run_available(spark: SparkSession, folder: str, out: str, checkpoint: str, config: EngineConfig = DEFAULT) -> None:
    """Parse whatever page files are new since the checkpoint and add their questions to a Parquet table."""

    def batch(blocks: DataFrame, number: int) -> None:
        parse_questions(blocks, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream_blocks(spark, folder, config).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def error_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream of (ts, error_type, severity) by window, type and severity; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "error_type", "severity").count()
