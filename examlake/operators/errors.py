"""Errors as data: guards that make rows of them, and summaries."""

from __future__ import annotations

import json
import os
import time
import traceback
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ERRORS


def error_row(error: Exception | str, context: str = "", severity: str = "ERROR", recoverable: bool = True, kind: str | None = None) -> tuple:
    """A row of schemas.ERRORS."""
    trace = "".join(traceback.format_exception(error)) if isinstance(error, Exception) else ""
    name = kind or (type(error).__name__ if isinstance(error, Exception) else "Error")
    return (datetime.now(timezone.utc).isoformat(), name, str(error), context, trace, severity, recoverable)


class ErrorLog:
    """Collects error rows on the driver and turns them into a table."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def handle(self, error: Exception | str, context: str = "", severity: str = "ERROR", recoverable: bool = True) -> tuple:
        self.rows.append(error_row(error, context, severity, recoverable))
        return self.rows[-1]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, ERRORS)

    def append(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("append").json(path)

    def check_type(self, value: Any, kind: type, name: str = "input") -> bool:
        if not isinstance(value, kind):
            self.handle(f"{name} is {type(value).__name__}, not {kind.__name__}", "check_type")
            return False
        return True

    def check_path(self, path: str, must_exist: bool = True) -> bool:
        if not path or (must_exist and not os.path.isfile(path)):
            self.handle(f"no such file: {path!r}", "check_path")
            return False
        return True

    def check_disk(self, folder: str = "/", least_mb: float = 100.0) -> bool:
        stat = os.statvfs(folder)
        if stat.f_bavail * stat.f_frsize < least_mb * 2**20:
            self.handle(f"less than {least_mb} MB free", "check_disk", "WARNING")
            return False
        return True

    def check_memory(self, least_mb: float = 100.0, meminfo: str = "/proc/meminfo") -> bool:
        """Whether the driver's machine has as much memory left; unknown counts as enough."""
        try:
            with open(meminfo, encoding="ascii") as f:
                free = next(int(x.split()[1]) / 1024 for x in f if x.startswith("MemAvailable"))
        except (OSError, StopIteration):
            return True
        if free < least_mb:
            self.handle(f"less than {least_mb} MB of memory free", "check_memory", "WARNING")
        return free >= least_mb

    def save_summary(self, spark: SparkSession, path: str) -> bool:
        """The summary of all errors and the last of them as one JSON file."""
        rows = error_summary(self.table(spark)).collect()  # a row for each type and severity
        pick = lambda m: {r["value"]: r["errors"] for r in rows if r["measure"] == m}
        one = lambda m: pick(m).get("", 0)
        last = [r.asDict() for r in last_errors(self.table(spark)).collect()]
        return self.save_json({"total_errors": one("total"), "error_types": pick("type"), "severity_counts": pick("severity"), "recoverable_errors": one("recoverable"), "critical_errors": one("critical"), "recent_errors": last}, path)

    def load_json(self, path: str) -> Any:
        """The file's content, or None with a WARNING if it is missing and an ERROR if it is malformed."""
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError as e:
            self.handle(e, path, "WARNING")
        except ValueError as e:
            self.handle(e, path)
        return None

    def save_json(self, value: Any, path: str) -> bool:
        try:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                json.dump(value, f, ensure_ascii=False, indent=2)
            return True
        except (OSError, TypeError, ValueError) as e:
            self.handle(e, path)
            return False

    def retry(self, call: Callable[[], Any], retries: int = 3, delay: float = 1.0, wait: Callable[[float], None] = time.sleep) -> Any:
        """call()'s result after at most retries + 1 attempts with delay * 2**k between them; the last error is raised."""
        for k in range(retries + 1):
            try:
                return call()
            except Exception as e:
                self.handle(e, f"attempt {k + 1}", "WARNING" if k < retries else "ERROR", k < retries)
                if k == retries:
                    raise
                wait(delay * 2**k)
        return None


def error_summary(errors: DataFrame) -> DataFrame:
    """measure, value, errors: the total, counts by type and severity, recoverable and critical ones."""
    n = F.count(F.lit(1)).alias("errors")
    total = errors.agg(n).select(F.lit("total").alias("measure"), F.lit("").alias("value"), "errors")
    kinds = errors.groupBy(F.col("error_type").alias("value")).agg(n).select(F.lit("type").alias("measure"), "value", "errors")
    levels = errors.groupBy(F.col("severity").alias("value")).agg(n).select(F.lit("severity").alias("measure"), "value", "errors")
    flags = errors.agg(F.count_if("recoverable").alias("recoverable"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    flags = flags.select(F.explode(F.array(*[F.struct(F.lit(x).alias("measure"), F.lit("").alias("value"), F.col(x).alias("errors")) for x in ("recoverable", "critical")])).alias("x")).select("x.*")
    return total.unionByName(kinds).unionByName(levels).unionByName(flags)


def last_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    return errors.orderBy(F.desc("timestamp"), F.desc("error_type"), F.desc("error_message")).limit(n)
