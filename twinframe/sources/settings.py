"""Managed folders and settings as JSON, and a log of JSON lines."""

from __future__ import annotations

import json
import logging
import threading
import time
import traceback
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = "path string, is_enabled boolean, last_scanned_utc timestamp, last_modified_utc timestamp, item_count long"
_BROKEN = "_broken"


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """The managed folders; none where the file is missing or any of it is broken."""
    try:
        lines = spark.read.text(path).where("trim(value) <> ''")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FOLDERS)
    rows = lines.select(F.from_json("value", f"{FOLDERS}, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN}).alias("row")).select("row.*")
    return spark.createDataFrame([], FOLDERS) if rows.where(F.col(_BROKEN).isNotNull()).take(1) else rows.drop(_BROKEN)


def write_folders(folders: DataFrame, path: str) -> None:
    folders.select(*(c.split()[0] for c in FOLDERS.split(", "))).write.mode("overwrite").json(path)


def enabled(folders: DataFrame) -> DataFrame:
    return folders.where("is_enabled")


def read_settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Settings by name; the defaults where the file is missing, broken or lacks one."""
    try:
        got = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (AnalysisException, ValueError, TypeError):
        return dict(defaults)
    return defaults | {k: v for k, v in got.items() if k in defaults} if isinstance(got, dict) else dict(defaults)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(settings, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


class JsonLines(logging.Handler):
    """One JSON object a line, appended under a lock; what can't be written is let go. An error's own line comes before the caller's."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.guard = Path(path), threading.Lock()

    def emit(self, record: logging.LogRecord) -> None:
        file, line, error = record.pathname, record.lineno, None
        if record.exc_info and record.exc_info[1] is not None:
            error = "".join(traceback.format_exception_only(record.exc_info[1])).strip()
            if frames := traceback.extract_tb(record.exc_info[2]):
                file, line = frames[-1].filename, frames[-1].lineno
        entry = {"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "source": record.name, "file": Path(file).name, "line": line, "message": record.getMessage(), "exception": error}
        try:
            with self.guard, self.path.open("a", encoding="utf-8") as f:
                f.write(json.dumps(entry, ensure_ascii=False) + "\n")
        except OSError:
            pass
