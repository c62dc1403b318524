"""Readers and writers: files as documents, reports as JSON."""

from __future__ import annotations

import json
import sys
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest input that the command line takes, in bytes; tables have no limit.
MAX_INPUT = 4 * 1024 * 1024


class InputTooLarge(ValueError):
    """An input is larger than ``MAX_INPUT``."""


class InputNotText(ValueError):
    """An input is not UTF-8."""


def read_documents(spark: SparkSession, path: str, max_bytes: int | None = MAX_INPUT) -> DataFrame:
    """``(path, text, status)`` of each file under ``path``, a whole file a row.

    ``status`` is ``ok``, ``too-large`` (more than ``max_bytes``, decided by the
    file's size) or ``not-utf8``; text is null unless ok.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    # decoding loosely marks what it repairs; bytes that come back unchanged were UTF-8
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    status = F.when(large, "too-large").when(~valid, "not-utf8").otherwise("ok")
    return raw.select("path", status.alias("status"), F.when(status == "ok", text).alias("text")).select("path", "text", "status")


def read_input(path: str | None, stdin: IO[bytes] | None = None, max_bytes: int = MAX_INPUT) -> str:
    """One file, or the standard input, as text; reads at most one byte over the limit."""
    if path is None:
        data = (stdin or sys.stdin.buffer).read(max_bytes + 1)
    else:
        with open(path, "rb") as f:
            data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise InputTooLarge(path or "standard input")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise InputNotText(path or "standard input") from None


def write_json(value: Any, out: IO[str]) -> None:
    """A report as indented JSON and a line end."""
    json.dump(value, out, indent=2, ensure_ascii=False)
    out.write("\n")


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines."""
    from quillspark.operators.evidence import report_json

    report_json(reports).write.json(path)
