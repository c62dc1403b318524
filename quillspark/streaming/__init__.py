"""Reports over streams: stateless for documents, by micro-batch for bundles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quillspark.operators.evidence import analyze, analyze_bundle


def analyze_stream(docs: DataFrame, text_col: str = "text", allow_terms: Iterable[str] = ()) -> DataFrame:
    """The reports of a stream of documents; no state and no watermark are needed."""
    if not docs.isStreaming:
        raise ValueError("not a stream")
    return analyze(docs, text_col, allow_terms)


def bundles_by_batch(
    files: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], **columns
) -> DataStreamWriter:
    """A writer that takes each micro-batch's bundles as complete and hands both their tables to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        reports, shared = analyze_bundle(batch, **columns)
        sink(reports, shared, number)

    return files.writeStream.foreachBatch(each)
