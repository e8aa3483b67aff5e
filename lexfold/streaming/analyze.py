"""Analysis of a stream of texts.

Segmentation and detection happen inside a text's row and keep no state, so
the same expressions run on a streaming DataFrame as they are.  Reports that
compare rows run batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexfold.operators.detect import analyze, flat_matches


def stream_matches(stream: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A stream of matches from a stream of texts."""
    return flat_matches(analyze(stream, text, keep), keep)


def for_each_batch(stream: DataFrame, report: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **trigger) -> StreamingQuery:
    """Start a query that analyzes each micro-batch, reports on it and hands the report to ``write`` with the batch's number."""
    return stream.writeStream.foreachBatch(lambda df, n: write(report(analyze(df, text, keep)), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
