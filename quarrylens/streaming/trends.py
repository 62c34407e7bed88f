"""Event-time trends of question logs, the streaming twin of the daily report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(logs: DataFrame, width: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """``(start, qa_mode, questions, errors, total_tokens)`` in tumbling windows; logs later than ``late`` are dropped when streaming.

    ``late`` is None for logs that have a watermark already.
    """
    failed = F.coalesce("error_code", F.lit("")) != ""
    marked = logs if late is None else logs.withWatermark("created_at", late)
    grouped = marked.groupBy(F.window("created_at", width).alias("w"), "qa_mode")
    out = grouped.agg(F.count(F.lit(1)).alias("questions"), F.sum(failed.cast("long")).alias("errors"), F.sum("total_tokens").alias("total_tokens"))
    return out.select(F.col("w.start").alias("start"), "qa_mode", "questions", "errors", "total_tokens")


def once_per_id(logs: DataFrame, late: str = "2 days") -> DataFrame:
    """Repeated logs of an id dropped within the watermark."""
    return logs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
