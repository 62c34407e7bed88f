"""Reports over question logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def distinct_logs(logs: DataFrame) -> DataFrame:
    """Logs without exact repeats, one row per id."""
    return logs.where("id is not null").dropDuplicates(["id"])


def totals(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Questions, mean latency and sums of tokens, by the given columns; sums over nothing are null."""
    grouped = logs.groupBy(*by) if by else logs.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def daily_trend(logs: DataFrame, days: int) -> DataFrame:
    """The last ``days`` days that have logs: counts, errors, streamed and unfinished ones, means, tokens."""
    failed = F.coalesce("error_code", F.lit("")) != ""
    streamed = F.col("delivery_mode") == "streaming"
    return (
        logs.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.count_if(failed).alias("errors"),
            F.count_if(streamed).alias("streamed"),
            F.count_if(streamed & ~F.coalesce("streaming_finalized", F.lit(False))).alias("unfinished"),
            F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
            F.sum("total_tokens").alias("total_tokens"),
        )
        .orderBy(F.desc("day"))
        .limit(days)
    )


def error_counts(logs: DataFrame) -> DataFrame:
    """``(error_code, questions)`` of logs with a code."""
    return logs.where("coalesce(error_code, '') <> ''").groupBy("error_code").agg(F.count(F.lit(1)).alias("questions"))


def latest_by_author(logs: DataFrame) -> DataFrame:
    """``(author, id, question)``: each author's log of the highest id."""
    return logs.groupBy("author").agg(F.max(F.struct("id", "question")).alias("m")).select("author", "m.id", "m.question")


def grouping_report(logs: DataFrame) -> DataFrame:
    """``(qa_mode, delivery_mode, questions, levels)`` with subtotals; an addition to the reference's reports."""
    return logs.rollup("qa_mode", "delivery_mode").agg(F.count(F.lit(1)).alias("questions"), F.grouping_id().alias("levels"))


def latency_percentiles(logs: DataFrame) -> DataFrame:
    """``(qa_mode, p50, p95)`` of the latency, exact and interpolated; equal values are counted first."""
    counted = logs.where("latency_ms is not null").groupBy("qa_mode", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("qa_mode").agg(
        F.round(F.expr("percentile(latency_ms, 0.5, n)"), 6).alias("p50"), F.round(F.expr("percentile(latency_ms, 0.95, n)"), 6).alias("p95")
    )


def gaps(logs: DataFrame, minutes: int = 30) -> DataFrame:
    """``(author, session, started, questions)``: an author's logs in sessions, cut where ``minutes`` pass without one.

    Logs are compared within a day, and days by their ends, so that no task has all logs of an author.
    """
    rows = logs.select("author", "id", "created_at").withColumn("day", F.to_date("created_at"))
    within = W.partitionBy("author", "day").orderBy("created_at", "id")
    days = rows.groupBy("author", "day").agg(F.max("created_at").alias("last"))
    # a row for each day of an author
    by_day = W.partitionBy("author").orderBy("day")
    days = days.select("author", "day", F.lag("last").over(by_day).alias("day_before"))
    joined = rows.withColumn("before", F.lag("created_at").over(within)).join(days, ["author", "day"])
    gap = F.unix_timestamp("created_at") - F.unix_timestamp(F.coalesce("before", "day_before"))
    marked = joined.withColumn("opens", F.when(gap.isNull() | (gap > minutes * 60), 1).otherwise(0))
    opened = marked.groupBy("author", "day").agg(F.sum("opens").alias("of_day"))
    opened = opened.select("author", "day", (F.sum("of_day").over(by_day) - F.col("of_day")).alias("earlier"))
    numbered = marked.join(opened, ["author", "day"]).withColumn("session", F.col("earlier") + F.sum("opens").over(within))
    return numbered.groupBy("author", "session").agg(F.min("created_at").alias("started"), F.count(F.lit(1)).alias("questions"))
