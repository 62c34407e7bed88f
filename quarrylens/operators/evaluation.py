"""Evaluation of retrieval against golden questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cases(retrieved: DataFrame, golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, hit, precision, covered, missing_terms)`` per golden question.

    ``retrieved`` ``(query_id, position, chunk_id)``; ``golden`` ``(query_id, must_cite,
    must_include)``.  A hit needs every wanted paper; precision is the share of rows from wanted
    papers, 0 without rows and 1 without wishes; required terms are sought in the retrieved texts
    of wanted papers.
    """
    used = retrieved.select("query_id", F.col("chunk_id").alias("id"))
    text = chunks.select("id", "paper_key", F.lower("text").alias("low"))
    rows = used.join(text, "id").join(golden.select("query_id", "must_cite", "must_include"), "query_id")
    rows = rows.withColumn("wanted", F.array_contains("must_cite", F.col("paper_key")))
    found = F.filter("must_include", lambda t: F.col("low").contains(F.lower(t)))
    per = rows.groupBy("query_id").agg(
        F.collect_set("paper_key").alias("keys"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if("wanted").alias("good"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("wanted"), found)))).alias("seen"),
    )
    none = F.array().cast("array<string>")
    joined = golden.join(per, "query_id", "left")
    missing = F.array_sort(F.array_except("must_include", F.coalesce("seen", none)))
    return joined.select(
        "query_id",
        (F.size(F.array_except("must_cite", F.coalesce("keys", none))) == 0).alias("hit"),
        F.when(F.coalesce("rows", F.lit(0)) == 0, 0.0).when(F.size("must_cite") == 0, 1.0).otherwise(F.col("good") / F.col("rows")).alias("precision"),
        (F.size(missing) == 0).alias("covered"),
        F.array_join(missing, ",").alias("missing_terms"),
    )


def summary(evaluated: DataFrame) -> DataFrame:
    """``(questions, hit_at_k, mean_precision, coverage)`` over all cases."""
    return evaluated.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_at_k"),
        F.round(F.avg("precision"), 6).alias("mean_precision"),
        F.round(F.avg(F.col("covered").cast("int")), 6).alias("coverage"),
    )


def route_rates(routes: DataFrame, golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(route, hits, hit_rate, mean_candidates)``: a route hits if any of its chunks is of a wanted paper; all questions count."""
    keyed = routes.join(chunks.select(F.col("id").alias("chunk_id"), "paper_key"), "chunk_id").join(golden.select("query_id", "must_cite"), "query_id")
    per = keyed.groupBy("route", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_contains("must_cite", F.col("paper_key")) | (F.size("must_cite") == 0)).alias("hit")
    )
    total = golden.agg(F.count(F.lit(1)).alias("all")).withColumn("k", F.lit(1))
    out = per.groupBy("route").agg(F.count_if("hit").alias("hits"), F.sum("n").alias("candidates")).withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
    return out.select("route", "hits", F.round(F.col("hits") / F.col("all"), 6).alias("hit_rate"), F.round(F.col("candidates") / F.col("all"), 6).alias("mean_candidates"))


def comparison(before: DataFrame, after: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """``(metric, before, after, drop, blocked)`` of two summaries; ``limits`` metric: (greatest drop, least value)."""
    metrics = list(limits)

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", name))

    bound = F.create_map(*[x for m, (d, v) in limits.items() for x in (F.lit(m), F.array(F.lit(float(d)), F.lit(float(v))))])
    both = long(before, "before").join(long(after, "after"), "metric").withColumn("drop", F.round(F.col("before") - F.col("after"), 6))
    limit = F.element_at(bound, F.col("metric"))
    return both.select("metric", "before", "after", "drop", ((F.col("drop") > limit[0]) | (F.col("after") < limit[1])).alias("blocked"))
