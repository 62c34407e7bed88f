"""The hybrid retrieval plan: five routes, reciprocal rank fusion, profile chunks in the tail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import route_mode
from ..operators import retrieval, understanding
from ..operators.library import top_per_author
from ..sources.tables import cut_lineage


@dataclass(frozen=True)
class Library:
    """What questions are answered from."""

    chunks: DataFrame
    facts: DataFrame
    profiles: DataFrame


def facts_of(chunks: DataFrame) -> DataFrame:
    """Classes and facts of the canonical chunk rows, each written once.

    Written classes also keep the filter on them from running the whole cascade again.
    """
    classes = cut_lineage(understanding.classify(chunks).select("chunk_id", "chunk_kind", "usefulness_score", "skip_reason"))
    return cut_lineage(understanding.chunk_facts(chunks, classes))


def library(chunks: DataFrame, papers: DataFrame) -> Library:
    """Facts and profiles made from the canonical chunk rows."""
    chunks = cut_lineage(chunks)  # every route reads them
    facts = facts_of(chunks)
    return Library(chunks, facts, cut_lineage(understanding.paper_profiles(facts, papers)))


def routes(questions: DataFrame, lib: Library) -> DataFrame:
    """All routes of all questions as one long table of at most 140 rows a question, written once."""
    parts = [
        retrieval.bm25_route(questions, lib.chunks),
        retrieval.like_route(questions, lib.chunks),
        retrieval.fact_route(questions, lib.chunks, lib.facts),
        retrieval.local_vector_route(questions, lib.chunks),
        retrieval.profile_route(questions, lib.chunks, lib.profiles, lib.facts),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


def hybrid(questions: DataFrame, lib: Library, limit: int = 8) -> DataFrame:
    """``(query_id, position, chunk_id, rrf_score, seed)``."""
    return retrieval.fuse(routes(questions, lib), limit)


def context(questions: DataFrame, lib: Library, limit: int = 8, reserve: int = 2) -> DataFrame:
    """``(query_id, position, chunk_id, origin)``: what a question is answered from.

    Questions planned as profile first take the chunks of their profiles if there are any; all
    others the fused ones with profile chunks in the tail.  Where nothing is found, the most
    recent chunks of the author stand in.
    """
    profiled = lib.profiles.groupBy("author").agg(F.count(F.lit(1)).alias("profiles"))
    planned = questions.join(profiled, "author", "left").select(
        "query_id", route_mode(F.coalesce("question", F.lit("")), F.coalesce("profiles", F.lit(0)))["qa_mode"].alias("mode")
    )
    found = routes(questions, lib)
    grounding = found.where("route = 'profile'").select("query_id", "position", "chunk_id")
    first = grounding.join(planned.where("mode = 'profile_first'"), "query_id").where(F.col("position") <= limit)
    first = first.select("query_id", "position", "chunk_id", F.lit("profile").alias("origin"))
    fused = retrieval.with_tail(retrieval.fuse(found, limit), grounding, limit, reserve)
    rest = fused.join(first.select("query_id").distinct(), "query_id", "left_anti")
    found = first.unionByName(rest)
    empty = questions.select("query_id", "author").join(found.select("query_id").distinct(), "query_id", "left_anti")
    recent = top_per_author(lib.chunks, limit).select("author", "position", F.col("id").alias("chunk_id"))
    return found.unionByName(empty.join(recent, "author").select("query_id", "position", "chunk_id", F.lit("recent").alias("origin")))
