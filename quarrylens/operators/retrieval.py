"""Ranked routes over a batch of questions, and their fusion.

Every route takes ``questions`` ``(query_id, author, question)`` and gives a long table
``(query_id, route, position, chunk_id, route_score)``, positions from 1.  Questions meet the
chunks of their author by an equi-join; the best ``limit`` of a question come from a window
whose group limit Spark applies before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import rules
from ..functions.terms import fact_intents, folded_terms, rank_terms
from ..functions.terms import with_terms as terms_of
from ..functions.text import occurrences, rank_text, total_occurrences

_COLUMNS = ["query_id", "route", "position", "chunk_id", "route_score"]


def with_terms(questions: DataFrame) -> DataFrame:
    """Questions with their ``terms``; null questions have none and find nothing."""
    return terms_of(questions.select("query_id", "author", "question"), "question")


def _ranked(scored: DataFrame, route: str, order: list, limit: int, chunk: str = "id") -> DataFrame:
    position = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    top = scored.withColumn("position", position).where(F.col("position") <= limit)
    return top.select("query_id", F.lit(route).alias("route"), "position", F.col(chunk).alias("chunk_id"), F.col("score").cast("double").alias("route_score"))


def like_route(questions: DataFrame, chunks: DataFrame, limit: int = rules.ROUTE_LIMIT) -> DataFrame:
    """Occurrences of all terms in title, doi, section and text; ties by year down, title, chunk index."""
    terms = with_terms(questions).select("query_id", "author", F.transform("terms", F.lower).alias("terms"))
    blob = F.lower(F.concat_ws(" ", "title", "doi", "section", "text"))
    rows = chunks.select("id", "author", "year", "title", "chunk_index", blob.alias("blob")).join(terms, "author")
    scored = rows.withColumn("score", total_occurrences(F.col("blob"), F.col("terms"))).where("score > 0").drop("blob", "terms")
    return _ranked(scored, "like", [F.desc("score"), F.desc("year"), "title", "chunk_index", "id"], limit)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def bm25_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score)`` of the first 12 terms as phrases; statistics over the chunks of all authors.

    Only postings of words that some question has are made.  A phrase of several words is
    posted under its first word and counted in the chunk's word sequence.
    """
    phrases = with_terms(questions).select("query_id", "author", F.explode(F.slice("terms", 1, 12)).alias("term"))
    phrases = phrases.select("query_id", "author", _tokens(F.col("term")).alias("words")).where(F.size("words") > 0)
    phrases = phrases.select("query_id", "author", F.array_join("words", "  ").alias("phrase"), F.col("words")[0].alias("word")).distinct()
    wanted = phrases.select("phrase", "word").distinct()
    tokens = chunks.select(F.col("id").alias("chunk_id"), F.col("author"), _tokens(F.col("text")).alias("tokens"))
    sized = tokens.withColumn("length", F.size("tokens"))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length")).withColumn("k", F.lit(1))
    words = wanted.select("word").distinct()
    posted = sized.select("chunk_id", "author", "length", F.explode("tokens").alias("word")).join(words, "word")
    posted = posted.groupBy("chunk_id", "author", "length", "word").agg(F.count(F.lit(1)).alias("f"))
    single = posted.join(wanted.where("phrase = word").select("phrase", "word"), "word").select("chunk_id", "author", "length", "phrase", "f")
    longer = posted.drop("f").join(wanted.where("phrase <> word"), "word").select("chunk_id", "author", "length", "phrase")
    sequence = sized.select("chunk_id", F.concat(F.lit(" "), F.array_join("tokens", "  "), F.lit(" ")).alias("sequence"))
    longer = longer.join(sequence, "chunk_id").withColumn("f", occurrences(F.col("sequence"), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    counted = single.unionByName(longer.where("f > 0").drop("sequence"))
    frequency = counted.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    k1, b = rules.BM25_K1, rules.BM25_B
    weighed = (
        counted.join(frequency, "phrase")
        .withColumn("k", F.lit(1))
        .join(F.broadcast(totals), "k")
        .withColumn("idf", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(rules.BM25_FLOOR)))
        .withColumn("w", F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / F.col("mean_length"))))
    )
    met = phrases.select("query_id", "author", "phrase").join(weighed.select("phrase", "author", "chunk_id", "w"), ["phrase", "author"])
    return met.groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))


def bm25_route(questions: DataFrame, chunks: DataFrame, limit: int = rules.ROUTE_LIMIT) -> DataFrame:
    """The lexical route: BM25 down (to 9 digits), then chunk id."""
    scored = bm25_scores(questions, chunks).withColumn("score", F.round("score", 9))
    return _ranked(scored, "fts", [F.desc("score"), "chunk_id"], limit, "chunk_id")


def fact_route(questions: DataFrame, chunks: DataFrame, facts: DataFrame, limit: int = rules.ROUTE_LIMIT) -> DataFrame:
    """Facts of the asked types by occurrences in type, claim, title, doi, section and text; 3 more if the type was asked for."""
    terms = with_terms(questions).select("query_id", "author", F.transform("terms", F.lower).alias("terms"), fact_intents(F.col("terms")).alias("intents"))
    fact = facts.select("chunk_id", "fact_type", "claim")
    rows = chunks.join(fact, chunks["id"] == fact["chunk_id"]).select(
        "id", "author", "fact_type", F.lower(F.concat_ws(" ", "fact_type", "claim", "title", "doi", "section", "text")).alias("blob")
    )
    joined = rows.join(terms, "author").withColumn("asked", F.array_contains("intents", F.col("fact_type")))
    joined = joined.where("size(intents) = 0 or asked")
    scored = joined.withColumn("score", total_occurrences(F.col("blob"), F.col("terms")) + F.when(F.col("asked"), 3).otherwise(0)).where("score > 0").drop("blob", "terms")
    return _ranked(scored, "fact", [F.desc("score"), "id", "fact_type"], limit)


def hash_bucket(term: str) -> int:
    """The bucket of a term among 64: the low six bits of a byte-wise multiplicative hash."""
    h = 3
    for byte in term.encode("utf-8"):
        h = ((h ^ (byte & 63)) * 51) & 63
    return h


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(terms: pd.Series) -> pd.Series:
    """Unit vector of 64 counts of the terms' buckets; all zero without terms."""
    known: dict[str, int] = {}

    def vector(words) -> list[float]:
        counts = np.zeros(rules.HASH_DIMENSION)
        for word in words if words is not None else ():
            if word not in known:
                known[word] = hash_bucket(word)
            counts[known[word]] += 1
        size = np.sqrt((counts * counts).sum())
        return (counts / size if size else counts).astype(np.float32).tolist()

    return terms.map(vector)


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def local_vector_route(questions: DataFrame, chunks: DataFrame, limit: int = rules.ROUTE_LIMIT) -> DataFrame:
    """Hashed term vectors of question and chunk (title, doi, section, text) by dot product, then chunk id."""
    asked = with_terms(questions).select("query_id", "author", hash_embedding(folded_terms(F.col("question"))).alias("q"))
    rows = chunks.select("id", "author", hash_embedding(folded_terms(F.concat_ws(" ", "title", "doi", "section", "text"))).alias("v"))
    scored = rows.join(asked, "author").withColumn("score", F.round(dot(F.col("q"), F.col("v")), 6)).where("score > 0").drop("q", "v")
    return _ranked(scored, "local_embedding", [F.desc("score"), "id"], limit)


def dense_route(queries: DataFrame, vectors: DataFrame, limit: int = rules.ROUTE_LIMIT, key: str = "grp") -> DataFrame:
    """Stored vectors ``(id, grp, vector)`` for query vectors ``(query_id, grp, vector)`` of the same group and length."""
    q = queries.select("query_id", key, F.col("vector").alias("q"))
    met = vectors.select("id", key, F.col("vector").alias("v")).join(q, key).where(F.size("q") == F.size("v"))
    scored = met.withColumn("score", F.round(dot(F.col("q"), F.col("v")), 6)).where("score > 0").drop("q", "v")
    return _ranked(scored, "dense", [F.desc("score"), "id"], limit)


def _fallback_levels(section: Column, text: Column, kind: Column, index: Column, representative: bool) -> Column:
    body = ~kind.isin("figure_caption", "table_caption")
    said = rank_text(F.concat_ws(" ", section, text))
    out = F.when(body & (index > 0) & said.contains("abstract"), 0).when(body & (index > 0) & said.contains("introduction"), 1).when(body & (index > 0), 2)
    if representative:
        return out.when(body & said.contains("abstract"), 3).when(body, 4).otherwise(5)
    return out.when(body, 3).otherwise(4)


def representative_chunks(chunks: DataFrame) -> DataFrame:
    """``(paper_key, chunk_id, level)``: the chunk that stands for each paper, by level, then index."""
    level = _fallback_levels(F.col("section"), F.col("text"), F.col("section_kind"), F.col("chunk_index"), True)
    leveled = chunks.select("paper_key", "id", "chunk_index", level.alias("level"))
    return leveled.groupBy("paper_key").agg(F.min(F.struct("level", "chunk_index", "id")).alias("m")).select(
        "paper_key", F.col("m.id").alias("chunk_id"), F.col("m.level").alias("level")
    )


def best_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, paper_key, chunk_id, score)``: for each question and paper of its author the best chunk.

    Phrases weigh 4; chunks that look like reference lists count an eighth; without a match the
    fallback level decides, then the lower index.
    """
    terms = with_terms(questions).select("query_id", "author", rank_terms(F.col("terms"), rules.CHUNK_SYNONYMS).alias("terms"))
    said = rank_text(F.concat_ws(" ", "title", "section", "text"))
    level = _fallback_levels(F.col("section"), F.col("text"), F.col("section_kind"), F.col("chunk_index"), False)
    rows = chunks.select("id", "author", "paper_key", "chunk_index", level.alias("level"), said.alias("said")).join(terms, "author")
    raw = F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + occurrences(F.col("said"), t) * F.when(t.contains(" "), 4).otherwise(1))
    listed = (occurrences(F.col("said"), F.lit("google scholar")) >= 2) | (occurrences(F.col("said"), F.lit("pubmed")) >= 2) | (
        occurrences(F.col("said"), F.lit("article cas")) >= 2
    )
    scored = rows.withColumn("score", F.when(listed, F.expr("cast(0 as bigint)") + (raw / 8).cast("long")).otherwise(raw))
    best = scored.groupBy("query_id", "paper_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "level", "chunk_index", "id")).alias("m"))
    return best.select("query_id", "paper_key", F.col("m.id").alias("chunk_id"), (-F.col("m.s")).alias("score"))


def claim_scores(questions: DataFrame, profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """``(query_id, paper_key, claim_score)``: weighted matches in the claims of a paper, each claim once, where there are any."""
    terms = with_terms(questions).select("query_id", "author", rank_terms(F.col("terms")).alias("terms"))
    claims = facts.select("paper_key", "fact_type", "claim").distinct().join(profiles.select("paper_key", "author"), "paper_key")
    weight = F.lit(1)
    for kind, field in (("result", "key_results"), ("method", "methods"), ("limitation", "limitations")):
        weight = weight + F.when(F.col("fact_type") == kind, rules.PROFILE_WEIGHTS[field]).otherwise(0)
    rows = claims.select("paper_key", "author", weight.alias("weight"), rank_text(F.col("claim")).alias("said")).join(terms, "author")
    scored = rows.select("query_id", "paper_key", (F.col("weight") * total_occurrences(F.col("said"), F.col("terms"))).alias("score")).where("score > 0")
    return scored.groupBy("query_id", "paper_key").agg(F.sum("score").alias("claim_score"))


def profile_ranking(questions: DataFrame, profiles: DataFrame, limit: int = 20, facts: DataFrame | None = None) -> DataFrame:
    """``(query_id, paper_key, position, score)``: profiles by weighted field matches; those without follow by year, title.

    Fields are doi, title, keywords and summary, which count once more for the whole profile.
    With ``facts`` the claims count as well: results, methods and limitations by their weights,
    and each claim once more for the whole profile.
    """
    terms = with_terms(questions).select("query_id", "author", rank_terms(F.col("terms")).alias("terms"))
    fields = {"doi": F.col("doi"), "title": F.col("title"), "topic_keywords": F.array_join("topic_keywords", " "), "one_sentence_summary": F.col("one_sentence_summary")}
    rows = profiles.select("paper_key", "author", "year", "title", *[rank_text(c).alias(f"f_{n}") for n, c in fields.items()]).join(terms, "author")
    score = F.lit(0).cast("long")
    for name in fields:
        score = score + total_occurrences(F.col(f"f_{name}"), F.col("terms")) * (rules.PROFILE_WEIGHTS[name] + 1)
    scored = rows.withColumn("score", score).select("query_id", "paper_key", "year", "title", "score")
    if facts is not None:
        scored = scored.join(claim_scores(questions, profiles, facts), ["query_id", "paper_key"], "left")
        scored = scored.withColumn("score", F.col("score") + F.coalesce("claim_score", F.lit(0))).drop("claim_score")
    order = [F.desc(F.col("score") > 0), F.desc("score"), F.desc("year"), "title", "paper_key"]
    position = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("position", position).where(F.col("position") <= limit).select("query_id", "paper_key", "position", "score")


def profile_route(questions: DataFrame, chunks: DataFrame, profiles: DataFrame, facts: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """The representative chunk of each of the highest ranked profiles, in their order."""
    ranked = profile_ranking(questions, profiles, limit, facts)
    found = ranked.join(representative_chunks(chunks), "paper_key")
    return found.select("query_id", F.lit("profile").alias("route"), "position", "chunk_id", F.col("score").cast("double").alias("route_score"))


def fuse(routes: DataFrame, limit: int | None = 8, seeds: int = rules.LEXICAL_SEEDS) -> DataFrame:
    """``(query_id, position, chunk_id, rrf_score, seed)``: reciprocal rank fusion, the first lexical hits leading.

    A chunk counts once per route at its best position; scores to 12 digits, then chunk id.
    Without a limit all fused chunks are ranked.
    """
    once = routes.groupBy("query_id", "route", "chunk_id").agg(F.min("position").alias("position"))
    seed = F.min(F.when((F.col("route") == "fts") & (F.col("position") <= seeds), F.col("position")))
    fused = once.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (rules.RRF_OFFSET + F.col("position"))), 12).alias("rrf_score"), seed.alias("seed"))
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_last("seed"), F.desc("rrf_score"), "chunk_id")
    ranked = fused.withColumn("position", F.row_number().over(order))
    ranked = ranked if limit is None else ranked.where(F.col("position") <= limit)
    return ranked.select("query_id", "position", "chunk_id", "rrf_score", "seed")


def with_tail(fused: DataFrame, extra: DataFrame, limit: int = 8, reserve: int = 2) -> DataFrame:
    """``(query_id, position, chunk_id, origin)``: at most ``reserve`` unseen ``extra`` chunks replace the tail."""
    head = fused.where(F.col("position") <= limit).select("query_id", "chunk_id", "position", F.lit("hybrid").alias("origin"))
    unseen = extra.join(head.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    order = W.partitionBy("query_id").orderBy("position", "chunk_id")
    tail = unseen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= reserve)
    count = tail.groupBy("query_id").agg(F.count(F.lit(1)).alias("tails"))
    kept = head.join(count, "query_id", "left").where(F.col("position") <= limit - F.coalesce("tails", F.lit(0))).drop("tails")
    both = kept.unionByName(tail.select("query_id", "chunk_id", (F.col("n") + 1000).alias("position"), F.lit("profile").alias("origin")))
    return both.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("position", "chunk_id")).alias("position"), "chunk_id", "origin")


def trace(routes: DataFrame) -> DataFrame:
    """``(query_id, route, candidates, top_chunk, top_score)``: how each route did for each question."""
    return routes.groupBy("query_id", "route").agg(
        F.count(F.lit(1)).alias("candidates"), F.min(F.struct("position", "chunk_id", "route_score")).alias("m")
    ).select("query_id", "route", "candidates", F.col("m.chunk_id").alias("top_chunk"), F.col("m.route_score").alias("top_score"))


