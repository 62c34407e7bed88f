"""Problem 2: the same work in ``papers``, almost the same passage in ``chunks``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, need
from .near_duplicates import Covering, NearDuplicates, near_duplicates

#: Three-word sequences, similarity 0.6, 60 members at least.
CHUNKS = Covering(unit="word", width=3, threshold=0.6, min_size=60, symbols=5, blocks=10)
#: Three-character substrings of titles, similarity 0.8: longer blocks, as titles share stock phrases.
TITLES = Covering(unit="char", width=3, threshold=0.8, min_size=1, symbols=8, blocks=10)


def doi_key(doi):
    """The DOI without case, resolver, label, percent-encoding, blanks, brackets and full stops; null if there is none."""
    decoded = F.lower(F.coalesce(F.try_url_decode(F.replace(doi, F.lit("+"), F.lit("%2B"))), doi))
    found = F.regexp_extract(decoded, r"(10\.[0-9]+/\S+)", 1)
    bare = F.regexp_replace(found, r"[\s\])}>.(\[{<]+$", "")
    return F.when(bare.rlike(r"^10\.[0-9]+/."), bare)


def title_text(title):
    """Lower-cased, each run of characters other than letters and digits one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def chunk_duplicates(chunks: DataFrame, spec: Covering = CHUNKS) -> NearDuplicates:
    """Near-duplicate passages of ``(id, text)``; see ``near_duplicates`` for nulls, copies and empty texts."""
    chunks = need(chunks, ["id", "text"], "chunk_duplicates")
    return near_duplicates(chunks.select(F.col("id").alias("key"), "text"), spec, cut_lineage)


def paper_records(papers: DataFrame) -> DataFrame:
    """``(key, text, doi_key, no_doi)``, one row per paper_key."""
    papers = need(papers, ["paper_key", "doi", "title"], "paper_duplicates").dropDuplicates(["paper_key"])
    return papers.where("paper_key is not null").select(
        F.col("paper_key").alias("key"), title_text("title").alias("text"), doi_key(F.col("doi")).alias("doi_key")
    ).withColumn("no_doi", F.col("doi_key").isNull())


def _expand(found: NearDuplicates) -> DataFrame:
    """All pairs of keys behind the links and within the classes of copies, ``(a, b)`` unordered."""
    left = found.members.select(F.col("key").alias("ka"), F.col("class_key").alias("a"))
    right = found.members.select(F.col("key").alias("kb"), F.col("class_key").alias("b"))
    across = found.links.select("a", "b").join(left, "a").join(right, "b").select("ka", "kb")
    within = left.join(right, F.col("a") == F.col("b")).where("ka < kb").select("ka", "kb")
    return across.union(within).select(F.col("ka").cast("string").alias("ka"), F.col("kb").cast("string").alias("kb"))


def _ordered(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select(
        F.lit(kind).alias("record_kind"), F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")
    )


def paper_pairs(papers: DataFrame, spec: Covering = TITLES) -> DataFrame:
    """``(ka, kb)``: the same DOI on both, or at least one without a DOI and similar titles.

    Null titles have no features; a paper without DOI and title is in no pair.
    """
    records = cut_lineage(paper_records(papers))
    doi = records.where("not no_doi").select("key", "doi_key")
    same_doi = (
        doi.select("doi_key", F.col("key").alias("ka"))
        .join(doi.select("doi_key", F.col("key").alias("kb")), "doi_key")
        .where("ka < kb")
        .select("ka", "kb")
    )
    alike = _expand(near_duplicates(records.select("key", "text", "no_doi"), spec, cut_lineage, extra="no_doi"))
    flags = records.select("key", "no_doi")
    alike = (
        alike.join(flags.select(F.col("key").alias("ka"), F.col("no_doi").alias("xa")), "ka")
        .join(flags.select(F.col("key").alias("kb"), F.col("no_doi").alias("xb")), "kb")
        .where("xa or xb")
        .select("ka", "kb")
    )
    return same_doi.union(alike)


def found(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``p2_found``: (record_kind, key_a, key_b), every pair of duplicates once."""
    chunk_pairs = _expand(chunk_duplicates(chunks))
    return _ordered(paper_pairs(papers), "paper").union(_ordered(chunk_pairs, "chunk")).distinct()
