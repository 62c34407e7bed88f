"""The library of papers and chunks: canonical rows, metadata, hashes, currency, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import sha, squash, strip


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without exact repeats, one row per id (null ids are left out)."""
    return chunks.where("id is not null").dropDuplicates(["id"])


def source_chunks(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """The canonical chunk row: a chunk with its paper, defaults for what is missing.

    ``source_hash`` is that of the paper.  Chunks of unknown papers are left out.
    """
    paper = papers.select("paper_key", "author", "paper_id", "title", F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("year", F.lit("")).alias("year"), "source_hash")
    chunk = distinct_chunks(chunks).select(
        "id", "paper_key", "chunk_index", "section", "text", F.coalesce("chunk_hash", F.lit("")).alias("chunk_hash"),
        F.coalesce("section_kind", F.lit("body")).alias("section_kind"), "caption_label", "caption_object_type", "caption_object_label",
    )
    return chunk.join(paper, "paper_key")


def top_per_author(rows: DataFrame, limit: int) -> DataFrame:
    """The most recent chunks of each author: year down, title, chunk index; adds ``position`` from 1."""
    from pyspark.sql import Window as W

    order = W.partitionBy("author").orderBy(F.desc("year"), "title", "chunk_index", "id")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def paper_counts(papers: DataFrame) -> DataFrame:
    """``(author, papers)``."""
    return papers.groupBy("author").agg(F.count(F.lit(1)).alias("papers"))


def _scalar(json: Column, path: str, kinds: list[str] | None = None) -> Column:
    """A string, number or boolean at a path of a JSON text as a string, else null; ``kinds`` narrows the types."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    kind = F.schema_of_variant(value)
    fits = kind.isin(kinds) if kinds else ~(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"))
    return F.when(fits, F.get_json_object(json, path))


def resolved_metadata(articles: DataFrame) -> DataFrame:
    """``(paper_key, title, doi, year)`` of loaded articles.

    Each field comes from the frontmatter, else from the fetched record, else from its nested
    record; a title falls back to the paper id.  Broken JSON counts as none.
    """
    fetched = F.when(F.try_parse_json("fetch_result").isNotNull(), F.col("fetch_result"))

    def first(name: str, default: Column) -> Column:
        return F.coalesce(F.element_at("metadata", name), _scalar(fetched, f"$.{name}"), _scalar(fetched, f"$.record.{name}"), default)

    return articles.select(
        "paper_key",
        squash(first("title", F.col("paper_id"))).alias("title"),
        strip(first("doi", F.lit(""))).alias("doi"),
        strip(first("year", F.lit(""))).alias("year"),
    )


def article_sources(articles: DataFrame) -> DataFrame:
    """``(paper_key, source)`` of each article; see ``with_source``."""
    return with_source(articles).select("paper_key", "source")


def with_source(articles: DataFrame) -> DataFrame:
    """The articles with their publisher: from the frontmatter, else a string of the fetched record, else empty."""
    fetched = F.when(F.try_parse_json("fetch_result").isNotNull(), F.col("fetch_result"))
    return articles.withColumn("source", F.coalesce(F.element_at("metadata", "source"), _scalar(fetched, "$.source", ["STRING"]), F.lit("")))


def fetch_result_state(articles: DataFrame) -> DataFrame:
    """``(paper_key, state)``: missing, broken (no JSON), not_object, bad_field (a title, doi, year or source that is no string, number or null), or ok."""
    parsed = F.try_parse_json("fetch_result")
    kind = F.schema_of_variant(parsed)
    bad = F.lit(False)
    for name in ("title", "doi", "year", "source"):
        of_field = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        bad = bad | F.coalesce(of_field.rlike("^(ARRAY|OBJECT|BOOLEAN)"), F.lit(False))
    return articles.select(
        "paper_key",
        F.when(F.col("fetch_result").isNull(), "missing")
        .when(parsed.isNull(), "broken")
        .when(~kind.startswith("OBJECT"), "not_object")
        .when(bad, "bad_field")
        .otherwise("ok")
        .alias("state"),
    )


def fingerprints(articles: DataFrame, parser: str = rules.PARSER_VERSION, cleaner: str = rules.CLEANER_VERSION) -> DataFrame:
    """``(paper_key, source_hash)``: SHA-256 of the versions, the article and the fetched record."""
    return articles.select("paper_key", sha(F.lit(f"parser:{parser}\ncleaner:{cleaner}\n"), F.col("raw_body"), F.col("fetch_result")).alias("source_hash"))


def changed_papers(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``(paper_key, change)`` of papers whose hash is new or another: an anti-join, no full rewrite."""
    before = stored.select("paper_key", F.col("source_hash").alias("old_hash"))
    joined = current.join(before, "paper_key", "left").where(~F.col("source_hash").eqNullSafe(F.col("old_hash")))
    return joined.select("paper_key", F.when(F.col("old_hash").isNull(), "new").otherwise("changed").alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Stored and incoming rows merged, the incoming winning by key; adds ``outcome``.

    ``outcome`` is inserted, updated, unchanged (equal in ``compare``, nulls alike) or kept.
    Repeated incoming keys must be resolved before.
    """
    differs = F.lit(False)
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in compare], F.lit(True).alias("was"))
    for c in compare:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    merged = incoming.join(old, keys, "left").withColumn(
        "outcome", F.when(F.col("was").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    )
    kept = stored.join(incoming.select(*keys), keys, "left_anti").withColumn("outcome", F.lit("kept"))
    return merged.select(*incoming.columns, "outcome").unionByName(kept.select(*incoming.columns, "outcome"))


def stale_chunk_hashes(chunks: DataFrame) -> DataFrame:
    """``(id, state)`` of chunks whose stored hash is missing or not that of their text."""
    actual = F.sha2("text", 256)
    return (
        distinct_chunks(chunks)
        .where(F.col("chunk_hash").isNull() | (F.col("chunk_hash") != actual))
        .select("id", F.when(F.col("chunk_hash").isNull(), "missing").otherwise("different").alias("state"))
    )


def library_status(papers: DataFrame, chunks: DataFrame, logs: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row of counts over the library: papers, analysed, failed, stale, chunks, questions, latency, tokens.

    ``fresh`` ``(paper_key, source_hash)`` holds the current hashes.
    """
    stale = changed_papers(fresh, papers).where("change = 'changed'").agg(F.count(F.lit(1)).alias("stale"))
    paper = papers.agg(
        F.count(F.lit(1)).alias("papers"),
        F.countDistinct("author").alias("authors"),
        F.count_if(F.coalesce("profile_status", F.lit("")) == "succeeded").alias("analysed"),
        F.count_if(F.coalesce("profile_status", F.lit("")) == "failed").alias("failed"),
    )
    chunk = chunks.agg(F.countDistinct("id").alias("chunks"))
    log = logs.dropDuplicates(["id"]).agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"), F.sum("total_tokens").alias("total_tokens")
    )
    # one row each: joined on a constant key
    one = [d.withColumn("k", F.lit(1)) for d in (paper, stale, chunk, log)]
    out = one[0]
    for other in one[1:]:
        out = out.join(other, "k")
    return out.drop("k")
