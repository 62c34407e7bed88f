"""Rule-based understanding: chunk classes, facts, paper and author profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules
from ..functions.text import has_any, has_text, norm, sha, squash

CLASSIFIER = "chunk-classifier-v1"


def is_publisher_noise(text: Column) -> Column:
    """Whether every line that is not blank holds a phrase of site furniture, and there is one."""
    full = F.filter(F.split(F.lower(text), "\n"), lambda x: F.length(F.trim(x)) > 0)
    return (F.size(full) > 0) & F.forall(full, lambda x: has_any(x, rules.PUBLISHER_PHRASES))


def chunk_class(section: Column, low: Column, kind: Column, text: Column) -> Column:
    """``struct(chunk_kind, usefulness_score, skip_reason)`` by an ordered cascade of rules.

    ``section`` and ``low`` are the normalised section title and text.
    """

    def useful(name: str, score: float) -> Column:
        return F.struct(F.lit(name).alias("chunk_kind"), F.lit(score).alias("usefulness_score"), F.lit(None).cast("string").alias("skip_reason"))

    def skipped(name: str, reason: str) -> Column:
        return F.struct(F.lit(name).alias("chunk_kind"), F.lit(0.0).alias("usefulness_score"), F.lit(reason).alias("skip_reason"))

    out = F.when(kind == "figure_caption", useful("figure_caption", 0.95)).when(kind == "table_caption", useful("table_caption", 0.95))
    out = out.when(has_any(section, rules.REFERENCE_NEEDLES), skipped("bibliography_or_reference", "reference_section"))
    out = out.when(is_publisher_noise(text), skipped("publisher_noise", "publisher_noise"))
    out = out.when(F.length(F.regexp_replace(text, r"(?U)\s", "")) < 40, skipped("low_information", "very_short"))
    for name, score, needles in rules.SECTION_KINDS:
        out = out.when(has_any(section, needles), useful(name, score))
    out = out.when(has_any(low, rules.MECHANISM_NEEDLES), useful("mechanism", 0.8))
    return out.when(has_any(low, rules.METRIC_NEEDLES), useful("metric", 0.8)).otherwise(useful("unknown", 0.5))


def classify(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, paper_key, chunk_kind, usefulness_score, skip_reason, classifier_version, chunk_hash)``."""
    plain = chunks.withColumn("_text", F.coalesce("text", F.lit("")))
    plain = plain.withColumn("_low", norm(F.col("_text"))).withColumn("_section", norm(F.coalesce("section", F.lit(""))))
    judged = plain.withColumn("c", chunk_class(F.col("_section"), F.col("_low"), F.coalesce("section_kind", F.lit("body")), F.col("_text")))
    return judged.select(
        F.col("id").alias("chunk_id"), "paper_key", "c.chunk_kind", "c.usefulness_score", "c.skip_reason",
        F.lit(CLASSIFIER).alias("classifier_version"), F.sha2("_text", 256).alias("chunk_hash"),
    )


def class_states(chunks: DataFrame, papers: DataFrame, classes: DataFrame, version: str) -> DataFrame:
    """``(chunk_id, state)``: whether a chunk has a class of this version, of its paper's source and of its text.

    The states are current, other_text (another chunk hash), other_source, other_version and
    missing, the best of several rows; hashes are compared with nulls alike.
    """
    own = chunks.select(F.col("id").alias("chunk_id"), "paper_key", F.col("chunk_hash").alias("own_hash")).join(
        papers.select("paper_key", F.col("source_hash").alias("own_source")), "paper_key"
    )
    stored = classes.select("chunk_id", "classifier_version", "source_hash", "chunk_hash", F.lit(True).alias("stored"))
    level = (
        F.when(F.col("stored").isNull(), 4)
        .when(~F.col("classifier_version").eqNullSafe(version), 3)
        .when(~F.col("source_hash").eqNullSafe(F.col("own_source")), 2)
        .when(~F.col("chunk_hash").eqNullSafe(F.col("own_hash")), 1)
        .otherwise(0)
    )
    best = own.join(stored, "chunk_id", "left").groupBy("chunk_id").agg(F.min(level).alias("level"))
    names = F.array(*map(F.lit, ["current", "other_text", "other_source", "other_version", "missing"]))
    return best.select("chunk_id", F.get(names, F.col("level")).alias("state"))


def class_counts(classes: DataFrame) -> DataFrame:
    """``(chunk_kind, skip_reason, chunks)``."""
    return classes.groupBy("chunk_kind", F.coalesce("skip_reason", F.lit("")).alias("skip_reason")).agg(F.count(F.lit(1)).alias("chunks"))


def pending_classification(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """``(id)`` of chunks without a stored class for the hash of their present text: a left anti-join."""
    current = stored.select(F.col("chunk_id").alias("id"), F.col("chunk_hash").alias("present")).distinct()
    present = chunks.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("present"))
    return present.join(current, ["id", "present"], "left_anti").select("id")


def fact_type(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in rules.FACT_TYPES.items() for x in pair]), kind)


def fact_rank(kind: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in rules.FACT_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, kind), F.lit(10))


def chunk_facts(chunks: DataFrame, classes: DataFrame) -> DataFrame:
    """``(claim_uid, chunk_id, paper_key, chunk_index, fact_type, claim, confidence)``, a fact for each useful chunk.

    Skipped chunks, scores under 0.5, kinds without a fact type and blank texts give none.
    """
    good = classes.where("skip_reason is null and usefulness_score >= 0.5").select("chunk_id", "chunk_kind")
    kinds = F.create_map(*[F.lit(x) for pair in rules.FACT_TYPES.items() for x in pair])
    facts = (
        chunks.join(good, chunks["id"] == good["chunk_id"])
        .withColumn("fact_type", F.try_element_at(kinds, F.col("chunk_kind")))
        .where(F.col("fact_type").isNotNull() & has_text(F.col("text")))
        .withColumn("claim", squash(F.col("text")))
    )
    zero = F.lit("\0")
    uid = F.concat(F.lit("chunk-fact-v1:"), sha(F.col("paper_key"), zero, F.col("fact_type"), zero, F.col("claim"), zero, F.col("chunk_index").cast("string")))
    return facts.select(
        uid.alias("claim_uid"), "chunk_id", "paper_key", "chunk_index", "fact_type", "claim",
        F.when(F.col("fact_type") == "context", "medium").otherwise("high").alias("confidence"),
    )


def distinct_facts(facts: DataFrame) -> DataFrame:
    """The first fact of each paper, type and claim; adds ``rank_position`` by rank of type, chunk index and uid."""
    same = W.partitionBy("paper_key", "fact_type", "claim").orderBy("chunk_index", "claim_uid")
    first = facts.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")
    order = W.partitionBy("paper_key").orderBy(F.desc(fact_rank(F.col("fact_type"))), "chunk_index", "claim_uid")
    return first.withColumn("rank_position", F.row_number().over(order))


def _keyword_words(texts: Column) -> Column:
    """The words of 4 bytes and more of an array of texts, without stop words, in order."""
    words = F.flatten(F.transform(texts, lambda t: F.split(t, r"[^\p{IsAlphabetic}\p{N}-]+")))
    return F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~F.lower(w).isin(rules.KEYWORD_STOP))


def topic_keywords(title: Column, claims: Column, limit: int = 12) -> Column:
    """The first distinct words of 4 bytes and more of the title and the claims, then sorted."""
    return F.array_sort(F.slice(F.array_distinct(_keyword_words(F.concat(F.array(title), claims))), 1, limit))


def all_fact_keywords(facts: DataFrame, papers: DataFrame, limit: int = 12) -> DataFrame:
    """``(paper_key, every)``: ``topic_keywords`` over all facts of the papers ``(paper_key, title)``.

    The first place of each word is an aggregate, so no paper's facts are gathered.
    """
    titles = papers.select("paper_key", F.lit(-1000).alias("r"), F.lit(-1).alias("chunk_index"), F.lit("").alias("claim_uid"), F.col("title").alias("said"))
    claims = facts.join(papers.select("paper_key"), "paper_key", "left_semi")
    claims = claims.select("paper_key", (-fact_rank(F.col("fact_type"))).alias("r"), "chunk_index", "claim_uid", F.col("claim").alias("said"))
    words = titles.unionByName(claims).select("paper_key", "r", "chunk_index", "claim_uid", F.posexplode(_keyword_words(F.array("said"))).alias("at", "word"))
    first = words.groupBy("paper_key", "word").agg(F.min(F.struct("r", "chunk_index", "claim_uid", "at")).alias("place"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("paper_key").orderBy("place"))).where(F.col("n") <= limit)
    return ranked.groupBy("paper_key").agg(F.array_sort(F.collect_list("word")).alias("every"))


def first_facts(facts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` first facts of each paper by rank of type, chunk index and uid, with their place ``n``.

    Spark drops what can't be among them before the shuffle, however many facts a paper has.
    """
    order = W.partitionBy("paper_key").orderBy(F.desc(fact_rank(F.col("fact_type"))), "chunk_index", "claim_uid")
    return facts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def paper_profiles(facts: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per paper with facts: summary, contribution types, keywords, contributions, limitations, digest.

    The 12 first facts of a paper are gathered for keywords, 6 for contributions and limitations
    each, and the first of a kind for the summary; all else are aggregates, so a paper with very
    many facts fits as well.  Where the 12 first facts have too few words, those of all facts are
    ranked (``all_fact_keywords``).  ``fact_digest`` identifies the set of facts.
    """
    distinct = facts.groupBy("paper_key", "fact_type", "claim").agg(F.min(F.struct("chunk_index", "claim_uid")).alias("m"))
    distinct = distinct.select("paper_key", "fact_type", "claim", "m.chunk_index", "m.claim_uid")
    entry = F.struct((-fact_rank(F.col("fact_type"))).alias("r"), "chunk_index", "claim_uid", "claim")
    gathered = distinct.groupBy("paper_key").agg(
        F.count(F.lit(1)).alias("facts"),
        F.collect_set(F.when(F.col("fact_type") != "context", F.col("fact_type"))).alias("kinds"),
        F.min(F.when(F.col("fact_type") == "context", entry)).alias("context"),
        F.min(F.when(F.col("fact_type") == "result", entry)).alias("result"),
        F.min(entry).alias("any"),
        F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.expr("bit_xor(xxhash64(claim_uid))"), F.expr("bit_xor(xxhash64(claim_uid, 'x'))")), 256).alias("fact_digest"),
    )

    def listed(rows: DataFrame, limit: int, column: str, name: str) -> DataFrame:
        kept = first_facts(rows, limit).groupBy("paper_key").agg(F.array_sort(F.collect_list(F.struct("n", column))).alias("x"))
        return kept.select("paper_key", F.transform("x", lambda v: v[column]).alias(name))

    joined = (
        papers.select("paper_key", "author", "title", F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("year", F.lit("")).alias("year"))
        .join(gathered, "paper_key")
        .join(listed(distinct, 12, "claim", "leading"), "paper_key")
        .join(listed(distinct.where("fact_type not in ('limitation', 'context')"), 6, "claim_uid", "contributions"), "paper_key", "left")
        .join(listed(distinct.where("fact_type = 'limitation'"), 6, "claim_uid", "limitations"), "paper_key", "left")
    )
    joined = joined.withColumn("words", topic_keywords(F.col("title"), F.col("leading")))
    short = joined.where("facts > 12 and size(words) < 12").select("paper_key", "title")
    joined = joined.join(all_fact_keywords(distinct, short), "paper_key", "left")
    none = F.array().cast("array<string>")
    ranks = F.transform(F.array_sort(F.transform("kinds", lambda k: F.struct((-fact_rank(k)).alias("r"), k.alias("k")))), lambda x: x["k"])
    return joined.select(
        "paper_key", "author", "title", "doi", "year", "facts",
        F.concat("title", F.lit(": "), F.coalesce("context.claim", "result.claim", "any.claim")).alias("one_sentence_summary"),
        ranks.alias("contribution_types"), F.coalesce("every", "words").alias("topic_keywords"),
        F.coalesce("contributions", none).alias("contributions"), F.coalesce("limitations", none).alias("limitations"), "fact_digest",
    )


def profile_faults(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """``(paper_key, fault)``: empty_title, empty_summary, no_keywords, instruction (a phrase that instructs a model), unknown_fact."""
    cited = profiles.select("paper_key", F.explode(F.concat("contributions", "limitations")).alias("claim_uid"))
    unknown = cited.join(facts.select("claim_uid").distinct(), "claim_uid", "left_anti").select("paper_key", F.lit("unknown_fact").alias("fault"))
    said = F.lower(F.concat_ws(" ", "title", "one_sentence_summary", F.array_join("topic_keywords", " ")))
    tests = [
        F.when(F.trim("title") == "", "empty_title"), F.when(F.trim("one_sentence_summary") == "", "empty_summary"),
        F.when(F.size("topic_keywords") == 0, "no_keywords"), F.when(has_any(said, rules.INSTRUCTION_PHRASES), "instruction"),
    ]
    own = profiles.select("paper_key", F.explode(F.array_compact(F.array(*tests))).alias("fault"))
    return own.union(unknown).distinct()


def theme_key(profile_keywords: Column, types: Column) -> Column:
    return norm(F.coalesce(F.get(profile_keywords, F.lit(0)), F.get(types, F.lit(0)), F.lit("general research")))


def author_themes(profiles: DataFrame) -> DataFrame:
    """``(author, theme, papers, years, works)``: papers of an author by their first keyword, 12 works at most."""
    keyed = profiles.withColumn("theme", theme_key(F.col("topic_keywords"), F.col("contribution_types")))
    order = W.partitionBy("author", "theme").orderBy(F.desc("year"), "title", "paper_key")
    keyed = keyed.withColumn("n", F.row_number().over(order))
    year = F.when(F.col("year") != "", F.col("year"))
    return (
        keyed.groupBy("author", "theme")
        .agg(
            F.count(F.lit(1)).alias("papers"),
            F.min(year).alias("first_year"),
            F.max(year).alias("last_year"),
            F.array_sort(F.collect_list(F.when(F.col("n") <= 12, F.struct("n", "paper_key")))).alias("w"),
        )
        .select("author", "theme", "papers", F.coalesce("first_year", F.lit("unknown")).alias("first_year"),
                F.coalesce("last_year", F.lit("unknown")).alias("last_year"), F.transform("w", lambda x: x["paper_key"]).alias("works"))
    )


def keyword_overview(profiles: DataFrame, limit: int = 20) -> DataFrame:
    """``(keyword, papers)``: the keywords of most papers, ties in order."""
    words = profiles.select(F.explode("topic_keywords").alias("keyword"))
    return words.groupBy("keyword").agg(F.count(F.lit(1)).alias("papers")).orderBy(F.desc("papers"), "keyword").limit(limit)


def profile_difference(before: DataFrame, after: DataFrame, compare: list[str]) -> DataFrame:
    """``(paper_key, change)`` between two sets of profiles: only_before, only_after, changed or same."""
    a = before.select("paper_key", F.struct(*compare).alias("a"))
    b = after.select("paper_key", F.struct(*compare).alias("b"))
    return a.join(b, "paper_key", "full_outer").select(
        "paper_key",
        F.when(F.col("b").isNull(), "only_before").when(F.col("a").isNull(), "only_after").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed").alias("change"),
    )
