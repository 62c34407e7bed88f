"""Logged answers: their JSON, evidence and claims, and whether the evidence holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import has_any, norm

ANSWER = (
    "answer string, claims array<struct<claim string, evidence_indices array<int>, support string>>, "
    "evidence array<struct<paper_key string, title string, doi string, year string, chunk_id bigint, section string, quote_or_summary string>>, "
    "uncertainty string, followup_queries array<string>"
)


def lenient_object(text: Column) -> Column:
    """The JSON object in a text: the text itself, else from its first ``{`` to its last ``}``, else null."""
    whole = F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), text)
    outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(whole, F.when(F.try_parse_json(outer).isNotNull() & (outer != ""), outer))


def parsed_answers(logs: DataFrame) -> DataFrame:
    """``(log_id, question, raw, a)``: each log once, ``a`` the parsed answer or null."""
    once = logs.where("id is not null").dropDuplicates(["id"])
    return once.select(
        F.col("id").alias("log_id"), "author", "question", F.col("answer_json").alias("raw"), F.from_json(lenient_object(F.col("answer_json")), ANSWER).alias("a")
    )


def signals_insufficient(answer: Column) -> Column:
    return has_any(F.lower(answer), rules.INSUFFICIENT)


def signals_uncertain(answer: Column, uncertainty: Column) -> Column:
    return (F.trim(uncertainty) != "") | has_any(F.lower(answer), rules.UNCERTAIN)


def numeric_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^0-9.]"), lambda t: t.rlike("[0-9]"))


def meaningful_terms(text: Column) -> Column:
    return F.slice(F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.length(t) >= 3), 1, 12)


def grounding(quote: Column, text: Column) -> Column:
    """``ok``, ``number`` (a number of the quote is not in the text) or ``overlap`` (no word of it is)."""
    bare = F.trim(quote)
    said, source = norm(bare), norm(text)
    missing = F.exists(numeric_tokens(bare), lambda n: ~text.contains(n))
    overlap = F.exists(meaningful_terms(bare), lambda t: source.contains(t))
    return (
        F.when(bare == "", "ok")
        .when((F.length(said) >= 12) & source.contains(said), "ok")
        .when(missing, "number")
        .when(~overlap & (F.length(bare) >= 12), "overlap")
        .otherwise("ok")
    )


def evidence_rows(answers: DataFrame) -> DataFrame:
    """``(log_id, position, e)``: one row for each piece of evidence, positions from 0."""
    return answers.select("log_id", F.posexplode("a.evidence").alias("position", "e"))


def evidence_errors(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(log_id, position, chunk_id, error)`` of all evidence, ``error`` null if it holds.

    In order: unknown_chunk, other_paper, other_doi, other_year, other_section, number, overlap.
    Only the cited chunks are joined; empty fields don't contradict.
    """
    rows = evidence_rows(answers).select("log_id", "position", "e.*")
    cited = chunks.join(rows.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    source = cited.select(
        F.col("id").alias("chunk_id"), F.col("paper_key").alias("c_key"), F.col("doi").alias("c_doi"), F.col("year").alias("c_year"), F.col("section").alias("c_section"), F.col("text").alias("c_text")
    )
    joined = rows.join(source, "chunk_id", "left")

    def differs(mine: str, theirs: str, fold: bool = False) -> Column:
        a, b = F.trim(F.coalesce(mine, F.lit(""))), F.trim(F.coalesce(theirs, F.lit("")))
        return (a != "") & (b != "") & ((F.lower(a) != F.lower(b)) if fold else (a != b))

    grounded = grounding(F.coalesce("quote_or_summary", F.lit("")), F.coalesce("c_text", F.lit("")))
    error = (
        F.when(F.col("c_key").isNull(), "unknown_chunk")
        .when(~F.col("paper_key").eqNullSafe(F.col("c_key")), "other_paper")
        .when(differs("doi", "c_doi"), "other_doi")
        .when(differs("year", "c_year"), "other_year")
        .when(differs("section", "c_section", True), "other_section")
        .when(grounded != "ok", grounded)
    )
    return joined.select("log_id", "position", "chunk_id", error.alias("error"))


def claim_errors(answers: DataFrame) -> DataFrame:
    """``(log_id, position, error)`` of all claims: empty, bad_support, no_evidence, missing_evidence, weak_but_certain or null."""
    rows = answers.select(
        "log_id", F.col("a.answer").alias("answer"), F.coalesce("a.uncertainty", F.lit("")).alias("uncertainty"),
        F.coalesce(F.size("a.evidence"), F.lit(0)).alias("n"), F.posexplode("a.claims").alias("position", "c"),
    )
    answer = F.coalesce("answer", F.lit(""))
    support = F.lower(F.trim(F.coalesce("c.support", F.lit(""))))
    indices = F.coalesce("c.evidence_indices", F.array().cast("array<int>"))
    error = (
        F.when(F.trim(F.coalesce("c.claim", F.lit(""))) == "", "empty")
        .when(~support.isin("", "strong", "partial", "weak"), "bad_support")
        .when((F.size(indices) == 0) & ~signals_insufficient(answer), "no_evidence")
        .when(F.exists(indices, lambda i: i >= F.greatest(F.col("n"), F.lit(0))), "missing_evidence")
        .when((support == "weak") & ~signals_uncertain(answer, F.col("uncertainty")), "weak_but_certain")
    )
    return rows.select("log_id", "position", error.alias("error"))


def first_errors(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(log_id, verdict)``: the first failing check of each answer, evidence before claims, else ``valid``."""
    evidence = evidence_errors(answers, chunks).where("error is not null").select("log_id", F.struct(F.lit(0).alias("part"), "position", F.concat(F.lit("evidence:"), "error").alias("error")).alias("x"))
    no_evidence = (F.coalesce(F.size("a.evidence"), F.lit(0)) <= 0) & ~signals_insufficient(F.coalesce("a.answer", F.lit("")))
    bare = answers.where("a is not null").where(no_evidence).select("log_id", F.struct(F.lit(1).alias("part"), F.lit(0).alias("position"), F.lit("no_evidence").alias("error")).alias("x"))
    claims = claim_errors(answers).where("error is not null").select("log_id", F.struct(F.lit(2).alias("part"), "position", F.concat(F.lit("claim:"), "error").alias("error")).alias("x"))
    first = evidence.union(bare).union(claims).groupBy("log_id").agg(F.min("x").alias("x"))
    unread = F.when(F.col("a").isNull(), "unreadable")
    return answers.join(first, "log_id", "left").select("log_id", F.coalesce(unread, F.col("x.error"), F.lit("valid")).alias("verdict"))


def rendered(answers: DataFrame) -> DataFrame:
    """``(log_id, text)``: answer, numbered evidence, uncertainty and further questions as one text."""
    lines = F.transform(
        F.coalesce("a.evidence", F.array().cast("array<struct<paper_key string, title string, doi string, year string, chunk_id bigint, section string, quote_or_summary string>>")),
        lambda e, i: F.concat(
            F.format_string("[%d] ", i + 1),
            F.concat_ws(" ", F.coalesce(e["year"], F.lit("")), F.coalesce(e["title"], F.lit("")), F.coalesce(e["doi"], F.lit(""))),
            F.lit(" section="), F.coalesce(e["section"], F.lit("")), F.lit(" chunk="), F.coalesce(e["chunk_id"].cast("string"), F.lit("0")),
            F.when(F.trim(F.coalesce(e["quote_or_summary"], F.lit(""))) != "", F.concat(F.lit("："), F.trim(e["quote_or_summary"]))).otherwise(""),
        ),
    )
    follow = F.filter(F.coalesce("a.followup_queries", F.array().cast("array<string>")), lambda q: F.trim(q) != "")
    none = F.array().cast("array<string>")
    unsure = F.trim(F.coalesce("a.uncertainty", F.lit("")))
    parts = F.concat(
        F.array(F.trim(F.coalesce("a.answer", F.lit("")))),
        F.when(F.size(lines) > 0, F.concat(F.array(F.lit(""), F.lit("依据：")), lines)).otherwise(none),
        F.when(unsure != "", F.array(F.lit(""), F.concat(F.lit("不确定性："), unsure))).otherwise(none),
        F.when(F.size(follow) > 0, F.concat(F.array(F.lit(""), F.lit("可继续追问：")), F.transform(follow, lambda q: F.concat(F.lit("- "), F.trim(q))))).otherwise(none),
    )
    return answers.where("a is not null").select("log_id", F.array_join(parts, "\n").alias("text"))
