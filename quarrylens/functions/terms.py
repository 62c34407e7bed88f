"""Terms of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .text import has_any, rank_text, strip, unique_folded

_CJK = r"一-鿿"
_TERM = rf"[{_CJK}]+|(?:(?![{_CJK}])[\p{{IsAlphabetic}}\p{{N}}_/.\-])+"


def base_terms(question: Column) -> Column:
    """Runs of CJK characters, or of other letters, digits and ``-_/.``; single characters only if ASCII."""
    found = F.regexp_extract_all(question, F.lit(f"({_TERM})"), 1)
    kept = unique_folded(F.filter(found, lambda t: (F.length(t) > 1) | t.rlike(r"^[A-Za-z0-9]+$")))
    whole = strip(question)
    return F.when(F.size(kept) > 0, kept).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))


def enrichment(question: Column) -> Column:
    """DOI-like and digit-bearing tokens, quoted phrases, then English phrases of two words and more."""
    tokens = F.filter(F.split(question, r"(?U)\s+"), lambda t: F.length(t) > 0)
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9./_-]+|[^A-Za-z0-9./_-]+$", ""))
    numbers = F.filter(tokens, lambda t: t.rlike("[0-9]"))
    quoted = F.filter(F.split(question, '"'), lambda _, i: i % 2 == 1)
    quoted = F.filter(F.transform(quoted, strip), lambda t: F.length(t) > 2)
    phrases = F.transform(F.split(question, r"[^A-Za-z0-9\- ]"), strip)
    phrases = F.filter(phrases, lambda t: t.rlike(r"\S +\S") & (F.length(t) <= 80))
    return F.concat(numbers, quoted, phrases)


def query_terms(question: Column) -> Column:
    """The search terms of a question in order, unique ignoring case; an empty question has none."""
    return unique_folded(F.concat(base_terms(question), enrichment(question)))


def with_terms(rows: DataFrame, question: str, name: str = "terms") -> DataFrame:
    """Adds ``query_terms`` of a column in steps, so that each part is made once; null questions have none."""
    q = F.coalesce(F.col(question), F.lit(""))
    found = F.regexp_extract_all(q, F.lit(f"({_TERM})"), 1)
    out = rows.withColumn("_base", F.filter(found, lambda t: (F.length(t) > 1) | t.rlike(r"^[A-Za-z0-9]+$")))
    whole = F.when(F.length(strip(q)) > 0, F.array(strip(q))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_all", F.concat(F.when(F.size("_base") > 0, F.col("_base")).otherwise(whole), enrichment(q)))
    out = out.withColumn("_low", F.transform("_all", F.lower))
    unique = F.filter(F.arrays_zip("_all", "_low"), lambda t, i: F.array_position("_low", t["_low"]) == i + 1)
    return out.withColumn(name, F.transform(unique, lambda t: t["_all"])).drop("_base", "_all", "_low")


def folded_terms(text: Column) -> Column:
    """The same terms lower-cased, as a set: linear in the text, for long ones."""
    found = F.regexp_extract_all(text, F.lit(f"({_TERM})"), 1)
    kept = F.filter(found, lambda t: (F.length(t) > 1) | t.rlike(r"^[A-Za-z0-9]+$"))
    return F.array_distinct(F.transform(F.concat(kept, enrichment(text)), F.lower))


def match_string(terms: Column) -> Column:
    """The first 12 terms quoted and joined by OR."""
    quoted = F.transform(F.slice(terms, 1, 12), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.array_join(quoted, " OR ")


def fact_intents(terms: Column) -> Column:
    """The fact types that the terms ask for, in the fixed order."""
    query = F.lower(F.array_join(terms, " "))
    tokens = F.split(query, r"[^a-z0-9_-]+")

    def asks(needle: str) -> Column:
        if all(c.isascii() and (c.isalnum() or c in "-_") for c in needle):
            return F.array_contains(tokens, needle) | F.array_contains(tokens, needle + "s")
        return query.contains(needle)

    found = []
    for kind, needles in rules.FACT_INTENTS:
        any_of = asks(needles[0])
        for needle in needles[1:]:
            any_of = any_of | asks(needle)
        found.append(F.when(any_of, kind))
    return F.array_compact(F.array(*found))


def rank_terms(terms: Column, alike: dict[str, list[str]] = rules.SYNONYMS) -> Column:
    """Terms for ranking: normalised, 3 characters and more, no stop words, with synonyms and a plural or singular."""
    normal = F.transform(terms, rank_text)
    normal = F.filter(normal, lambda t: (F.length(t) >= 3) & ~t.isin(rules.RANK_STOP))

    def spread(t: Column) -> Column:
        number = (
            F.when(~t.endswith("s"), F.array(F.concat(t, F.lit("s"))))
            .when(F.length(t) >= 5, F.array(F.substring(t, F.lit(1), F.length(t) - 1)))
            .otherwise(F.array().cast("array<string>"))
        )
        synonyms = F.array().cast("array<string>")
        for word, others in alike.items():
            synonyms = F.when(t == word, F.array(*map(F.lit, others))).otherwise(synonyms)
        return F.concat(F.array(t), synonyms, number)

    return F.array_distinct(F.flatten(F.transform(normal, spread)))


def route_mode(question: Column, profiles: Column) -> Column:
    """``(qa_mode, route_reason)``: whether a question is answered from profiles or from sources."""
    detail = has_any(F.lower(question), rules.DETAIL_KEYWORDS)
    return (
        F.when(profiles == 0, F.struct(F.lit("source_evidence").alias("qa_mode"), F.lit("profile_missing").alias("route_reason")))
        .when(detail, F.struct(F.lit("source_evidence").alias("qa_mode"), F.lit("detail_keyword").alias("route_reason")))
        .otherwise(F.struct(F.lit("profile_first").alias("qa_mode"), F.lit("broad_profile_context").alias("route_reason")))
    )


def asks_for_evidence(question: Column) -> Column:
    return has_any(F.lower(question), rules.EVIDENCE_KEYWORDS)
