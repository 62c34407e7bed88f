"""Metadata of texts extracted from PDF files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules
from ..functions.text import has_any, squash

_DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"


def find_doi(text: Column) -> Column:
    """The first DOI without closing punctuation, else empty."""
    return F.regexp_replace(F.regexp_extract(text, f"({_DOI})", 1), r"[.,;)\]}]+$", "")


def find_year(text: Column) -> Column:
    """The first year from 1900 to 2099 in the first 8000 characters, else empty."""
    return F.regexp_extract(F.left(text, F.lit(8000)), r"\b((?:19|20)\d{2})\b", 1)


def plausible_title(line: Column) -> Column:
    return F.length(line).between(20, 240) & ~has_any(F.lower(line), rules.TITLE_BLOCKED)


def with_title(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``title``: the first plausible line of the first 120 with up to two continuing ones, else empty.

    Made in steps, so that the lines are split once.
    """

    def continues(line: Column) -> Column:
        names = has_any(F.lower(line), ["@ ", "author", "†", "‡", "§"]) | (F.size(F.split(line, ",")) > 2) | line.rlike(r"\b\d{4,6},\s*[A-Z][a-z]+")
        return plausible_title(line) & ~names

    lines = F.filter(F.transform(F.slice(F.split(text, r"\r\n|\r|\n"), 1, 120), squash), lambda x: x != "")
    out = rows.withColumn("_lines", lines)
    out = out.withColumn("_at", F.array_position(F.transform("_lines", plausible_title), F.lit(True)).cast("int"))
    for i, name in enumerate(("_one", "_two", "_three")):
        out = out.withColumn(name, F.when(F.col("_at") > 0, F.coalesce(F.get("_lines", F.col("_at") - 1 + i), F.lit(""))).otherwise(""))
    more = F.when(continues(F.col("_three")), F.concat_ws(" ", "_one", "_two", "_three")).otherwise(F.concat_ws(" ", "_one", "_two"))
    title = F.when(continues(F.col("_two")), more).otherwise(F.col("_one"))
    return out.withColumn("title", title).drop("_lines", "_at", "_one", "_two", "_three")


def slug(value: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 as single hyphens, 96 characters at most."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(plain, r"^-+|-+$", ""), F.lit(96)), r"-+$", "")


def normalised(text: Column) -> Column:
    """Without NUL, line ends as LF, no blanks before them, three line ends in a row at most, trimmed."""
    out = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{4,}", "\n\n\n"), r"(?U)^\s+|\s+$", "")


#: Ids whose equal names are numbered in one task.
_IDS_AT_ONCE = 100_000


def metadata(extracts: DataFrame) -> DataFrame:
    """``(extract_id, doi, year, title)`` of ``(extract_id, text)``, each extract once."""
    once = extracts.select("extract_id", "text").dropDuplicates(["extract_id"])
    return with_title(once, "text").select("extract_id", find_doi(F.col("text")).alias("doi"), find_year(F.col("text")).alias("year"), "title")


def paper_ids(found: DataFrame) -> DataFrame:
    """``(extract_id, paper_id)``: year and slug of the DOI or title; the n-th of equal ones gets ``-n``.

    Equal ones are numbered in ranges of ids, so that those without metadata, however many, don't meet in one task.
    """
    name = F.coalesce(F.nullif(slug(F.when(F.col("doi") != "", F.col("doi")).otherwise(F.col("title"))), F.lit("")), F.lit("paper"))
    base = found.select("extract_id", F.concat_ws("-", F.coalesce(F.nullif("year", F.lit("")), F.lit("undated")), name).alias("base"))
    base = base.withColumn("range", F.floor(F.col("extract_id") / _IDS_AT_ONCE))
    ranges = base.groupBy("base", "range").agg(F.count(F.lit(1)).alias("size"))
    ranges = ranges.select("base", "range", (F.sum("size").over(W.partitionBy("base").orderBy("range")) - F.col("size")).alias("earlier"))
    base = base.join(ranges, ["base", "range"])
    n = F.col("earlier") + F.row_number().over(W.partitionBy("base", "range").orderBy("extract_id"))
    return base.select("extract_id", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("paper_id"))
