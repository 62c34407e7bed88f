"""Column helpers for text; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelt out: the regular expression engine's own Unicode classes are far slower.
_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def squash(text: Column) -> Column:
    """Runs of Unicode white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, _WS + "+", " "))


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, f"^{_WS}+|{_WS}+$", "")


def has_text(text: Column) -> Column:
    """Whether there is a character other than white space."""
    return text.rlike("[^" + _WS[1:])


def norm(text: Column) -> Column:
    """Lower-cased and squashed."""
    return squash(F.lower(text))


def rank_text(text: Column) -> Column:
    """Lower-cased, dashes, slashes and underscores as blanks, squashed."""
    return squash(F.translate(F.lower(text), "-‐‑–—/_", "       "))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text`` without overlap; 0 for an empty term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def total_occurrences(text: Column, terms: Column) -> Column:
    """The occurrences of all terms of an array, added."""
    return F.aggregate(terms, F.lit(0).cast("long"), lambda total, term: total + occurrences(text, term))


def has_any(text: Column, needles: list[str]) -> Column:
    """Whether the text contains one of the needles."""
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def unique_folded(terms: Column) -> Column:
    """Distinct ignoring case, the first spelling kept, in order."""
    lowered = F.transform(terms, F.lower)
    return F.filter(terms, lambda term, i: F.array_position(lowered, F.lower(term)) == i + 1)


def sha(*parts: Column) -> Column:
    """SHA-256 in hex of the parts in a row; null parts count as empty."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def answer_language(text: Column) -> Column:
    """``zh-Hans`` if the text has a CJK character, else ``en``."""
    return F.when(text.rlike(r"[㐀-䶿一-鿿豈-﫿]"), "zh-Hans").otherwise("en")
