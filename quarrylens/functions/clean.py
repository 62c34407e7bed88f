"""Cleaning of article text: publisher noise, white space, reference sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .text import has_any, lines, squash, strip


def layer_tests(source: str | Column, tests: dict = rules.SOURCE_TESTS) -> dict[str, Column]:
    """Which layers are for the source of a row: by a part of it, or by a whole token."""
    low = F.lower(F.coalesce(F.lit(source) if isinstance(source, str) else source, F.lit("")))
    out = {}
    for name, (parts, tokens) in tests.items():
        hit = has_any(low, parts)
        for token in tokens:
            hit = hit | F.array_contains(F.split(low, "[^a-z0-9]+"), token)
        out[name] = hit
    return out


def normal_line(line: Column) -> Column:
    """A line as noise rules see it: without edge marks, squashed, lower-cased."""
    return squash(F.lower(F.regexp_replace(strip(line), r"^[#*_:|-]+|[#*_:|-]+$", "")))


def is_noise_line(line: Column, source: str | Column | dict[str, Column] = "", layers: dict = rules.SOURCE_LAYERS) -> Column:
    low = normal_line(line)

    def noise(exact: list[str], counted: list[str], prefixes: list[str]) -> Column:
        found = low.isin(exact) | low.rlike("^(?:" + "|".join(map(re.escape, counted)) + r")[0-9\s()\[\]:|,-]*$") if counted else low.isin(exact)
        for prefix in prefixes:
            found = found | low.startswith(prefix)
        return found

    out = noise(rules.NOISE_LINES, rules.COUNT_PREFIX_LINES, [])
    for name, applies in _layers_of(source):
        layer = layers[name]
        out = out | (applies & noise(layer["lines"], layer["counts"], layer["prefixes"]))
    return (low != "") & out


def with_layers(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their layer tests as columns, made once from ``source`` (none without it), and those columns."""
    if "source" not in rows.columns:
        return rows, {}
    tests = layer_tests(F.col("source"))
    return rows.withColumns({f"_for_{name}": hit for name, hit in tests.items()}), {name: F.col(f"_for_{name}") for name in tests}


def _layers_of(source: str | Column | dict[str, Column]) -> list[tuple[str, Column]]:
    """The layers that can apply; those of an empty source never do."""
    if isinstance(source, dict):
        return list(source.items())
    return [] if isinstance(source, str) and not source else list(layer_tests(source).items())


def collapse(text: Column) -> Column:
    """White space runs as one blank per line, one blank line at most, trimmed."""
    each = F.array_join(F.transform(lines(text), squash), "\n")
    return strip(F.regexp_replace(each, r"\n{3,}", "\n\n"))


def clean_text(text: Column, source: str | Column | dict[str, Column] = "", layers: dict = rules.SOURCE_LAYERS) -> Column:
    """Replacements, image fragments, noise lines and white space, in that order.

    ``source`` is a name, a column, or the columns of ``with_layers``.
    """
    out = F.regexp_replace(text, r"\r\n?", "\n")
    for old, new in rules.NOISE_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for name, applies in _layers_of(source):
        for old, new in layers[name]["replacements"]:
            out = F.replace(out, F.when(applies, F.lit(old)).otherwise(""), F.lit(new))  # an empty text is nowhere
    out = F.regexp_replace(out, r"Download: Download (?:high-res|full-size) image(?: \([^)]*\))?", " ")
    kept = F.filter(F.split(out, "\n"), lambda line: ~is_noise_line(line, source, layers))
    return collapse(F.array_join(kept, "\n"))


def is_reference_title(title: Column) -> Column:
    bare = F.lower(F.regexp_replace(strip(title), r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))
    return bare.isin(rules.REFERENCE_TITLES)


def primary_body(body: Column) -> Column:
    """From the article body heading on, if there is one."""
    at = F.instr(body, "\n## Article Body")
    return F.when(at > 0, F.substring(body, at + 1, F.length(body))).otherwise(body)


def without_frontmatter(text: Column) -> Column:
    """The body after a closed ``---`` block at the start; an unclosed block stays."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?s)\A---[ \t]*\n(?:.*?\n)??---[ \t]*(?:\n|\z)", ""))
