"""Panels inside captions: their segments, relations between them, references to other objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash
from .sections import caption_values

_MARKER = r"\(([A-Za-z](?:\s*[,-]\s*[A-Za-z])*)\)"

#: Phrases between two panels and the relation they state, the first that fits counts.
PANEL_RELATIONS = [
    ("causes", "causes|leads to|results in|drives|induces"),
    ("inhibits", "inhibits|suppresses|blocks|prevents"),
    ("higher_than", "higher than|greater than|larger than|exceeds"),
    ("lower_than", "lower than|smaller than|less than"),
    ("compared_with", "compared with|compared to|relative to|versus|vs"),
]
#: Phrases before a reference to another object and what they say of it.
REFERENCE_RELATIONS = [
    ("caused_by", "caused by|due to"),
    ("inhibited_by", "inhibited by|suppressed by"),
    ("compared_with", "compared with|compared to|relative to|versus|vs"),
    ("summarized_in", "summarized in|summarised in|listed in|given in"),
    ("derived_from", "derived from|calculated from|obtained from"),
]
_CONDITION = r"(?i)\b((?:at|under|in|after|with|using|during|for)\s+(?!\b(?:at|under|in|after|with|using|during|for)\b)\S+(?:\s+(?!(?:at|under|in|after|with|using|during|for)\b)\S+){0,6})"


def expand_labels(marker: Column) -> Column:
    """The labels of a marker: ``a``, ``a,b`` or ``a-c`` (same case, ascending; else both ends)."""
    first, last = F.regexp_extract(marker, r"^([A-Za-z])\s*-\s*([A-Za-z])$", 1), F.regexp_extract(marker, r"^([A-Za-z])\s*-\s*([A-Za-z])$", 2)
    a, b = F.ascii(first), F.ascii(last)
    ordered = (a <= b) & ((F.lower(first) == first) == (F.lower(last) == last))
    spread = F.when(ordered, F.transform(F.sequence(a, F.greatest(a, b)), lambda c: F.char(c))).otherwise(F.array(first, last))
    return F.when(first != "", spread).otherwise(F.split(marker, r"\s*[,-]\s*"))


def panel_segments(captions: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, position, panel, description, measurements, named, conditions)``: a row for each panel of each caption.

    A segment reaches from its marker to the next; captions without markers, null and empty ones give none.
    """
    marked = captions.where(F.col(text).isNotNull()).select(key, F.regexp_extract_all(text, F.lit(_MARKER), 1).alias("markers"), F.split(text, _MARKER).alias("parts"))
    rows = marked.where(F.size("markers") > 0).select(key, F.posexplode("markers").alias("position", "marker"), "parts")
    said = F.regexp_replace(squash(F.get("parts", F.col("position") + 1)), r"^[\s,;:.]+|[\s,;:]+$", "")
    rows = rows.select(key, "position", F.explode(expand_labels(F.col("marker"))).alias("panel"), said.alias("description"))
    rows = rows.withColumn("v", caption_values(F.col("description")))
    return rows.select(key, "position", "panel", "description", "v.measurements", "v.named", F.regexp_extract_all("description", F.lit(_CONDITION), 1).alias("conditions"))


def panel_relations(captions: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, subject, relation, object)`` between panels that a sentence names with a phrase between them.

    Panels are named as ``(a)``, ``panel a`` or ``figure a``; another panel between the two breaks the relation.
    The pairs are of one caption's panels, a handful.
    """
    named = r"(?:\(([A-Za-z])\)|(?:panel|figure|fig\.)\s+([A-Za-z])\b)"
    sentences = captions.where(F.col(text).isNotNull()).select(key, F.explode(F.split(text, r"(?<=[.;])\s+")).alias("s"))
    tokens = F.regexp_extract_all("s", F.lit(f"(?i){named}"), 0)
    between = F.split("s", f"(?i){named}")
    rows = sentences.select(key, F.posexplode(tokens).alias("i", "subject"), tokens.alias("t"), between.alias("b")).where(F.col("i") + 1 < F.size("t"))
    label = lambda c: F.regexp_extract(c, r"([A-Za-z])\)?$", 1)
    middle = F.lower(F.get("b", F.col("i") + 1))
    relation = F.when(F.lit(False), "")
    for name, phrases in PANEL_RELATIONS:
        relation = relation.when(middle.rlike(rf"\b(?:{phrases})\b"), name)
    found = rows.select(key, label(F.col("subject")).alias("subject"), relation.alias("relation"), label(F.get("t", F.col("i") + 1)).alias("object"))
    return found.where("relation is not null and subject <> object").distinct()


def cross_references(captions: DataFrame, key: str, text: str, own: str) -> DataFrame:
    """``(key, target, relation)``: other figures and tables that a caption mentions; ``own`` is its array of targets.

    The relation is that of the phrase nearest before the mention within its clause, else ``references``.
    """
    mention = r"(?i)([^;,.:\n]*?)\b(figure|fig\.?|table)\s+(S?[0-9]+[A-Za-z]?)\b"
    found = captions.where(F.col(text).isNotNull()).select(
        key, own, F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(mention), 1).alias("before"), F.regexp_extract_all(text, F.lit(mention), 2).alias("kind"), F.regexp_extract_all(text, F.lit(mention), 3).alias("number"))).alias("m")
    )
    target = F.concat(F.when(F.lower("m.kind") == "table", "Table ").otherwise("Figure "), F.col("m.number"))
    low = F.lower("m.before")
    places = [F.struct(F.length(F.regexp_extract(low, rf"^(.*)\b(?:{phrases})\b", 1)).alias("at"), F.lit(name).alias("name")) for name, phrases in REFERENCE_RELATIONS]
    hit = [low.rlike(rf"\b(?:{phrases})\b") for _, phrases in REFERENCE_RELATIONS]
    best = F.array_max(F.array_compact(F.array(*[F.when(h, p) for h, p in zip(hit, places)])))
    rows = found.select(key, own, target.alias("target"), F.coalesce(best["name"], F.lit("references")).alias("relation"))
    return rows.where(~F.array_contains(own, F.col("target")) | F.col(own).isNull()).select(key, "target", "relation").distinct()
