"""Sections, captions and overlapping chunks of article bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.clean import clean_text, primary_body, with_layers, without_frontmatter
from ..functions.text import strip

_HEADING_LINE = re.compile(r"\s*(#{1,6})\s*([^#\s].*)")
_BLANKS = re.compile(r"\n{3,}")
_EDGE_SIGNS = re.compile(r"^[\W_]+|[\W_]+$")
_CAPTION_LABEL = r"[\p{IsAlphabetic}\p{N}-]*[0-9][\p{IsAlphabetic}\p{N}-]*(?:,[\p{IsAlphabetic}\p{N}-]+)*"


def cleaned_bodies(articles: DataFrame) -> DataFrame:
    """``(paper_key, body)``: primary bodies cleaned by the row's ``source``, if there is one; null bodies are left out."""
    rows, layers = with_layers(articles.where("raw_body is not null"))
    rows = rows.withColumn("_body", primary_body(without_frontmatter(F.col("raw_body"))))
    return rows.select("paper_key", clean_text(F.col("_body"), layers).alias("body"))


def split_sections(body: str) -> list[tuple[str, int, str]]:
    """``(title, level, content)`` of a cleaned body; see ``sections``."""
    heads: list[tuple[str, int]] = []
    contents: list[list[str]] = [[]]
    for line in body.split("\n"):
        head = _HEADING_LINE.match(line)
        if head is None:
            contents[-1].append(line)
            continue
        heads.append((head[2].strip(), len(head[1])))
        if len(heads) > 1:  # text before the first heading joins its section
            contents.append([])
    found = [(title, level, _BLANKS.sub("\n\n", "\n".join(c)).strip()) for (title, level), c in zip(heads or [("Body", 1)], contents)]
    return [s for s in found if s[2] and _EDGE_SIGNS.sub("", s[0]).lower() not in rules.REFERENCE_TITLES]


def sections(articles: DataFrame) -> DataFrame:
    """``(paper_key, position, title, level, content)`` of ``(paper_key, raw_body[, source])``, positions from 0.

    The body is cleaned by the rules of its source, then ``#`` headings open sections; text
    before the first joins it; a body without headings is one ``Body``.  Empty sections and
    reference sections are left out, and so are null bodies.  An article is cut within its row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, i, *s) for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, s in enumerate(split_sections(body))]
            yield _batch(rows, "paper_key string, position int, title string, level int, content string")

    return cleaned_bodies(articles).mapInArrow(cut, "paper_key string, position int, title string, level int, content string")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of strings and ints as a batch."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if kind == "int" else pa.string()) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def article_chunks(articles: DataFrame, size: int = rules.CHUNK_CHARS, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """``(paper_key, chunk_index, section, section_kind, caption_label, object_type, object_label, text, chunk_hash)``.

    The sections of each article, then its figure captions and its table captions as sections of
    their own, are split into overlapping pieces, numbered through the article.  An article is
    cut within its row.
    """
    found = F.array_compact(F.transform(F.split("body", "\n"), caption_of_line))
    bodies = cleaned_bodies(articles).select("paper_key", "body", found.alias("captions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body, captions in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [(title, content) for title, _, content in split_sections(body)]
                for tables in (False, True):
                    own = [c for c in captions if c["label"].startswith(("Table ", "表 ")) == tables]
                    parts += [(f"{c['label']} Caption", f"{c['label']}: {c['text']}" if c["text"] else c["label"]) for c in own]
                pieces = [(title, piece) for title, content in parts for piece in split_text(content, size, overlap)]
                rows.extend((key, i, title, piece) for i, (title, piece) in enumerate(pieces))
            yield _batch(rows, "paper_key string, chunk_index int, section string, text string")

    pieces = bodies.mapInArrow(cut, "paper_key string, chunk_index int, section string, text string")
    label = F.when(F.col("section").endswith(" Caption"), F.regexp_replace("section", " Caption$", ""))
    labelled = pieces.withColumn("section_kind", section_kind(F.col("section"))).withColumn("caption_label", label)
    return labelled.withColumn("c", caption_object(F.col("caption_label"))).select(
        "paper_key", "chunk_index", "section", "section_kind", "caption_label", F.col("c.object_type").alias("object_type"),
        F.col("c.object_label").alias("object_label"), "text", F.sha2("text", 256).alias("chunk_hash"),
    )


def section_kind(title: Column) -> Column:
    low = F.lower(title)
    return (
        F.when((low.startswith("figure") & low.contains("caption")) | low.startswith("fig ") | low.startswith("图 "), "figure_caption")
        .when((low.startswith("table") & low.contains("caption")) | low.startswith("表 "), "table_caption")
        .otherwise("body")
    )


def caption_of_line(line: Column) -> Column:
    """``struct(label, text)`` of a figure or table caption line, else null."""
    plain = F.replace(F.replace(F.translate(line, " ‐‑–—", " ----"), F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    plain = strip(F.regexp_replace(plain, r"^[-* ]+", ""))
    english = rf"(?i)^(figure|fig|table)(?=[.\s0-9])\.*\s*({_CAPTION_LABEL})\s*[.:|)-]*\s*(.*)$"
    cjk = rf"^(图|表)\s*({_CAPTION_LABEL})\s*[.:|)-]*\s*(.*)$"
    kind = F.lower(F.regexp_extract(plain, english, 1))
    name = F.when(kind == "table", "Table").otherwise("Figure")
    return F.when(
        plain.rlike(english),
        F.struct(F.concat(name, F.lit(" "), F.regexp_extract(plain, english, 2)).alias("label"), F.regexp_extract(plain, english, 3).alias("text")),
    ).when(
        plain.rlike(cjk),
        F.struct(F.concat_ws(" ", F.regexp_extract(plain, cjk, 1), F.regexp_extract(plain, cjk, 2)).alias("label"), F.regexp_extract(plain, cjk, 3).alias("text")),
    )


def captions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no, label, caption)`` of the caption lines of the texts, lines from 0."""
    rows = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    found = rows.withColumn("c", caption_of_line(F.col("line"))).where("c is not null")
    return found.select(key, "line_no", F.col("c.label").alias("label"), F.col("c.text").alias("caption"))


def caption_object(label: Column) -> Column:
    """``struct(object_type, object_label, panels, targets)`` of a caption label such as ``Figure S2a,b`` or ``Table 3-5``.

    Panel lists, panel ranges, object ranges of at most 51 and trailing panels are spread out;
    anything else is an object by itself.  Labels of other objects give null.
    """
    prefix, tail = F.regexp_extract(label, r"^\s*(\S+)\s+(.*\S)\s*$", 1), F.regexp_extract(label, r"^\s*(\S+)\s+(.*\S)\s*$", 2)
    low = F.lower(prefix)
    kind = F.when(low.isin("figure", "fig") | (prefix == "图"), "figure").when((low == "table") | (prefix == "表"), "table")
    panel_list = r"^(.*[0-9])([A-Za-z])((?:\s*,\s*[A-Za-z])+)$"
    panel_range = r"^(.*[0-9])([A-Za-z])\s*-\s*([A-Za-z])$"
    object_range = r"^([A-Za-z]*)([0-9]+)\s*-\s*([A-Za-z]*)([0-9]+)$"
    trailing = r"^(.*[0-9])([A-Za-z])$"

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(tail, pattern, i)

    def letters(first: Column, last: Column) -> Column:
        a, b = F.ascii(first), F.ascii(last)
        ordered = (a <= b) & ((F.lower(first) == first) == (F.lower(last) == last))
        return F.when(ordered, F.transform(F.sequence(a, F.greatest(a, b)), lambda c: F.char(c))).otherwise(F.array(first, last))

    no_panels = F.array().cast("array<string>")
    listed = F.concat(F.array(part(panel_list, 2)), F.filter(F.transform(F.split(part(panel_list, 3), ","), F.trim), lambda p: p != ""))
    ranged = letters(part(panel_range, 2), part(panel_range, 3))
    lo, hi = part(object_range, 2).try_cast("long"), part(object_range, 4).try_cast("long")
    same = part(object_range, 3).isin("") | (part(object_range, 3) == part(object_range, 1))
    is_range = tail.rlike(object_range) & same & (lo <= hi) & (hi - lo <= 50)
    spread = F.transform(F.sequence(lo, F.when(is_range, hi).otherwise(lo)), lambda n: F.concat(part(object_range, 1), n.cast("string")))

    def made(base: Column, panels: Column, targets: Column | None = None) -> Column:
        targets = targets if targets is not None else F.transform(panels, lambda p: F.concat(base, p))
        named = F.transform(targets, lambda t: F.concat(prefix, F.lit(" "), t))
        return F.struct(kind.alias("object_type"), base.alias("object_label"), panels.alias("panels"), named.alias("targets"))

    return F.when(
        kind.isNotNull(),
        F.when(tail.rlike(panel_list), made(part(panel_list, 1), listed))
        .when(tail.rlike(panel_range), made(part(panel_range, 1), ranged))
        .when(is_range, made(tail, no_panels, spread))
        .when(tail.rlike(trailing), made(part(trailing, 1), F.array(part(trailing, 2))))
        .otherwise(made(tail, no_panels, F.array(tail))),
    )


def caption_values(text: Column) -> Column:
    """``struct(measurements, named)``: numbers with a unit, and those led by a known metric, unique ignoring case."""
    from ..functions.text import unique_folded

    unit = r"(?:%|°C|K\b|mol/L|min\b|h\b|s\b|nm\b|mV\b|V\b|mA\b|g\b|mg\b|eV\b)"
    number = r"[-+−]?[0-9][0-9.]*"
    metrics = "|".join(sorted(rules.METRIC_PHRASES, key=len, reverse=True))
    measures = F.regexp_extract_all(text, F.lit(rf"({number}\s?{unit})"), 1)
    named = F.regexp_extract_all(
        text, F.lit(rf"(?i)((?:{metrics})(?: (?:of|is|are|was|were|near|reached|showed|gave))* {number}\s?{unit})"), 1
    )
    return F.struct(unique_folded(measures).alias("measurements"), unique_folded(named).alias("named"))


def relation_paths(relations: DataFrame) -> DataFrame:
    """Two-hop paths of ``(key, subject, relation, object)``: the object of one is the subject of the next, ends differ."""
    a = relations.select("key", F.col("subject").alias("start"), F.col("relation").alias("first"), F.col("object").alias("via"))
    b = relations.select("key", F.col("subject").alias("via"), F.col("relation").alias("second"), F.col("object").alias("end"))
    return a.join(b, ["key", "via"]).where("start <> end").select("key", "start", "first", "via", "second", "end").distinct()


def split_text(text: str | None, size: int = rules.CHUNK_CHARS, overlap: int = rules.CHUNK_OVERLAP) -> list[str]:
    """Windows of at most ``size`` characters, cut after the last line or sentence end of their second half."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    pieces, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            half = start + size // 2
            cut = max(text.rfind(mark, half, end) for mark in "\n。.")
            end = cut + 1 if cut >= half else end
        piece = text[start:end].strip()
        if piece:
            pieces.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return pieces


def split_chunks(texts: DataFrame, key: str, text: str, size: int = rules.CHUNK_CHARS, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """``(key, piece, text)``: each text in overlapping pieces numbered from 0; null and blank texts give none."""
    kind = dict(texts.dtypes)[key]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, numbers, pieces = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for n, piece in enumerate(split_text(value, size, overlap)):
                    owners.append(i)
                    numbers.append(n)
                    pieces.append(piece)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], names=[key, "piece", "text"]
            )

    return texts.select(key, text).mapInArrow(split, f"{key} {kind}, piece int, text string")


def page_text(text: str, size: int) -> list[str]:
    """Pages of at most ``size`` characters, cut at a blank line, else a line end, past the half if there is one."""
    pages, rest = [], text.strip()
    while len(rest) > size:
        window = rest[:size]
        cut = max(window.rfind("\n\n"), -1)
        cut = cut if cut > size // 2 else window.rfind("\n")
        cut = cut if cut > size // 2 else size
        pages.append(rest[:cut].rstrip())
        rest = rest[cut:].lstrip()
    return [p for p in [*pages, rest] if p]


def message_pages(texts: DataFrame, key: str, text: str, size: int = 3900) -> DataFrame:
    """``(key, page, text)``: each text in pages numbered from 0; null and blank texts give none."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [(i, n, p) for i, value in enumerate(batch.column(1).to_pylist()) for n, p in enumerate(page_text(value or "", size))]
            owners, numbers, pages = zip(*cut) if cut else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(numbers, pa.int32()), pa.array(pages, pa.string())], names=[key, "page", "text"]
            )

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, page int, text string")


def section_fact_type(section: Column, kind: Column) -> Column:
    """The fact type of a section, null for none."""
    low = F.lower(section)
    out = F.when(kind.isin("figure_caption", "table_caption"), kind)
    for name, needles in rules.SECTION_FACTS:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | low.contains(needle)
        out = out.when(hit, name)
    return out


def analysis_context(parts: DataFrame, limit: int = 12_000) -> DataFrame:
    """``(paper_key, context)``: preferred sections, then the last 5000 characters, cut to ``limit``."""
    preferred = ["abstract", "introduction", "results", "results and discussion", "discussion", "conclusions", "conclusion"]
    entry = F.struct("position", "title", "content")
    grouped = parts.groupBy("paper_key").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    whole = F.array_join(F.transform("all", lambda s: s["content"]), "\n\n")
    chosen = F.transform(
        F.filter("all", lambda s: F.lower(s["title"]).isin(preferred)), lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), s["content"])
    )
    text = F.when(F.size(chosen) == 0, whole).otherwise(F.array_join(F.concat(chosen, F.array(F.concat(F.lit("## Tail Context\n"), F.right(whole, F.lit(5000))))), "\n\n"))
    return grouped.select("paper_key", F.left(text, F.lit(limit)).alias("context"))


__all__ = [
    "analysis_context", "article_chunks", "cleaned_bodies", "caption_object", "caption_of_line", "caption_values", "captions", "message_pages", "page_text", "relation_paths", "section_fact_type",
    "section_kind", "sections", "split_chunks", "split_sections", "split_text",
]
