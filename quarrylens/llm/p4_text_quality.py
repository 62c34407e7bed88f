"""Problem 4: figures on the words, symbols, lines and repetitions of each text, and its class.

Each line is weighed by its characters and put down as prose, list item, table row or junk by
combined rules; short lines are read in the light of their neighbours.  The class of a text is
the kind that holds most of its characters; what the repetition figures show as filler is junk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

#: Common words of the corpus's languages, whose share marks running text.
COMMON = frozenset(
    "the of and to in is was were are that with for on by at from this these which when than we it be not no as or an a all used under after between but "
    "der die das und ist wurde nicht mit auf den dem des ein eine im von für um nach ob oder "
    "el la los las del y es con por para una un que se "
    "le les des du et est dans sur pour".split()
)
#: Labels of site furniture.
FURNITURE = frozenset(
    "export citation|cookie settings|next article|previous article|privacy policy|download pdf|article metrics|rights and permissions|help center|sign in|log in|"
    "advertisement|share this page|back to top|view article|accept all|reject all|subscribe now|subscribe|related articles|terms of use|terms and conditions|contact us|"
    "about us|my account|register|search|menu|home|skip to main content|skip to content|view pdf|full text|get access|request permissions|add to favorites|"
    "track citations|follow us|site map|sitemap|all rights reserved|loading|read more|show more|cite this article|manage cookies|create account|recommended articles|share|print|copy link".split("|")
)
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()\[\]%/°–—−\-+*=<>~&|·•…’‘“”×±µ²³₀-₉→≈≤≥§#@$^{}\\`©®Å·、。，；：？！（）《》「」]")
_BAD = re.compile(r"[�␀-␦▮▯◊◦¤¦¢£¥€™†‡¶§¿¡\x00-\x08\x0e-\x1fÂÃâ]|\(cid:\d+\)")
_CID = re.compile(r"\(cid:\d+\)")
_HEX = re.compile(r"(?:(?:0x)?[0-9a-fA-F]{2}[\s:]+){5,}(?:[0-9a-fA-F]{2})?\s*$")
_CODED = re.compile(r"[A-Za-z0-9+/=]{40,}")
_LATEX = re.compile(r"\\[a-z]+\s*\{|[{}^_$&\\%#~]{2,}")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}|[aeiou]{4}|q[^u]|[jvxw][bcdfghjkmnpqrstvwxz]|[bcdfghjklmnpqrtvwxz]x|([a-z])\1\1|^[bcdfghjklmnpqrstvwxz]{3}(?<!str)(?<!scr)(?<!spr)(?<!thr)(?<!spl)(?<!shr)(?<!sch)(?<!phr)(?<!chr)")
_VALUE = re.compile(r"[-+~<>≈±]?\d[\d.,]*(?:[eE][-+]?\d+)?%?(?:\s*(?:°C|K|%|h|min|s|nm|mg|mL|eV|V|mol/L))?|n\.?[dam]\.?|–|—|-|nan|null|none", re.I)
_BULLET = re.compile(r"\s*(?:[-*•·▪‣–—+]|\(?\d{1,3}[.)\]]|\[\d{1,3}\]|\(?[a-zA-Z][.)]|\(?[ivx]{1,4}[.)]|\d+(?:\.\d+)+|(?:Step|Item|Part|No\.?)\s\d+[:.)])\s+\S")
_LEADER = re.compile(r"(?:\.{3,}|(?:\. ){3,}|…{2,}|_{4,})\s*(\S.*)$")
_REFERENCE = re.compile(r"\(\d{4}[a-z]?\)\.?\s*$|\bdoi\b|\b\d{1,4}\s?[,:]\s?\d{1,5}\s?[–-]\s?\d{1,5}\b|\bet al\.|^\S+,\s(?:[A-Z]\.\s?)+")
_GLOSS = re.compile(r"^\s*[A-Z][A-Z0-9]{1,7}\s*[—–:=-]\s*\S")
_CELLS = re.compile(r"\t|\s*\|\s*|</t[dh]>\s*<t[dh]>|\s;\s|(?<=\S)\s{2,}(?=\S)")
_PARTS = re.compile(r"\s*;\s+|\s+·\s+|\s+•\s+")
_BLANK = re.compile(r"\n\s*\n")
_NOT_SOLID = re.compile(r"[\W_]+")
_TAG = re.compile(r"</?t(?:r|d|h|able|body|head)\b[^>]*>")
_END = re.compile(r"[.!?。！？…:][\"'”’)\]]*\s*$")
_SENTENCE = re.compile(r"[.!?。！？](?:\s|$|[\"'”’)\]])")
_FURNITURE_SPLIT = re.compile(r"\s*[|·•»>\n\t]\s*|\s{2,}|\s*/\s*")
_FURNITURE_MARK = re.compile(r"[|·•»>\n\t/]|\s\s")
_COUNT = re.compile(r"\s*\(\d+\)\s*$|\s+\d+\s*$")
_KEYWORDS = re.compile(r"(?:keywords?|index terms|key words)\b", re.I)
_NO_END = re.compile(r"[.!?。！？][\"'”’)\]]*$")
#: The first letters of the furniture; no label is shorter.
_STARTS = frozenset(label[:4] for label in FURNITURE)
_PLAIN = frozenset(c for c in map(chr, range(128)) if not _BAD.search(c) and not _ODD.search(c))
_ASCII_NOT_SOLID = bytes(c for c in range(128) if not chr(c).isalnum())
_ASCII_WORDS = bytes(ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)) + bytes([32]) * 128


def _words(text: str) -> list[str]:
    """The lower-cased words of a line."""
    if text.isascii():
        return text.encode().translate(_ASCII_WORDS).decode().split()
    return _WORD.findall(text.lower())


def _furniture(line: str) -> bool:
    if line.isascii() and line.isprintable():
        marked = "|" in line or ">" in line or "/" in line or "  " in line
    else:
        marked = _FURNITURE_MARK.search(line)
    pieces = _FURNITURE_SPLIT.split(line) if marked else [line]
    pieces = [p for p in pieces if p.strip()]
    named = [p for p in pieces if p.lstrip()[:4].lower()[:4] in _STARTS]
    return bool(named) and sum(_COUNT.sub("", p).strip().lower().rstrip(".:") in FURNITURE for p in named) >= 0.6 * len(pieces)


def _garbled(words: list[str], common: int) -> bool:
    """Whether words, so many of them common, look like random letters: no common word and many odd clusters."""
    if len(words) < 4 or common > 0.1 * len(words):
        return False
    plain = [w for w in words if len(w) > 1]
    return bool(plain) and sum(bool(_CLUSTER.search(w)) for w in plain) > 0.3 * len(plain)


def _junk(line: str) -> bool:
    size = len(line) - line.count(" ") - line.count("\t")
    if not size:
        return False
    # printable ASCII has no odd characters
    if not (line.isascii() and line.isprintable()) or "(cid:" in line:
        if "(cid:" in line:
            cid = sum(map(len, _CID.findall(line)))
            if cid > 0.3 * len(line) or len(_BAD.findall(line)) + len(_ODD.findall(line)) > 0.12 * size:
                return True
        # each character by itself: those of one kind at once
        elif sum(line.count(c) * (bool(_BAD.match(c)) + bool(_ODD.match(c))) for c in set(line).difference(_PLAIN)) > 0.12 * size:
            return True
    if line.isascii():
        raw = line.encode()
        solid, marks, more = (len(raw.translate(None, _ASCII_NOT_SOLID)), *(len(raw) - len(raw.translate(None, signs)) for signs in (b"\\{}^_$&", b"%#~")))
    else:
        solid, marks, more = (len(_NOT_SOLID.sub("", line)), *(sum(map(line.count, signs)) for signs in ("\\{}^_$&", "%#~")))
    if solid < 0.2 * size and not (_VALUE.fullmatch(line.strip())):
        return True
    if _HEX.match(line.strip()):
        return True
    if max(map(len, line.split())) >= 40 and sum(map(len, _WORD.findall(line))) > 0.3 * size:
        if any(re.search("[a-z]", m) and re.search("[A-Z]", m) and re.search(r"\d|[+/]", m) for m in _CODED.findall(line)):
            return True
    if marks > 0.2 * size or marks + more > 1 and sum(map(len, _LATEX.findall(line))) > 0.25 * size:
        return True
    return _furniture(line)


def _kind(line: str) -> str:
    """prose, list, table, junk, or what needs its neighbours: value, item, head."""
    if _junk(line):
        return "junk"
    text = _TAG.sub("\t", line).strip() if "<t" in line else line.strip()
    if text != line.strip():
        return "table"
    tokens = text.split()
    apart = "|" in text or " ; " in text or " ".join(tokens) != text  # else there is one cell
    cells = [c for c in _CELLS.split(text.strip("|")) if c.strip()] if apart or "</t" in text else [text]
    words = _words(text)
    common = sum(map(COMMON.__contains__, words))
    longest = max(cells, key=len) if len(cells) > 1 else ""
    if len(longest) > 60 and len(longest) > 0.5 * len(text):
        inner = _words(longest)
        if sum(w in COMMON for w in inner) >= 0.15 * len(inner):
            return "prose"  # a sentence in a cell, or a title beside a page number
    if len(cells) > 1 and len(text) > 40 * len(cells) and common >= 0.15 * len(words):
        return "prose"  # sentences set apart
    if "|" in text and len(cells) >= 2 and ("| " in text or " |" in text):
        return "table"
    if "\t" in text and len(cells) >= 2:
        return "table"
    leader = _LEADER.search(text) if ".." in text or ". ." in text or "…" in text or "__" in text else None
    if leader:
        tail = leader.group(1).strip()
        return "list" if re.fullmatch(r"\d{1,4}|[ivxlc]+", tail) else "table" if _VALUE.match(tail) else "list"
    if _BULLET.match(text) or _GLOSS.match(text):
        return "list"
    if _VALUE.fullmatch(text):
        return "value"
    if len(cells) >= 3 and common < 0.15 * max(1, len(words)):
        if sum(bool(_VALUE.fullmatch(c.strip())) for c in cells) >= 0.2 * len(cells):
            return "table"
        if " ; " in text or max(len(c.split()) for c in cells) <= 2:
            return "table" if " ; " in text or re.search(r"\s{2,}", text) else "list"
    if common < 0.1 * max(1, len(words)):
        commas = text.split(",")
        if len(commas) >= 3 and sum(bool(_VALUE.fullmatch(c.strip())) for c in commas) >= 0.2 * len(commas) and ", " not in text:
            return "table"
        if len(commas) >= 3 and ", " not in text and "." not in text[-1:]:
            return "table"
        if len(tokens) >= 6 and sum(bool(_VALUE.fullmatch(t)) for t in tokens) >= (0.2 if common == 0 else 0.3) * len(tokens):
            return "table"
    if len(words) > 3 and common < 0.25 * len(words) and _REFERENCE.search(text):
        return "list"
    parts = [p for p in _PARTS.split(text) if p] if ";" in text or "·" in text or "•" in text else ()
    if len(parts) >= 4 and len(text) / len(parts) < 45 and common < 0.12 * max(1, len(words)):
        return "list"
    if _KEYWORDS.match(text) and common <= 0.15 * len(words) + 1:
        return "list"
    parts = text.split(", ")
    if len(parts) >= 5 and common < 0.06 * max(1, len(words)) and len(text) / len(parts) < 35:
        return "list"
    if _garbled(words, common):
        return "junk"
    if len(tokens) <= 12 and not _NO_END.search(text) and not text.startswith("#"):
        return "head" if text.endswith(":") else "item"
    return "prose"


def _resolve(lines: list[str], kinds: list[str]) -> list[str]:
    """Short lines by their neighbours: cells among values, items among items, line breaks within prose."""
    out = list(kinds)
    if not {"value", "item", "head"}.intersection(kinds):
        return out
    n = len(lines)
    i = 0
    while i < n:
        if kinds[i] not in ("value", "item"):
            i += 1
            continue
        j = i
        while j < n and kinds[j] in ("value", "item"):
            j += 1
        run = range(i, j)
        values = sum(kinds[k] == "value" for k in run)
        size = j - i
        joined = " ".join(lines[k] for k in run)
        words = [w.lower() for w in _WORD.findall(joined)]
        common = sum(w in COMMON for w in words)
        if size >= 4 and values >= 0.25 * size:
            kind = "table"
        elif _garbled(words, common):
            kind = "junk"
        elif size >= 2 and common >= 0.13 * len(words) and sum(len(lines[k]) for k in run) > 25 * size:
            kind = "prose"  # wrapped lines
        elif size >= 3:
            kind = "list"
        else:
            before, after = (out[i - 1] if i else None), (kinds[j] if j < n else None)
            kind = before if before in ("list", "table", "junk") else after if after in ("list", "table", "junk") else "prose"
        for k in run:
            out[k] = kind
        i = j
    for k, kind in enumerate(out):
        if kind == "head":
            after = out[k + 1] if k + 1 < n else None
            out[k] = after if after in ("list", "table") else "prose"
    return out


def _repetition(words: list[str], bounds: tuple[float, ...] = ()) -> tuple[float, float, float, float]:
    """For 2, 3 and 4 words the share of the words' characters in occurrences of the most frequent n-gram, and the share of repeated 4-grams.

    With bounds all are 0 where no share can be above its bound, nor more than half of the 4-grams repeated.
    """
    shares, size = [0.0, 0.0, 0.0], sum(map(len, words))
    for k, width in enumerate((2, 3, 4)):
        if len(words) < 2 * width:
            break
        counts = Counter(zip(*(words[i:] for i in range(width))))
        n = max(counts.values())
        if n == 1:
            break  # nor does any longer one occur again
        if bounds and width == n == 2:  # the longer ones occur twice at most
            longest = sorted(map(len, words))[-4:]
            if all(n * sum(longest[-k:]) / size <= bound for k, bound in zip((2, 3, 4), bounds)):
                return (0.0,) * 4
        gram = next(g for g, m in counts.items() if m == n)
        shares[k] = min(1.0, n * sum(map(len, gram)) / max(1, size))
        if width == 4:
            return (*shares, 1 - len(counts) / (len(words) - 3))
    return (*shares, 0.0)


def text_class(text: str | None) -> str:
    """prose, list, table, junk, or empty for null and blank texts."""
    kind = _line_class(text)
    return "junk" if kind in ("prose", "list") and _filler(text, kind) else kind


def measured(text: str | None) -> tuple[tuple, str]:
    """The figures of one text and its class, which reads the repetition figures."""
    figures, repeated = _figures(text)
    kind = _line_class(text)
    return figures, "junk" if kind in ("prose", "list") and _filler(text, kind, (figures, repeated)) else kind


#: From how many words on which coverage by one 2-, 3- or 4-gram is filler; few words repeat some by chance.
FILLER = ((100, (0.20, 0.18, 0.16)), (50, (0.40, 0.36, 0.32)))


def _filler(text: str, kind: str, known: tuple[tuple, float] | None = None) -> bool:
    """Whether the same lines, paragraphs or sentences make up most of the text; of its figures only what is asked is made."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) >= 6 and 1 - len(set(lines)) / len(lines) > 0.6:
        return True
    paragraphs = [x.strip() for x in _BLANK.split(text) if x.strip()] if "\n" in text else ()
    if len(paragraphs) >= 4 and 1 - len(set(paragraphs)) / len(paragraphs) > 0.6:
        return True
    if kind == "list":
        return False  # entries of one form share words
    if known is None:
        words = [w for line in lines for w in _words(line)]
        n_words = len(words)
    else:
        n_words = known[0][0]
    for least, bounds in FILLER:
        if n_words >= least:
            *grams, repeated = _repetition(words, bounds) if known is None else (*known[0][9:], known[1])
            return repeated > 0.5 or any(share > bound for share, bound in zip(grams, bounds))
    return False


def _line_class(text: str | None) -> str:
    if text is None or not text.strip():
        return "empty"
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = _resolve(lines, [_kind(x) for x in lines])
    share = Counter()
    for line, kind in zip(lines, kinds):
        share[kind] += len(line.strip())
    if len(lines) >= 6 and max(Counter(x.strip() for x in lines).values()) > 0.6 * len(lines):
        return "junk"  # the same line again and again is filler
    return max(("prose", "list", "table", "junk"), key=lambda k: share[k])


def statistics(text: str | None) -> tuple:
    """The figures of one text; all are 0 for null and blank texts."""
    return _figures(text)[0]


def _figures(text: str | None) -> tuple[tuple, float]:
    """The figures and the share of repeated 4-grams."""
    text = text or ""
    words = _WORD.findall(text.lower())
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    paragraphs = [x.strip() for x in _BLANK.split(text) if x.strip()]
    visible = len(text) - sum(map(text.count, " \t\n\r"))
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    n = len(words)
    *coverage, repeated = _repetition(words)
    figures = (
        n,
        letters / n if n else 0.0,
        max(0, visible - letters - digits) / visible if visible else 0.0,
        digits / visible if visible else 0.0,
        sum(bool(_END.search(x)) for x in lines) / len(lines) if lines else 0.0,
        sum(map(COMMON.__contains__, words)) / n if n else 0.0,
        sum(bool(_BULLET.match(x)) for x in lines) / len(lines) if lines else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
        *coverage,
    )
    return figures, repeated


STATISTICS = (
    "n_words int, mean_word_length double, symbol_ratio double, digit_ratio double, line_end_share double, common_share double, bullet_share double, "
    "duplicate_lines double, duplicate_paragraphs double, top_2gram double, top_3gram double, top_4gram double"
)


def quality(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, figures..., text_class)`` of the texts ``(id, text)``, one row per id.

    Null, empty and blank texts get figures of 0 and the class ``empty``; repeated rows count
    once.  Texts are read whole.
    """
    chunks = need(chunks, ["id", "text"], "quality").where("id is not null")
    names = [c.split()[0] for c in STATISTICS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures, classes = zip(*map(measured, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            columns = list(zip(*figures)) or [()] * len(names)
            arrays = [pa.array(columns[0], pa.int32())] + [pa.array(c, pa.float64()) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(classes, pa.string())], names=["chunk_id", *names, "text_class"])

    return chunks.mapInArrow(run, f"chunk_id bigint, {STATISTICS}, text_class string").dropDuplicates(["chunk_id"])


def classes(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, text_class)`` of ``quality``, without the figures that no class is told by."""
    chunks = need(chunks, ["id", "text"], "classes").where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.array(map(text_class, batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), told], names=["chunk_id", "text_class"])

    return chunks.mapInArrow(run, "chunk_id bigint, text_class string").dropDuplicates(["chunk_id"])


def found(chunks: DataFrame) -> DataFrame:
    """``p4_found``: (chunk_id, text_class) of the texts that are mostly list, table or junk."""
    return classes(chunks).where("text_class in ('list', 'table', 'junk')")


def against_classifier(chunks: DataFrame, classifications: DataFrame) -> DataFrame:
    """``(text_class, chunk_kind, chunks, mean_usefulness, skipped)``: our class and the stored rough one.

    Of several stored rows of a chunk the latest counts; chunks without one have a null kind.
    """
    stored = need(
        classifications, ["chunk_id", "chunk_kind", "usefulness_score", "skip_reason", "classifier_version", "classified_at"], "against_classifier"
    )
    latest = stored.groupBy("chunk_id").agg(
        F.max_by(F.struct("chunk_kind", "usefulness_score", "skip_reason"), F.struct("classified_at", "classifier_version")).alias("s")
    )
    return (
        quality(chunks).select("chunk_id", "text_class")
        .join(latest, "chunk_id", "left")
        .groupBy("text_class", F.col("s.chunk_kind").alias("chunk_kind"))
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            F.round(F.avg("s.usefulness_score"), 6).alias("mean_usefulness"),
            F.count(F.when(F.coalesce(F.col("s.skip_reason"), F.lit("")) != "", 1)).alias("skipped"),
        )
    )
