"""Server-sent events and message pages as rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frames(body: Column) -> Column:
    """The events of a stream's text, parted by blank lines; the last may be unfinished."""
    plain = F.regexp_replace(body, r"\r\n", "\n")
    return F.filter(F.split(plain, "\n\n"), lambda x: F.trim(x) != "")


def deltas(body: Column) -> Column:
    """The text pieces of the events' ``data:`` lines, without the closing mark."""
    data = F.transform(frames(body), lambda e: F.trim(F.regexp_extract(e, r"(?m)^data:(.*)$", 1)))
    texts = F.transform(F.filter(data, lambda d: (d != "") & (d != "[DONE]")), lambda d: F.get_json_object(d, "$.choices[0].delta.content"))
    return F.filter(texts, lambda t: t.isNotNull())


def partial_string(prefix: Column, field: str) -> Column:
    """A string field of a JSON text that may be cut within it, common escapes undone."""
    raw = F.regexp_extract(prefix, rf'"{field}"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    out = F.replace(F.replace(raw, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(F.replace(out, F.lit("\\t"), F.lit("\t")), F.lit("\\\\"), F.lit("\\"))
