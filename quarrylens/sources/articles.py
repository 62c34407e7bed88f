"""Article folders ``root/author/paper_id/article.md`` with an optional ``fetch-result.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import without_frontmatter

_PATH = r"([^/]+)/([^/]+)/[^/]+$"


def scan(spark: SparkSession, root: str, author: str | None = None) -> DataFrame:
    """``(author, paper_id, article_path, modified_at, content)``; an author reads only their folder, a missing root gives none."""
    pattern = f"{root}/{author or '*'}/*"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "article.md").option("ignoreMissingFiles", "true")
    try:
        files = reader.load(pattern)
    except Exception as error:  # the folder is missing
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "author string, paper_id string, article_path string, modified_at timestamp, content binary")
    return files.select(
        F.regexp_extract("path", _PATH, 1).alias("author"), F.regexp_extract("path", _PATH, 2).alias("paper_id"),
        F.col("path").alias("article_path"), F.col("modificationTime").alias("modified_at"), "content",
    )


def _side_cars(spark: SparkSession, root: str, author: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "fetch-result.json")
    try:
        files = reader.load(f"{root}/{author or '*'}/*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "author string, paper_id string, fetch_result string")
    return files.select(
        F.regexp_extract("path", _PATH, 1).alias("author"), F.regexp_extract("path", _PATH, 2).alias("paper_id"), F.decode("content", "UTF-8").alias("fetch_result")
    )


def frontmatter(text):
    """``map<string,string>`` of the ``key: value`` lines of a closed ``---`` block at the start; empty without one."""
    block = F.regexp_extract(F.regexp_replace(text, r"\r\n?", "\n"), r"(?s)\A---[ \t]*\n(.*?)\n?---[ \t]*(?:\n|\z)", 1)
    rows = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[^#\s][^:]*:"))
    pairs = F.transform(
        rows,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("value"),
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def load(spark: SparkSession, root: str, author: str | None = None) -> DataFrame:
    """Articles as rows: ``(paper_key, author, paper_id, article_path, modified_at, metadata, fetch_result, raw_body)``."""
    text = F.decode("content", "UTF-8")
    articles = scan(spark, root, author).select("author", "paper_id", "article_path", "modified_at", text.alias("text"))
    joined = articles.join(_side_cars(spark, root, author), ["author", "paper_id"], "left")
    return joined.select(
        F.concat_ws("/", "author", "paper_id").alias("paper_key"), "author", "paper_id", "article_path", "modified_at",
        frontmatter(F.col("text")).alias("metadata"), "fetch_result", without_frontmatter(F.col("text")).alias("raw_body"),
    )
