"""Registered queries of the llm subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import p1_similar_vectors as p1
from . import p2_near_duplicates as p2
from . import p3_broken_pairs as p3
from . import p4_text_quality as p4
from . import p5_scanned as p5
from . import p6_leaks as p6
from . import p7_mixture as p7
from . import p8_reading_level as p8
from .common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.found(table(spark, sf_dir, "embedding_responses"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of each whose id is divisible by 50."""
    vectors = p1.response_vectors(table(spark, sf_dir, "embedding_responses"))
    return p1.neighbours(vectors, of="id % 50 = 0")


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.recall(table(spark, sf_dir, "embedding_responses"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.found(table(spark, sf_dir, "papers"), table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.broken_pairs(table(spark, sf_dir, "qa_logs"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.defect_report(table(spark, sf_dir, "qa_logs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.found(table(spark, sf_dir, "chunks"))


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.quality(table(spark, sf_dir, "chunks"))


def p4_against_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4.against_classifier(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_classifications"))


def _p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.records(table(spark, sf_dir, "pdf_extracts"), table(spark, sf_dir, "articles"), table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.noise(_p5_records(spark, sf_dir), table(spark, sf_dir, "papers"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned texts as running paragraphs."""
    return p5.repaired(_p5_records(spark, sf_dir), table(spark, sf_dir, "papers"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "golden_items"))


def p6_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of each document and item, and where it starts."""
    return p6.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "golden_items"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak nothing."""
    kept = p6.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "golden_items"))
    return kept.select("doc_id", "source", "n_chars")


def _p7_mix(spark: SparkSession, sf_dir: str, **how) -> p7.Mixture:
    return p7.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), **how)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation at a budget of all tokens of the listed sources, a row for each copy taken."""
    return _p7_mix(spark, sf_dir, budget=p7.ALL_TOKENS).rows


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual shares at the largest budget that meets every target."""
    return p7.report(_p7_mix(spark, sf_dir, budget=p7.MEET_TARGETS))


def p7_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual shares of ``p7_mixture``: small sources are tempered to their repetitions."""
    return p7.report(_p7_mix(spark, sf_dir, budget=p7.ALL_TOKENS))


def p7_report_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual shares of plain temperature mixing at the entropy of the targets."""
    return p7.report(_p7_mix(spark, sf_dir, budget=p7.ALL_TOKENS, tempered=True))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source have each reading level."""
    return p8.profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: query
        for name, query in globals().items()
        if re.match(r"p\d_", name)
    }


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLE

    return dict(ORACLE)
