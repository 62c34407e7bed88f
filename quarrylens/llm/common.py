"""Shared helpers of the llm subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import cut_lineage

__all__ = ["cut_lineage", "need", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, columns: Iterable[str], operator: str) -> DataFrame:
    """Only the named columns (extra or clashing ones are dropped); an error names what is missing."""
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{operator}: missing columns {missing}")
    return df.select(*columns)
