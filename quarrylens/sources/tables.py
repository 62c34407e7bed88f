"""Tables: reading, partition-wise writing, backup, schema evolution."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is ``spark.checkpoint.dir``; only where neither it nor a checkpoint directory is
    set and Spark runs on this machine alone (tests) a temporary one is used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions of ``by`` that occur in the rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def backup(spark: SparkSession, paths: dict[str, str], target: str) -> None:
    """Copy tables below ``target``; fails if one is there already or a source is missing."""
    for name, path in paths.items():
        spark.read.parquet(path).write.mode("errorifexists").parquet(f"{target}/{name}.parquet")


def with_columns_of(rows: DataFrame, other: DataFrame) -> DataFrame:
    """The rows with the columns of ``other`` that they lack, as nulls."""
    kinds = dict(other.dtypes)
    return rows.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in other.columns if c not in rows.columns])


def redacted(value):
    """The first and last four characters of a secret; eight and fewer become stars."""
    return F.when(F.length(value) <= 8, F.lit("********")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))
