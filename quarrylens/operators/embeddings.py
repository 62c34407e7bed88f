"""Stored vectors: decoding of responses, what is pending, the binary form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def response_items(responses: DataFrame) -> DataFrame:
    """``(chunk_id, model, model_version, received_at, response_id, position, vector)``: items in the order of their index.

    The item of ``index`` n belongs to the n-th of ``target_ids``; items without a target are left out.
    """
    rows = responses.select(
        "response_id", F.lower(F.trim("model")).alias("model"), "model_version", "received_at", "target_ids", F.explode(F.array_sort("data")).alias("item")
    )
    return rows.select(
        F.get("target_ids", F.col("item.index")).alias("chunk_id"), "model", "model_version", "received_at", "response_id",
        F.col("item.index").alias("position"), F.col("item.embedding").alias("vector"),
    ).where("chunk_id is not null")


def usable(vector: Column, dimension: int) -> Column:
    return (F.size(vector) == dimension) & F.exists(vector, lambda x: x != 0)


def latest_vectors(responses: DataFrame, dimension: int) -> DataFrame:
    """``(chunk_id, model, model_version, vector)``: of each chunk, model and version the last usable vector."""
    good = response_items(responses).where(usable(F.col("vector"), dimension))
    last = good.groupBy("chunk_id", "model", "model_version").agg(F.max_by("vector", F.struct("received_at", "response_id")).alias("vector"))
    return last


def pending(chunks: DataFrame, vectors: DataFrame, model: str, version: str) -> DataFrame:
    """``(id)`` of chunks without a vector of the model and version: a left anti-join."""
    have = vectors.where((F.col("model") == model) & F.col("model_version").eqNullSafe(F.lit(version))).select(F.col("chunk_id").alias("id"))
    return chunks.select("id").distinct().join(have, "id", "left_anti")


def normalised(vector: Column) -> Column:
    """The vector at unit length (double sums, float values); a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(vector)


@F.pandas_udf(T.BinaryType())
def encode(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(blobs: pd.Series) -> pd.Series:
    """The floats of a binary vector, null if its length is no multiple of 4."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4").tolist())


def embed(texts: DataFrame, provider, dimension: int, batch: int = 64) -> DataFrame:
    """``(id, vector)`` of ``(id, text)`` through ``provider(list of texts) -> list of vectors``, in batches.

    A batch whose answer has another count or length fails its task, so Spark retries it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for lo in range(0, len(frame), batch):
                part = frame["text"].iloc[lo : lo + batch].fillna("").tolist()
                got = provider(part)
                if len(got) != len(part) or any(len(v) != dimension for v in got):
                    raise ValueError("the provider's vectors don't match the texts")
                out.extend(list(map(float, v)) for v in got)
            yield pd.DataFrame({"id": frame["id"], "vector": out})

    return texts.select("id", "text").mapInPandas(run, "id bigint, vector array<float>")
