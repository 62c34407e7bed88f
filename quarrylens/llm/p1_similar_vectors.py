"""Problem 1: the most similar vectors of every vector, by a permutation index.

Pivots are a bounded sample of the vectors (``pivots_for``).  A vector is represented by its
``depth`` nearest pivots in order and posted in the inverted file of each of them.  Within a
pivot's file the members are ranked for each other by the Spearman footrule distance of their
pivot orders (a missing pivot has rank ``depth``), and the nearest ``rerank`` by footrule, with
all that tie with the last of them, are reranked by cosine.

Postings carry vectors as half floats, so cosines are right to about 0.0001.  A file of more
than ``direct`` members is a collection of its own: it has pivots of its own, chosen among its
members, and inverted files under them, so that work a vector stays the same when there are far
more vectors than pivots.  A file of more than ``block`` members is split into blocks of which
every pair is compared in a task of its own.  All vectors are indexed and no file is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut_lineage, need


@dataclass(frozen=True)
class PermutationIndex:
    dimension: int = 128
    depth: int = 6
    per_pivot: int = 50
    max_pivots: int = 8192
    rerank: int = 96
    direct: int = 3000
    block: int = 40_000

    def pivots_for(self, n: int) -> int:
        """One pivot for ``per_pivot`` vectors, 16 at least and ``max_pivots`` (4 MB at 128 numbers) at most."""
        return max(16, min(self.max_pivots, n // self.per_pivot))


def response_vectors(responses: DataFrame, model_version: str = "v2", dimension: int = 128) -> DataFrame:
    """``(id, vector binary)``: one unit-length vector per chunk of the model version.

    The vector at ``index`` n belongs to the n-th of ``target_ids``.  Vectors that are null, of
    another length, all zero or not finite are left out, as are items without a target; of a
    chunk that was sent again the latest response counts.
    """
    responses = need(responses, ["response_id", "model_version", "target_ids", "data", "received_at"], "response_vectors")
    items = responses.where(F.col("model_version") == model_version).select(
        "response_id", "received_at", "target_ids", F.explode("data").alias("item")
    )
    items = items.select(
        F.get("target_ids", F.col("item.index")).alias("id"),
        F.col("item.embedding").alias("embedding"),
        F.struct("received_at", "response_id").alias("version"),
    ).where((F.col("id").isNotNull()) & (F.size("embedding") == dimension))
    latest = items.where(F.exists("embedding", lambda x: x != 0)).groupBy("id").agg(F.max_by("embedding", "version").alias("embedding"))

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimension)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            unit = (x[ok] / norm[ok, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(ok)), pa.array([v.tobytes() for v in unit], pa.binary())], names=["id", "vector"]
            )

    return latest.mapInArrow(normalised, "id bigint, vector binary")


def _matrix(column: pa.Array, dtype: str = "<f4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def _nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each vector, in order."""
    out = np.empty((len(vectors), depth), dtype=np.int32)
    for lo in range(0, len(vectors), 1000):
        likeness = vectors[lo : lo + 1000] @ pivots.T
        near = np.argpartition(-likeness, depth - 1, axis=1)[:, :depth]
        out[lo : lo + 1000] = np.take_along_axis(near, np.argsort(-np.take_along_axis(likeness, near, 1), axis=1, kind="stable"), 1)
    return out


def _represented(vectors: DataFrame, pivots: np.ndarray, spec: PermutationIndex) -> DataFrame:
    """``(id, ranks, vector)``: the nearest pivots of each vector in order, and the vector as half floats."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    depth = min(spec.depth, len(pivots))

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            order = _nearest_pivots(x, shared.value, depth) if len(x) else np.zeros((0, depth))
            ranks = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * depth, pa.int32()), pa.array(order.ravel().astype(np.int16)))
            halves = pa.array([v.tobytes() for v in x.astype("<f2")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ranks, halves], names=["id", "ranks", "vector"])

    return vectors.select("id", "vector").mapInArrow(represent, "id bigint, ranks array<smallint>, vector binary")


def _postings(represented: DataFrame) -> DataFrame:
    """``(pivot, id, ranks, vector)``: a row for each of a vector's nearest pivots."""
    return represented.select(F.explode("ranks").alias("pivot"), "id", "ranks", "vector")


def _blocks(postings: DataFrame, spec: PermutationIndex) -> DataFrame:
    """Each file split into blocks of about ``spec.block`` rows; every pair of its blocks gets a key.

    A file of one block keeps its rows once, one of ``s`` blocks repeats a row ``s`` times.
    """
    lengths = postings.groupBy("pivot").count().select(
        "pivot", F.ceil(F.col("count") / spec.block).cast("int").alias("parts")
    )
    # at most max_pivots rows of 12 bytes
    rows = postings.join(F.broadcast(lengths), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return rows.select("*", other).select(
        "pivot", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "ranks", "vector"
    )


def _ranked(ranks: np.ndarray, vectors: np.ndarray, part: np.ndarray | None, spec: PermutationIndex, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, cosine)`` of up to ``k`` nearest members ``j`` of each member ``i``, footrule first.

    With ``part`` only members of different parts are compared.
    """
    n, depth = ranks.shape
    used, local = np.unique(ranks, return_inverse=True)
    local = local.reshape(n, depth)
    # depth - rank for the pivots of a member, else 0: the footrule is a constant less twice the shared minimum
    level = np.zeros((len(used), n), dtype=np.uint8)
    for r in range(depth):
        level[local[:, r], np.arange(n)] = depth - r
    keep, k = min(spec.rerank, n - 1), min(k, n - 1)
    found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)]
    for start in range(0, n if keep > 0 else 0, 128):
        rows = np.arange(start, min(n, start + 128))
        shared = np.zeros((len(rows), n), dtype=np.uint8)
        for r in range(depth):
            shared += np.minimum(level[local[rows, r]], np.uint8(depth - r))
        shared[np.arange(len(rows)), rows] = 0
        if part is not None:
            shared[part[rows][:, None] == part[None, :]] = 0
        last = np.maximum(np.partition(shared, n - keep, axis=1)[:, n - keep], 1)
        cosine = vectors[rows] @ vectors.T
        cosine[shared < last[:, None]] = -2
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(cosine, near, 1)
        q, c = np.nonzero(best >= max(least, -1.5))
        found.append((rows[q], near[q, c], best[q, c]))
    i, j, c = zip(*found)
    return np.concatenate(i), np.concatenate(j), np.concatenate(c)


def _indexed(vectors: np.ndarray, part: np.ndarray | None, spec: PermutationIndex, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a large file: a permutation index of its own, with evenly spread members as pivots."""
    n = len(vectors)
    pivots = vectors[np.linspace(0, n - 1, max(16, n // spec.per_pivot)).astype(int)]
    ranks = _nearest_pivots(vectors, pivots, min(spec.depth, len(pivots)))
    member = np.repeat(np.arange(n), ranks.shape[1])
    order = np.argsort(ranks.ravel(), kind="stable")
    found = []
    for file in np.split(member[order], np.cumsum(np.bincount(ranks.ravel(), minlength=len(pivots)))[:-1]):
        if len(file) < 2:
            continue
        inner = part[file] if part is not None else None
        # equal ranks can make a file as long as the whole; its blocks are compared pair by pair
        pieces = np.array_split(np.arange(len(file)), -(-len(file) // (2 * spec.direct)))
        for a in range(len(pieces)):
            for b in range(a, len(pieces)):
                at = pieces[a] if a == b else np.concatenate((pieces[a], pieces[b]))
                i, j, c = _ranked(ranks[file[at]], vectors[file[at]], inner[at] if inner is not None else None, spec, k, least)
                found.append((file[at[i]], file[at[j]], c))
    i, j, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    # the k best of each member over its files
    _, once = np.unique(i * n + j, return_index=True)
    i, j, c = i[once], j[once], c[once]
    order = np.lexsort((j, -c, i))
    i, j, c = i[order], j[order], c[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], c[place < k]


def _neighbours_in(spec: PermutationIndex, k: int, least: float):
    def nearest(block: pa.Table) -> pa.Table:
        ids = block.column("id").combine_chunks().to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        block = block.take(pa.array(order))
        vectors = _matrix(block.column("vector").combine_chunks(), "<f2").astype(np.float32)
        # pairs within a block belong to that block's own task
        part = block.column("part").combine_chunks().to_numpy() if block.column("lo")[0].as_py() != block.column("hi")[0].as_py() else None
        if len(ids) > spec.direct:
            i, j, c = _indexed(vectors, part, spec, k, least)
        else:
            i, j, c = _ranked(block.column("ranks").combine_chunks().flatten().to_numpy().reshape(len(ids), -1), vectors, part, spec, k, least)
        return pa.table({"id": ids[i], "other": ids[j], "cosine": c.astype(np.float64)})

    return nearest


@dataclass(frozen=True)
class SimilarVectors:
    """``neighbours`` ``(id, other, cosine)`` between class representatives; ``members`` ``(id, class_id)``."""

    neighbours: DataFrame
    members: DataFrame


def similar_classes(vectors: DataFrame, spec: PermutationIndex, k: int, least: float) -> SimilarVectors:
    """For each distinct vector of ``(id, vector)`` up to ``k`` most similar other distinct ones.

    Equal vectors form one class, named by its least id; an empty table gives none.
    """
    # equal vectors are told by 128 bits
    print_of = F.struct(F.xxhash64("vector").alias("x"), F.xxhash64(F.lit("second"), "vector").alias("y"))
    vectors = cut_lineage(vectors.withColumn("print", print_of))
    classes = vectors.groupBy("print").agg(F.min("id").alias("class_id"))
    members = cut_lineage(vectors.select("id", "print").join(classes, "print").select("id", "class_id"))
    again = members.where("id != class_id").select("id")
    distinct = vectors.drop("print").join(again, "id", "left_anti")
    n = vectors.count()
    # the index is fitted on a bounded sample: pivots_for(n) vectors, the first by a hash of the id
    sample = distinct.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(spec.pivots_for(n)).collect()
    if not sample:
        empty = vectors.sparkSession.createDataFrame([], "id bigint, other bigint, cosine double")
        return SimilarVectors(empty, members)
    pivots = np.frombuffer(b"".join(r.vector for r in sample), dtype="<f4").reshape(len(sample), -1)
    blocks = _blocks(_postings(cut_lineage(_represented(distinct, pivots, spec))), spec)
    near = blocks.groupBy("pivot", "lo", "hi").applyInArrow(_neighbours_in(spec, k, least), "id bigint, other bigint, cosine double")
    # a pair met in several files has nearly the same cosine in each; the k best of each vector
    pairs = near.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    best = pairs.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))), 1, k).alias("top"))
    neighbours = best.select("id", F.explode("top").alias("t")).select("id", F.col("t.other").alias("other"), (-F.col("t.c")).alias("cosine"))
    return SimilarVectors(neighbours, members)


def neighbours(vectors: DataFrame, spec: PermutationIndex = PermutationIndex(), k: int = 5, least: float = -1.0, of=None) -> DataFrame:
    """``(id, other, cosine)``: the ``k`` most similar other vectors of every vector, copies included.

    Ties go to the smaller id.  ``of`` is an optional predicate on ``id`` for the vectors whose
    neighbours are wanted; all vectors are searched either way.
    """
    found = similar_classes(vectors, spec, k, least)
    links = cut_lineage(found.neighbours)
    # the k + 1 least members of each class, which no vector needs more of; the limit holds before the shuffle
    place = F.row_number().over(W.partitionBy("class_id").orderBy("id"))
    least_members = found.members.withColumn("place", place).where(F.col("place") <= k + 1)
    first = least_members.groupBy("class_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    to = links.join(first.select(F.col("class_id").alias("other"), "ids"), "other").select(F.col("id").alias("class_id"), "ids", "cosine")
    own = first.where(F.size("ids") > 1).select("class_id", "ids", F.lit(1.0).alias("cosine"))
    options = to.union(own).select("class_id", "cosine", F.explode("ids").alias("other"))
    # at most (k + 1) * (k + 1) options of a class
    options = options.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))).alias("all"))
    members = found.members if of is None else found.members.where(of)
    ranked = members.join(options, "class_id").select(
        "id", F.explode(F.slice(F.filter("all", lambda x: x["other"] != F.col("id")), 1, k)).alias("t")
    )
    return ranked.select("id", F.col("t.other").alias("other"), (-F.col("t.c")).alias("cosine"))


def found(responses: DataFrame) -> DataFrame:
    """``p1_found``: pairs of cosine 0.75 or more of which one is among the 5 most similar of the other."""
    near = neighbours(response_vectors(responses), least=0.75)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def recall(responses: DataFrame, spec: PermutationIndex = PermutationIndex(), k: int = 5, least: float = 0.75) -> DataFrame:
    """``(queries, true_pairs, found_pairs, recall)`` of the ids divisible by 50 against a scan of all vectors.

    The scan compares blocks of queries with blocks of all vectors; a true pair has a cosine of
    ``least`` or more and is among the ``k`` best.
    """
    vectors = cut_lineage(response_vectors(responses, dimension=spec.dimension))
    queries = vectors.where(F.col("id") % 50 == 0)
    size = 2000
    left = queries.select((F.pmod(F.xxhash64("id"), F.lit(max(1, queries.count() // size))).cast("int")).alias("q"), "id", "vector")
    right = vectors.select((F.pmod(F.xxhash64("id"), F.lit(max(1, vectors.count() // size))).cast("int")).alias("v"), "id", "vector")
    nq, nv = (d.agg(F.max(c)).first()[0] for d, c in ((left, "q"), (right, "v")))
    if nq is None:
        return vectors.sparkSession.createDataFrame([], "queries bigint, true_pairs bigint, found_pairs bigint, recall double")
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(nv))).alias("v"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(nq))).alias("q"))

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        qi, vi = (t.column("id").combine_chunks().to_numpy() for t in (a, b))
        s = (_matrix(a.column("vector").combine_chunks()) @ _matrix(b.column("vector").combine_chunks()).T).astype(np.float64)
        s[qi[:, None] == vi[None, :]] = -2
        top = np.argsort(-s, axis=1, kind="stable")[:, : k]
        c = np.take_along_axis(s, top, 1)
        i, j = np.nonzero(c >= least)
        return pa.table({"id": qi[i], "other": vi[top[i, j]], "cosine": c[i, j]})

    exact = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(scan, "id bigint, other bigint, cosine double")
    exact = exact.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))), 1, k).alias("top"))
    exact = exact.select("id", F.explode("top.other").alias("other"))
    got = neighbours(vectors, spec, k, least, of="id % 50 = 0").select("id", "other", F.lit(1).alias("hit"))
    both = exact.join(got, ["id", "other"], "left").agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found_pairs"))
    return both.select(
        F.lit(queries.count()).alias("queries"), "true_pairs", "found_pairs", (F.col("found_pairs") / F.greatest(F.col("true_pairs"), F.lit(1))).alias("recall")
    )
