"""Near-duplicate records by anchor-point covering.

A record's fingerprint is ``blocks`` words over a large prime field, each of ``n`` min-hash
symbols of its feature set (word or character sequences).  The anchors are the code words of
the ``[n, n-1]`` single-parity code over that field: a covering code of radius 1, because any
word becomes a code word when one symbol is replaced.  Every block is replicated to all the
anchors within the radius (``n`` of them), and two blocks that differ in at most one symbol
always share an anchor.  Only records that meet at an anchor are compared: first by their
whole fingerprint, then exactly by their feature sets.

At similarity ``s`` two records meet with probability ``1 - (1 - s^n - n(1-s)s^(n-1))^blocks``:
for the defaults (5 symbols, 10 blocks) 0.984 at 0.6 and 0.9997 at 0.7.  No bucket is capped.

Records with equal feature sets form one class and are fingerprinted once, so a set of exact
copies, however large, costs one posting per block and anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .words import mix, shingle_stream, unique_by_owner, word_stream

_PRIME = np.uint64(2147483647)
#: Texts that are tokenised together; keeps the working arrays in the processor's cache.
_SLICE = 256


@dataclass(frozen=True)
class Covering:
    """Features and code of a near-duplicate search.

    ``unit`` "word" takes ``width``-word sequences, "char" ``width``-character substrings of the
    text with every run of other characters than letters and digits turned into a blank.
    Records with fewer than ``min_size`` features take no part.
    """

    unit: str = "word"
    width: int = 5
    threshold: float = 0.8
    min_size: int = 1
    symbols: int = 5
    blocks: int = 10

    @property
    def least_matches(self) -> int:
        """Fingerprint symbols that must agree: four standard deviations below the threshold's mean."""
        n = self.symbols * self.blocks
        s = self.threshold
        return max(1, int(n * s - 4 * (n * s * (1 - s)) ** 0.5))


def features(texts: list[str | None], spec: Covering) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(value, owner)`` features of the texts, sorted by owner and value."""
    if spec.unit == "word":
        values, owner = shingle_stream(*word_stream(texts), spec.width)
    else:
        codes = [np.frombuffer((t or "").encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
        lengths = np.array([len(c) for c in codes], dtype=np.int64)
        flat = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, np.uint64)
        values, owner = shingle_stream(flat, np.concatenate(([0], np.cumsum(lengths))), spec.width)
    return unique_by_owner(values, owner)


def _minhash(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    out = np.empty((len(starts), count), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(count):
            a = mix(np.array([2 * k + 1], dtype=np.uint64))[0] | np.uint64(1)
            b = mix(np.array([2 * k + 2], dtype=np.uint64))[0]
            h = values * a + b
            h ^= h >> np.uint64(29)
            out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _anchors(symbols: np.ndarray, spec: Covering) -> np.ndarray:
    """Ids of the parity code words within radius 1 of each block: one for each replaced symbol."""
    n = spec.symbols
    ids = np.empty((len(symbols), spec.blocks * n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(spec.blocks):
            block = symbols[:, b * n : (b + 1) * n]
            total = block.sum(axis=1)
            salt = mix(np.array([b + 1], dtype=np.uint64))[0]
            weights = mix(np.arange(1, n + 1, dtype=np.uint64) + salt)
            # the code word's id is a weighted sum of its symbols; replacing one changes one term
            base = (mix(block + weights)).sum(axis=1, dtype=np.uint64)
            for i in range(n):
                parity = (_PRIME * np.uint64(n) - (total - block[:, i])) % _PRIME
                ids[:, b * n + i] = mix(base - mix(block[:, i] + weights[i]) + mix(parity + weights[i]) + salt)
    return ids


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], spec: Covering) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, all_texts = batch.column(0), batch.column(1).to_pylist()
        for lo in range(0, len(all_texts), _SLICE):
            values, owner = features(all_texts[lo : lo + _SLICE], spec)
            owners, starts, sizes = np.unique(owner, return_index=True, return_counts=True)
            keep = sizes >= spec.min_size
            if not keep.any():
                continue
            hashes = _minhash(values, starts, spec.symbols * spec.blocks)
            with np.errstate(over="ignore"):
                set_a = np.add.reduceat(values, starts)
                set_b = np.add.reduceat(mix(values), starts)
            owners, hashes, sizes, set_a, set_b = owners[keep], hashes[keep], sizes[keep], set_a[keep], set_b[keep]
            symbols = (hashes % _PRIME).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(owners + lo)),
                    pa.array([a.tobytes() + b.tobytes() for a, b in zip(set_a, set_b)], pa.binary()),
                    pa.array([row.tobytes() for row in symbols], pa.binary()),
                    pa.array([row.tobytes() for row in (symbols & 255).astype("u1")], pa.binary()),
                ],
                names=["key", "set_id", "symbols", "print"],
            )


def _rows_of(column: pa.Array, dtype: str) -> np.ndarray:
    """Equally long binary values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def _posting_batches(batches: Iterator[pa.RecordBatch], spec: Covering) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            anchors = _anchors(_rows_of(part.column(1), "<u4").astype(np.uint64), spec)
            where = pa.array(np.repeat(np.arange(part.num_rows), anchors.shape[1]))
            columns = [pa.array(anchors.astype(np.int64).ravel()), part.column(0).take(where)]
            columns += [part.column(i).take(where) for i in range(2, part.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "key", *part.schema.names[2:]])


def _key_type(df: DataFrame) -> str:
    return dict(df.dtypes).get("key") or dict(df.dtypes)["a"]


def fingerprints(records: DataFrame, spec: Covering) -> DataFrame:
    """``(key, set_id, symbols, print)`` of the records ``(key, text)``; ``print`` has a byte of each symbol, for comparison.

    ``set_id`` identifies the feature set (128 bits); null and empty texts have no features and
    are left out.
    """
    return records.select("key", "text").mapInArrow(
        lambda it: _fingerprint_batches(it, spec), f"key {_key_type(records)}, set_id binary, symbols binary, print binary"
    )


def _match_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        near = (_rows_of(batch.column(2), "u1") == _rows_of(batch.column(3), "u1")).sum(axis=1) >= least
        yield batch.select([0, 1]).filter(pa.array(near))


#: Postings of a partition, so that partitions stay as large however many records there are.
POSTINGS_AT_ONCE = 400_000
#: Records at an anchor from which its pairs are compared block by block instead of joined.
HOT_ANCHOR = 1000


def candidate_pairs(prints: DataFrame, spec: Covering, extra: str | None = None, hot: int = HOT_ANCHOR) -> DataFrame:
    """Pairs ``(a, b)`` of class representatives that share an anchor and whose fingerprints agree.

    ``prints`` has one row ``(key, symbols, print[, extra])`` per class; ``extra`` names a boolean
    column of which at least one side of a pair must be true.  Records at an anchor of more than
    ``hot`` are split into blocks, and every pair of blocks is compared in a task of its own, which
    gives out only pairs whose fingerprints agree.
    """
    kind = _key_type(prints)
    flag = [extra] if extra else []
    partitions = max(8, prints.count() * spec.blocks * spec.symbols // POSTINGS_AT_ONCE)
    postings = prints.select("key", "symbols", *flag).mapInArrow(
        lambda it: _posting_batches(it, spec), f"anchor bigint, key {kind}" + (f", {extra} boolean" if extra else "")
    )
    # the filter is what the join would put there; with it all uses share the shuffle
    postings = postings.where("anchor is not null").repartition(partitions, "anchor")
    # one shuffle serves the sizes, both sides of the join and the blocks; most records meet nobody
    sized = postings.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("anchor"))).where("size > 1")
    met = sized.where(F.col("size") <= hot)
    left = met.select("anchor", F.col("key").alias("a"), *[F.col(c).alias("xa") for c in flag])
    right = met.select("anchor", F.col("key").alias("b"), *[F.col(c).alias("xb") for c in flag])
    pairs = left.join(right, "anchor").where("a < b")
    if extra:
        pairs = pairs.where("xa or xb")
    pairs = pairs.select("a", "b").distinct()
    side = prints.select("key", "print")
    joined = (
        pairs.join(side.select(F.col("key").alias("a"), F.col("print").alias("pa")), "a")
        .join(side.select(F.col("key").alias("b"), F.col("print").alias("pb")), "b")
        .select("a", "b", "pa", "pb")
        .mapInArrow(lambda it: _match_batches(it, spec.least_matches), f"a {kind}, b {kind}")
    )
    crowded = sized.where(F.col("size") > hot).select("anchor", "key", F.ceil(F.col("size") / hot).cast("int").alias("parts"), *flag)
    crowded = crowded.join(side, "key").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    blocks = crowded.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "anchor", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "key", "print", *flag
    )
    agreeing = blocks.groupBy("anchor", "lo", "hi").applyInArrow(_agreeing_in(spec.least_matches, extra), f"a {kind}, b {kind}")
    return joined.union(agreeing).distinct()


def _agreeing_in(least: int, extra: str | None):
    """Compares the fingerprints of a block, or of two blocks with each other."""

    def agreeing(block: pa.Table) -> pa.Table:
        block = block.sort_by("key")
        keys = block.column("key").combine_chunks()
        prints = _rows_of(block.column("print").combine_chunks(), "u1")
        part = block.column("part").to_numpy()
        across = block.column("lo")[0].as_py() != block.column("hi")[0].as_py()
        flags = np.array(block.column(extra).to_pylist(), dtype=bool) if extra else np.ones(len(keys), dtype=bool)
        a, b = [], []
        for i in range(len(keys) - 1):
            near = (prints[i + 1 :] == prints[i]).sum(axis=1) >= least
            near &= flags[i] | flags[i + 1 :]
            if across:  # pairs within a block belong to that block's own task
                near &= part[i + 1 :] != part[i]
            j = np.flatnonzero(near) + i + 1
            a.append(np.full(len(j), i))
            b.append(j)
        index = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)]
        return pa.table({"a": keys.take(index[0]), "b": keys.take(index[1])})

    return agreeing


def _verify_batches(batches: Iterator[pa.RecordBatch], spec: Covering) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, scores = [], []
        a, b = batch.column(0), batch.column(1)
        texts_a, texts_b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo in range(0, len(a), _SLICE):
            n = len(texts_a[lo : lo + _SLICE])
            values, owner = features(texts_a[lo : lo + n] + texts_b[lo : lo + n], spec)
            size = np.bincount(owner, minlength=2 * n)
            pair = owner % n
            order = np.lexsort((values, pair))
            v, p = values[order], pair[order]
            shared = np.bincount(p[1:][(v[1:] == v[:-1]) & (p[1:] == p[:-1])], minlength=n)
            union = size[:n] + size[n:] - shared
            # at least the threshold, without rounding: shared / union >= threshold
            similar = (union > 0) & (shared >= spec.threshold * union - 1e-9)
            for i in np.flatnonzero(similar):
                kept.append(lo + i)
                scores.append(float(shared[i] / union[i]))
        yield pa.RecordBatch.from_arrays([a.take(pa.array(kept, pa.int64())), b.take(pa.array(kept, pa.int64())), pa.array(scores, pa.float64())], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, records: DataFrame, spec: Covering) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the threshold, ``(a, b, similarity)``."""
    kind = _key_type(pairs)
    involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = records.select("key", "text").join(involved, "key", "left_semi").dropDuplicates(["key"])
    return (
        pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(lambda it: _verify_batches(it, spec), f"a {kind}, b {kind}, similarity double")
    )


@dataclass(frozen=True)
class NearDuplicates:
    """``links`` between class representatives ``(a, b, similarity)``, a < b; ``members`` ``(key, class_key)``."""

    links: DataFrame
    members: DataFrame


def near_duplicates(records: DataFrame, spec: Covering, cut, extra: str | None = None) -> NearDuplicates:
    """Links of at least ``spec.threshold`` between the records ``(key, text[, extra])``.

    Null keys, null or empty texts and texts under ``spec.min_size`` features have no links and
    no class; repeated rows of a key count once; copies share a class whose key is the least of
    theirs.  ``cut`` stores an intermediate table (see ``common.cut_lineage``).
    """
    columns = ["key", "text"] + ([extra] if extra else [])
    records = records.where("key is not null").select(*columns)
    prints = fingerprints(records, spec)
    if extra:
        prints = prints.join(records.groupBy("key").agg(F.max(extra).alias(extra)), "key")
    prints = cut(prints)
    members = prints.select("key", "set_id").distinct()
    classes = members.groupBy("set_id").agg(F.min("key").alias("class_key"))
    represented = [F.min("key").alias("key"), F.first("symbols").alias("symbols"), F.first("print").alias("print")]
    if extra:
        represented.append(F.max(extra).alias(extra))
    representatives = cut(prints.groupBy("set_id").agg(*represented).drop("set_id"))
    pairs = cut(candidate_pairs(representatives, spec, extra))
    return NearDuplicates(verified(pairs, records, spec), members.join(classes, "set_id").select("key", "class_key"))
