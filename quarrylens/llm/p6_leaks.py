"""Problem 6: held-out passages inside training texts, by suffix arrays over the training words.

Each shard of documents is turned into one word stream.  Its suffix array holds the suffixes
that start with ``least`` consecutive words of one document; suffixes with a word that no test
item has are left out, because no test suffix can match there.  The array covers ``_SLICE``
documents and is sorted by the first ``least`` words, more of which no search needs; every test suffix is looked up in it by binary search, and each hit is
extended word by word in both directions to the longest verbatim match.  A match is never cut
by a shard, since a shard holds whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, need
from .words import word_stream

_SLICE = 256
#: Words of test items that are sent to the executors at once: about 80 bytes each with their sorted suffixes, 16 MB.
MAX_TEST_WORDS = 200_000


def _test_blocks(items: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(item ids, word hashes, bounds)`` of the items, in blocks of at most ``MAX_TEST_WORDS`` (or one item)."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = word_stream(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["item_id", "words"]
            )

    rows = items.mapInArrow(tokenise, "item_id bigint, words binary").orderBy("item_id")
    ids, words, size = [], [], 0
    for row in rows.toLocalIterator():
        w = np.frombuffer(row.words, dtype=np.uint64)
        if ids and size + len(w) > MAX_TEST_WORDS:
            yield np.array(ids), np.concatenate(words), np.concatenate(([0], np.cumsum([len(x) for x in words])))
            ids, words, size = [], [], 0
        ids.append(row.item_id)
        words.append(w)
        size += len(w)
    if ids:
        yield np.array(ids), np.concatenate(words), np.concatenate(([0], np.cumsum([len(x) for x in words])))


def _prefixes(codes: np.ndarray, positions: np.ndarray, least: int) -> np.ndarray:
    """The ``least`` codes from each position as byte strings that sort like the code sequences."""
    return np.ascontiguousarray(codes[positions[:, None] + np.arange(least)].astype(">u4")).view(f"S{4 * least}").ravel()


def _runs(live: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Positions from which ``least`` consecutive words are live and of one owner."""
    n = len(live) - least + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(live)))
    return np.flatnonzero((total[least:] - total[:-least] == least) & (owner[:n] == owner[least - 1 :]))


def _search_shard(texts: list[str | None], test: tuple, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text, item, words, start, item_start)`` of the longest match of each pair of text and item."""
    vocabulary, item_codes, item_owner, suffixes, prefixes = test
    hashes, bounds = word_stream(texts)
    if not len(hashes) or not len(suffixes):
        return
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    codes = np.where(vocabulary[at] == hashes, at + 1, 0)
    positions = _runs(codes > 0, owner, least)
    if not len(positions):
        return
    keys = _prefixes(codes, positions, least)
    order = np.argsort(keys, kind="stable")
    suffix_array, keys = positions[order], keys[order]
    lo, hi = np.searchsorted(keys, prefixes, "left"), np.searchsorted(keys, prefixes, "right")
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s in np.flatnonzero(hi > lo):
        j = int(suffixes[s])
        item = item_owner[j]
        for i in suffix_array[lo[s] : hi[s]].tolist():
            doc = owner[i]
            if i and j and owner[i - 1] == doc and item_owner[j - 1] == item and codes[i - 1] == item_codes[j - 1]:
                continue  # not the start of a maximal match
            n = least
            while i + n < len(codes) and j + n < len(item_codes) and owner[i + n] == doc and item_owner[j + n] == item and codes[i + n] == item_codes[j + n]:
                n += 1
            found = (n, int(i - bounds[doc]), j)
            if (doc, item) not in best or found[0] > best[doc, item][0]:
                best[doc, item] = found
    for (doc, item), (n, start, j) in best.items():
        yield int(doc), int(item), n, start, j


def leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """``(doc_id, item_id, words, start)``: the longest verbatim match of at least ``least`` words.

    ``documents`` ``(doc_id, text)``, ``items`` ``(item_id, passage)``.  ``start`` counts words of
    the document from 0.  Null and short texts and passages match nothing; repeated rows of a
    document or item give one row; copies under other ids each have theirs.  Items beyond
    ``MAX_TEST_WORDS`` go over the documents in further blocks, one after another.
    """
    documents = need(documents, ["doc_id", "text"], "leaks")
    items = need(items, ["item_id", "passage"], "leaks").dropDuplicates(["item_id"])
    spark = documents.sparkSession
    parts, sent = [], None
    for ids, words, bounds in _test_blocks(items):
        if sent is not None:  # the block before is searched and released
            parts[-1] = cut_lineage(parts[-1])
            sent.destroy()
        vocabulary, codes = np.unique(words, return_inverse=True)
        codes = codes + 1
        item_owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        suffixes = _runs(np.ones(len(words), dtype=bool), item_owner, least)
        prefixes = _prefixes(codes, suffixes, least) if len(suffixes) else np.zeros(0, dtype=f"S{4 * least}")
        shared = sent = spark.sparkContext.broadcast(((vocabulary, codes, item_owner, suffixes, prefixes), ids, bounds))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test, item_ids, _ = shared.value
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for lo in range(0, len(texts), _SLICE):
                    for doc, item, n, start, _ in _search_shard(texts[lo : lo + _SLICE], test, least):
                        rows.append((doc_ids[lo + doc], int(item_ids[item]), n, start))
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                    names=["doc_id", "item_id", "words", "start"],
                )

        parts.append(documents.mapInArrow(search, "doc_id bigint, item_id bigint, words int, start int"))
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, words int, start int")
    matches = parts[0]
    for part in parts[1:]:
        matches = matches.union(part)
    longest = F.max(F.struct("words", -F.col("start"))).alias("m")
    return matches.where("doc_id is not null").groupBy("doc_id", "item_id").agg(longest).select(
        "doc_id", "item_id", F.col("m.words").alias("words"), (-F.col("m.col2")).alias("start")
    )


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``p6_found``: (doc_id, item_id)."""
    return leaks(documents, items).select("doc_id", "item_id")


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
