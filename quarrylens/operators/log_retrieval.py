"""The lexical route for whole logs: the best chunks of every question without a row per question and matching chunk.

The words and phrases of the questions get their weights from one pass over the chunks.  Then the
chunks of an author meet the questions of that author in a task, which has postings of the asked
phrases only.  Questions that differ in rare phrases alone share the sums over their frequent ones,
and only the chunks with a rare phrase are added up for each.  The results are those of
``retrieval.bm25_route``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import cut_lineage
from .retrieval import _ranked, _tokens, with_terms

#: Chunks of an author scored in one task, and questions that they meet there; more are dealt out to several tasks.
BLOCK, SLICE = 50_000, 200_000
#: A phrase in more than this share of a task's chunks is frequent.
FREQUENT = 1 / 64
#: Bits of the filter of words and pairs (2 MB): it only spares rows that the join on pairs would drop.
FILTER_BITS = 1 << 24
#: Words and pairs that a task remembers the filter's answer of.
KNOWN = 500_000
_GAP = "  "


def asked_phrases(questions: DataFrame) -> DataFrame:
    """``(query_id, author, phrase)``: the first 12 terms of each question as words in a row, each once."""
    terms = with_terms(questions.where("author is not null")).select("query_id", "author", F.explode(F.slice("terms", 1, 12)).alias("term"))
    phrases = terms.select("query_id", "author", F.array_join(_tokens(F.col("term")), _GAP).alias("phrase"))
    return phrases.where("phrase <> ''").distinct()


def _word_filter(words: DataFrame) -> np.ndarray:
    """The bits of all words of the column ``word``."""
    place = F.pmod(F.crc32(F.encode("word", "utf-8")), F.lit(FILTER_BITS)) + 1
    parts = words.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        own = np.frombuffer(bytes(row.bits), dtype=np.uint8)
        at = (row.part - 1) * 4096
        bits[at : at + len(own)] = own
    return bits


def _contexts(bits: np.ndarray, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each pair of words of the filter in a chunk the words around it, ``reach - 1`` on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def learn(words: set[str]) -> None:
            if len(known) > KNOWN:
                known.clear()
            for word in words.difference(known):
                place = crc32(word.encode("utf-8", "replace")) % FILTER_BITS
                known[word] = bool(bits[place >> 3] >> (place & 7) & 1)

        for batch in batches:
            found = []
            for chunk, sequence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = sequence[1:-1].split(_GAP)
                learn(set(words))
                firsts = [i for i, hit in enumerate(map(known.__getitem__, words[:-1])) if hit]
                pairs = [f"{words[i]}{_GAP}{words[i + 1]}" for i in firsts]
                learn(set(pairs))
                hits = {pair: i for i, pair in zip(firsts, pairs) if known.get(pair, True)}
                if reach >= len(words):
                    found += [(pair, chunk, sequence) for pair in hits]
                elif hits:
                    found += [(p, chunk, f" {_GAP.join(words[max(0, i - reach + 1) : i + reach])} ") for i, p in zip(firsts, pairs) if p in hits]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["pair", "chunk_id", "context"])

    return run


def _frequencies(phrases: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(phrase, df)`` of the phrases that some chunk has.

    A phrase of several words is looked for around that pair of its words which the fewest phrases have.
    """
    wanted = phrases.select("phrase").distinct()
    words = tokens.select(F.explode(F.array_distinct("tokens")).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    single = words.join(wanted.where(~F.col("phrase").contains(_GAP)), "phrase")
    longer = wanted.where(F.col("phrase").contains(_GAP)).select("phrase", F.split("phrase", _GAP).alias("words"))
    reach = longer.agg(F.max(F.size("words"))).first()[0]
    if reach is None:
        return single
    pairs = F.transform(F.slice("words", F.lit(1), F.size("words") - 1), lambda w, i: F.concat(w, F.lit(_GAP), F.element_at("words", i + 2)))
    parts = longer.select("phrase", F.explode(F.array_distinct(pairs)).alias("pair"))
    usual = parts.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct("n", (-F.length("pair")).alias("shorter"), "pair")
    keyed = cut_lineage(parts.join(usual, "pair").groupBy("phrase").agg(F.min(rank).alias("m")).select("phrase", F.col("m.pair").alias("pair")))
    bits = _word_filter(keyed.select(F.explode(F.array(F.split("pair", _GAP)[0], "pair")).alias("word")))
    around = tokens.select("chunk_id", "sequence").mapInArrow(_contexts(bits, reach), "pair string, chunk_id bigint, context string")
    inside = F.col("context").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    met = around.join(keyed, "pair").where(inside).select("phrase", "chunk_id").distinct()
    return single.unionByName(met.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")))


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores over 0, to 9 digits, then by place."""
    least = max(0.0, np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-8) if len(scores) > k else 0.0
    near = np.flatnonzero((scores >= least) & (scores > 0))
    return near[np.argsort(-np.round(scores[near], 9), kind="stable")[:k]]


def _postings(sequences: list[str], lengths: np.ndarray, phrases: list[str], idf: np.ndarray, mean: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each phrase the places of the chunks that have it, ascending, and its weight in each."""
    n, index = len(sequences), {}
    for phrase in phrases:
        for word in phrase.split(_GAP):
            index.setdefault(word, len(index))
    codes, sizes = [], np.zeros(n, dtype=np.int64)
    for k, sequence in enumerate(sequences):
        words = sequence[1:-1].split(_GAP)
        codes.append(np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words)))
        sizes[k] = len(words)
    code = np.concatenate(codes)
    owner = np.repeat(np.arange(n), sizes)[code >= 0]
    keys, counts = np.unique(code[code >= 0].astype(np.int64) * n + owner, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(index) + 1) * n)
    places = keys % n
    k1, b = rules.BM25_K1, rules.BM25_B
    scale = k1 * (1 - b + b * lengths / mean)
    out = []
    for phrase, weight in zip(phrases, idf):
        own = [slice(bounds[i], bounds[i + 1]) for i in map(index.__getitem__, phrase.split(_GAP))]
        rarest = min(own, key=lambda s: s.stop - s.start)
        at, f = places[rarest], counts[rarest]
        if len(own) > 1:
            f = np.array([sequences[k].count(f" {phrase} ") for k in at], dtype=np.int64)
            at, f = at[f > 0], f[f > 0]
        out.append((at, weight * f * (k1 + 1) / (f + scale[at])))
    return out


def _best(limit: int, frequent: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best chunks of each question among those of one task."""

    def run(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
        if not chunks.num_rows or not asked.num_rows:
            return schema.empty_table()
        chunks = chunks.select(["chunk_id", "length", "sequence"]).sort_by("chunk_id")
        ids, lengths = chunks["chunk_id"].to_numpy(), chunks["length"].to_numpy()
        coded = asked["phrase"].combine_chunks().dictionary_encode()
        code, n = coded.indices.to_numpy(), len(ids)
        idf = np.zeros(len(coded.dictionary))
        idf[code] = asked["idf"].to_numpy()
        postings = _postings(chunks["sequence"].to_pylist(), lengths, coded.dictionary.to_pylist(), idf, asked["mean_length"][0].as_py())
        size = np.array([len(at) for at, _ in postings])

        # questions with the same phrases are one; by their frequent phrases, then their rare ones
        query = asked["query_id"].to_numpy()
        met = size[code] > 0
        query, code = query[met], code[met]
        order = np.lexsort((code, query))
        query, code = query[order], code[order]
        starts = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
        alike: dict[tuple, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        most = max(limit, frequent * n)
        for one, own in zip(query[starts].tolist(), np.split(code, starts[1:]) if len(starts) else ()):
            often = size[own] > most
            alike[tuple(own[often].tolist())][tuple(own[~often].tolist())].append(one)

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        marked = np.zeros(n, dtype=bool)
        for shared, groups in alike.items():
            sums = np.zeros(n)
            for c in shared:
                at, w = postings[c]
                sums[at] += w
            top = _first(sums, limit + max(int(size[list(rare)].sum()) for rare in groups)) if shared else np.zeros(0, np.int64)
            for rare, queries in groups.items():
                if rare:
                    at = np.concatenate([postings[c][0] for c in rare])
                    w = np.concatenate([postings[c][1] for c in rare])
                    if len(rare) > 1:
                        at, back = np.unique(at, return_inverse=True)
                        w = np.bincount(back, w)
                    marked[at] = True
                    others = top[: limit + len(at)]
                    others = others[~marked[others]][:limit]
                    marked[at] = False
                    places = np.concatenate((at, others))
                    scores = np.round(np.concatenate((sums[at] + w, sums[others])), 9)
                    keep = np.lexsort((places, -scores))[:limit]
                    places, scores = places[keep], scores[keep]
                else:
                    places = top[:limit]
                    scores = np.round(sums[places], 9)
                found.append((np.repeat(np.array(queries, dtype=np.int64), len(places)), np.tile(ids[places], len(queries)), np.tile(scores, len(queries))))
        if not found:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=schema)

    return run


def bm25_log_route(questions: DataFrame, chunks: DataFrame, limit: int = rules.ROUTE_LIMIT, block: int = BLOCK, slices: int = SLICE, frequent: float = FREQUENT) -> DataFrame:
    """``retrieval.bm25_route`` for as many questions as a log has."""
    questions = questions.select(F.col("query_id").cast("bigint"), "author", "question")
    phrases = cut_lineage(asked_phrases(questions))
    tokens = chunks.select(F.col("id").cast("bigint").alias("chunk_id"), "author", _tokens(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens"))
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    tokens = tokens.where("tokens is not null").withColumn("sequence", F.concat(F.lit(" "), F.array_join("tokens", _GAP), F.lit(" ")))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(rules.BM25_FLOOR))
    weights = _frequencies(phrases, tokens).crossJoin(F.broadcast(totals)).select("phrase", idf.alias("idf"), "mean_length")

    # authors with several tasks: at most one in so many chunks or questions, so few
    many = chunks.groupBy("author").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    busy = questions.groupBy("author").agg(F.ceil(F.count(F.lit(1)) / slices).cast("int").alias("slices")).where("slices > 1")

    def dealt(rows: DataFrame, own: str, key: str, others: str) -> DataFrame:
        """Each row at the place of its key among ``own``, and at all places of ``others``."""
        rows = rows.join(F.broadcast(many), "author", "left").join(F.broadcast(busy), "author", "left").fillna(1, ["blocks", "slices"])
        rows = rows.withColumn(own[:-1], F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return rows.withColumn(others[:-1], F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("blocks", "slices")

    left = dealt(tokens.where("author is not null").select("chunk_id", "author", "length", "sequence"), "blocks", "chunk_id", "slices")
    right = dealt(phrases.join(weights, "phrase"), "slices", "query_id", "blocks")
    key = ["author", "block", "slice"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(limit, frequent), "query_id bigint, chunk_id bigint, score double")
    return _ranked(best, "fts", [F.desc("score"), "chunk_id"], limit, "chunk_id")
