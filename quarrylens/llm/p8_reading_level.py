"""Problem 8: the reading level of each document, by a latent difficulty model of word occurrences.

Rasch-style: a document has a level ``theta`` and a word a difficulty ``b`` and a frequency
``a``; the word occurs in the document with a probability ``exp(a + b * theta) / z(theta)``, so
documents and words are placed on one scale.  The parameters are estimated by alternating
between the two sides, both in tasks: given the words each document's level is found on a grid;
given the levels each word's statistics are summed over all documents and its two parameters
are solved for by Newton steps, word by word.  The alternation stops when the levels no longer
move.  Rated documents start the scale and cut it into the four levels.

Words are told apart by 64-bit hashes.  Those above a rate of ``rate`` in a million, of which
there can't be more than ``1e6 / rate``, have parameters of their own; rarer ones share those of
the words with as many letters, since alone they are too few to be placed.  All occurrences of
all words take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, need
from .words import sized_word_stream, word_stream

#: ASCII function words that vote for the language of a document.
VOTERS = {
    "en": "the of and to in is was were are that with for on by at from this these it we you not as or an had has have be can but did than when first then some after into",
    "de": "der die das und ist war wurde wurden nicht mit auf bei den dem des ein eine einen wir im von zu nach sich ob oder weil danach als zur zum auch um",
    "es": "el la los las del de y en es fue con por para una un que se al lo este esta sobre cada hasta entre",
    "fr": "le les des du et est ont avec pour une dans sur par au aux nous cette ces ce pas sont leur",
}
_SLICE = 256


@dataclass(frozen=True)
class LevelModel:
    #: Occurrences in a million from which a word has its own parameters: at most a million words, 12 bytes each at the executors.
    rate: float = 1.0
    #: Passes over the documents at most, and the change of the levels (root mean square, half a grid step) that ends them.
    passes: int = 8
    still: float = 0.1
    #: Rounds over the words in a pass, each with the normaliser of the one before.
    rounds: int = 3
    least_words: int = 60
    #: Rated documents that start the scale and place the cuts; the first by a hash of the id.
    max_rated: int = 20_000
    ridge: float = 2.0

    @property
    def grid(self) -> np.ndarray:
        """Levels are searched here; level k of 1 to 4 starts at ``k - 2.5``."""
        return np.linspace(-3.0, 3.0, 31)


#: Words of as many letters as this and more are alike in length.
LENGTHS = 16


def document_words(documents: DataFrame, model: LevelModel) -> DataFrame:
    """``(doc_id, words, distinct)`` of the English documents of ``least_words`` or more.

    ``words`` holds the distinct words as 64-bit hashes, the last four bits of which are the
    length, and then their counts, in the fewest bytes that hold them all.  The language is that with most function words in the text; null and short texts are left out.
    """
    voters = {k: np.sort(word_stream([w])[0]) for k, w in VOTERS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), _SLICE):
                hashes, bounds, lengths = sized_word_stream(texts[lo : lo + _SLICE])
                n = len(bounds) - 1
                owner = np.repeat(np.arange(n), np.diff(bounds))
                votes = {}
                for lang, known in voters.items():
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    votes[lang] = np.bincount(owner[known[at] == hashes], minlength=n)
                other = np.maximum.reduce([v for k, v in votes.items() if k != "en"])
                keep = np.flatnonzero((np.diff(bounds) >= model.least_words) & (votes["en"] > other))
                ids, packed, distinct = [], [], []
                sized = hashes & ~np.uint64(LENGTHS - 1) | np.minimum(lengths, LENGTHS - 1).astype(np.uint64)
                for i in keep:
                    words, counts = np.unique(sized[bounds[i] : bounds[i + 1]], return_counts=True)
                    packed.append(words.astype("<u8").tobytes() + counts.astype(np.min_scalar_type(int(counts.max()))).tobytes())
                    distinct.append(len(words))
                    ids.append(lo + i)
                columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(packed, pa.binary()), pa.array(distinct, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "distinct"])

    return documents.mapInArrow(run, "doc_id bigint, words binary, distinct int")


def consensus(labels: DataFrame) -> DataFrame:
    """``(doc_id, rated)``: the mean level of a document's raters; null levels don't count, repeats once."""
    labels = need(labels, ["doc_id", "rater", "level"], "consensus")
    each = labels.where("level between 1 and 4 and doc_id is not null").groupBy("doc_id", "rater").agg(F.avg("level").alias("level"))
    return each.groupBy("doc_id").agg(F.avg("level").alias("rated"))


def _unpack(column: pa.Array, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and document index of a batch's packed words, ``sizes`` being their distinct words."""
    hashes, counts = [], []
    for packed, n in zip(column.to_pylist(), sizes):
        hashes.append(np.frombuffer(packed, "<u8", n))
        counts.append(np.frombuffer(packed, f"<u{(len(packed) - 8 * n) // n}", n, 8 * n))
    none = [np.zeros(0, "<u8")]
    return np.concatenate(hashes or none), np.concatenate(counts or none).astype(np.float64), np.repeat(np.arange(len(sizes)), sizes)


@dataclass(frozen=True)
class _Scale:
    """The vocabulary's sorted hashes, the difficulty of each place (words, then lengths), and the log normaliser of each grid level."""

    vocabulary: np.ndarray
    difficulty: np.ndarray | None
    log_z: np.ndarray | None

    @property
    def places(self) -> int:
        return len(self.vocabulary) + LENGTHS

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word: its own in the vocabulary, else that of its length."""
        rare = len(self.vocabulary) + (hashes & np.uint64(LENGTHS - 1)).astype(np.int64)
        if not len(self.vocabulary):
            return rare
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, rare)

    def levels(self, places: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int, grid: np.ndarray) -> np.ndarray:
        """The most likely level of each document, between grid points by a parabola."""
        slope = np.bincount(owner, counts * self.difficulty[places], n)
        like = slope[:, None] * grid - np.bincount(owner, counts, n)[:, None] * self.log_z
        best = like.argmax(axis=1)
        inner = np.clip(best, 1, len(grid) - 2)
        rows = np.arange(n)
        left, mid, right = like[rows, inner - 1], like[rows, inner], like[rows, inner + 1]
        bend = left - 2 * mid + right
        shift = np.where((best == inner) & (bend < 0), 0.5 * (left - right) / np.where(bend < 0, bend, -1.0), 0.0)
        return grid[best] + np.clip(shift, -1, 1) * (grid[1] - grid[0])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the batches ``(doc_id, words, distinct, ...)`` with their hashes, counts and document indices."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            part = whole.slice(lo, 500)
            yield part, *_unpack(part.column(1), part.column(2).to_pylist())


def vocabulary(words: DataFrame, model: LevelModel) -> np.ndarray:
    """The sorted hashes of the words above ``model.rate``: at most ``1e6 / rate`` of 8 bytes reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([c for _, c in held]), len(keys))

        for _, hashes, counts, _ in _slices(batches):
            held.append((hashes, counts))
            if len(held) >= 64:
                held[:] = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield _word_sums(*held.pop())
        if held:
            yield _word_sums(*merged())

    def _word_sums(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["word", "n"])

    counted = cut_lineage(words.select("doc_id", "words", "distinct").mapInArrow(count, "word bigint, n double").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0.0
    known = counted.where(F.col("n") > max(1.0, model.rate * total / 1e6)).select("word").toArrow()
    return np.sort(known.column("word").to_numpy().astype(np.int64).view(np.uint64))


def _statistics(words: DataFrame, model: LevelModel, scale: _Scale, level_column: str | None) -> DataFrame:
    """``(place, total, moment)``: of each place the words and their summed levels over all documents.

    Places from -1 down are the grid levels with the words of the documents there.  Each task
    sums its own documents first.
    """
    grid = model.grid
    shared = words.sparkSession.sparkContext.broadcast(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = shared.value
        total, moment, mass = np.zeros(scale.places), np.zeros(scale.places), np.zeros(len(grid))
        for part, hashes, counts, owner in _slices(batches):
            n, places = part.num_rows, scale.place(hashes)
            theta = scale.levels(places, counts, owner, n, grid) if level_column is None else part.column(3).to_numpy(zero_copy_only=False) - 2.5
            total += np.bincount(places, counts, scale.places)
            moment += np.bincount(places, counts * theta[owner], scale.places)
            near = np.clip(np.rint((theta - grid[0]) / (grid[1] - grid[0])).astype(int), 0, len(grid) - 1)
            mass += np.bincount(near, np.bincount(owner, counts, n), len(grid))
        at, level = np.flatnonzero(total), np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((at, -1 - level))), pa.array(np.concatenate((total[at], mass[level]))), pa.array(np.concatenate((moment[at], np.zeros(len(level)))))],
            names=["place", "total", "moment"],
        )

    columns = ["doc_id", "words", "distinct"] + ([level_column] if level_column else [])
    sums = words.select(*columns).mapInArrow(run, "place bigint, total double, moment double")
    return cut_lineage(sums.groupBy("place").agg(F.sum("total").alias("total"), F.sum("moment").alias("moment")))


def _newton(n: np.ndarray, s: np.ndarray, x: np.ndarray, y: np.ndarray, mass: np.ndarray, log_z: np.ndarray, model: LevelModel) -> tuple[np.ndarray, np.ndarray]:
    """A few Newton steps for words that occur ``n`` times at summed levels ``s``, from frequency ``x`` and difficulty ``y``."""
    grid = model.grid
    for _ in range(6):
        rate = mass[None, :] * np.exp(np.clip(x[:, None] + y[:, None] * grid[None, :] - log_z[None, :], -40, 8))
        r0, r1, r2 = rate.sum(1), rate @ grid, rate @ grid**2
        g0, g1 = n - r0, s - r1 - model.ridge * y
        h00, h01, h11 = r0 + 1e-6, r1, r2 + model.ridge
        det = np.maximum(h00 * h11 - h01**2, 1e-9)
        x = x + np.clip((h11 * g0 - h01 * g1) / det, -1, 1)
        y = y + np.clip((h00 * g1 - h01 * g0) / det, -1, 1)
    return x, y


def _solved(sums: DataFrame, scale: _Scale, model: LevelModel) -> _Scale:
    """The scale with the parameters of all words solved for in tasks, given their sums.

    Words are solved one by one with the normaliser of each grid level held fixed; the
    normaliser is then summed over them, and so on for ``model.rounds`` rounds.
    """
    grid = model.grid
    found = sums.where("place < 0").select("place", "total").toArrow()
    mass = np.zeros(len(grid))
    mass[-1 - found.column("place").to_numpy()] = found.column("total").to_numpy()
    words = max(mass.sum(), 1.0)
    log_z = np.zeros(len(grid))
    solved = sums.where("place >= 0").select("place", "total", "moment", F.log((F.col("total") + 0.02) / words).alias("a"), F.lit(0.0).alias("b"))
    schema = "place bigint, total double, moment double, a double, b double"
    for _ in range(model.rounds):

        def step(batches: Iterator[pa.RecordBatch], log_z: np.ndarray = log_z) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, s, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
                x, y = _newton(n, s, x, y, mass, log_z, model)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x), pa.array(y)], names=["place", "total", "moment", "a", "b"])

        solved = cut_lineage(solved.mapInArrow(step, schema))
        z = solved.select(*[F.sum(F.exp(F.col("a") + F.col("b") * float(g))).alias(f"z{i}") for i, g in enumerate(grid)]).first()
        log_z = np.log(np.array([max(v or 0.0, 1e-300) for v in z]))
    table = solved.select("place", "b").toArrow()
    difficulty = np.zeros(scale.places, dtype=np.float32)
    difficulty[table.column("place").to_numpy()] = table.column("b").to_numpy()
    return _Scale(scale.vocabulary, difficulty, log_z)


def _cuts(theta: np.ndarray, rated: np.ndarray) -> list[float]:
    """Cuts between the levels: the middle of the widest gap among those with few documents on the wrong side.

    Ratings are noisy, so a place counts as good if it has at most 2 % of the rated documents
    more on the wrong side than the best place.
    """
    cuts = []
    for k in (1, 2, 3):
        above = rated > k + 0.5
        if not above.any() or above.all():
            cuts.append(k - 2.0)
            continue
        order = np.argsort(theta, kind="stable")
        t, up = theta[order], above[order]
        wrong = np.concatenate(([0], np.cumsum(up))) + np.concatenate(([0], np.cumsum(~up[::-1])))[::-1]
        places = [i for i in np.flatnonzero(wrong <= wrong.min() + int(0.02 * len(t))) if 0 < i < len(t)]
        if not places:
            cuts.append(k - 2.0)
            continue
        i = max(places, key=lambda i: t[i] - t[i - 1])
        cuts.append(float((t[i - 1] + t[i]) / 2))
    return list(np.maximum.accumulate(cuts))


def reading_levels(documents: DataFrame, labels: DataFrame, model: LevelModel = LevelModel()) -> DataFrame:
    """``(doc_id, theta, reading_level int)`` of every English document of ``least_words`` or more.

    ``documents`` ``(doc_id, text)``; ``labels`` ``(doc_id, rater, level)``.  Without any rated
    document nothing tells the direction of the scale, and every document gets level 2.
    """
    documents = need(documents, ["doc_id", "text"], "reading_levels").where("doc_id is not null")
    words = cut_lineage(document_words(documents, model))
    spark = words.sparkSession
    rated = words.join(consensus(labels), "doc_id").dropDuplicates(["doc_id"])
    rated = cut_lineage(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(model.max_rated))
    if rated.isEmpty():
        return words.groupBy("doc_id").agg(F.lit(0.0).alias("theta")).select("doc_id", "theta", F.lit(2).alias("reading_level"))
    grid = model.grid

    def placed(rows: DataFrame, scale: _Scale) -> DataFrame:
        shared = spark.sparkContext.broadcast(scale)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, hashes, counts, owner in _slices(batches):
                theta = shared.value.levels(shared.value.place(hashes), counts, owner, part.num_rows, grid)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(theta)], names=["doc_id", "theta"])

        return rows.select("doc_id", "words", "distinct").mapInArrow(place, "doc_id bigint, theta double")

    scale = _Scale(vocabulary(words, model), None, None)
    scale = _solved(_statistics(rated, model, scale, "rated"), scale, model)
    before = None
    for _ in range(model.passes):
        scale = _solved(_statistics(words, model, scale, None), scale, model)
        # at most max_rated rows of 24 bytes: the rated documents, on which the movement is measured too
        known = placed(rated, scale).join(rated.select("doc_id", "rated"), "doc_id").orderBy("doc_id").toArrow()
        theta = known.column("theta").to_numpy()
        if before is not None and np.sqrt(np.mean((theta - before) ** 2)) <= model.still:
            break
        before = theta
    cuts = _cuts(theta, known.column("rated").to_numpy())
    level = sum(((F.col("theta") > c).cast("int") for c in cuts), F.lit(1))
    return placed(words, scale).groupBy("doc_id").agg(F.min("theta").alias("theta")).select("doc_id", "theta", level.cast("int").alias("reading_level"))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``p8_found``: (doc_id, reading_level)."""
    return reading_levels(documents, labels).select("doc_id", "reading_level")


def profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(source, reading_level, documents, mean_theta)``: the corpus by source (spelt alike) and level."""
    levels = reading_levels(documents, labels)
    sources = documents.select("doc_id", F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_").alias("source")).dropDuplicates(["doc_id"])
    return (
        sources.join(levels, "doc_id")
        .groupBy("source", "reading_level")
        .agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("theta"), 6).alias("mean_theta"))
    )
