"""Problem 7: mixing sources to target shares of tokens, with capped repetition.

Temperature mixing: the source token shares are exponentiated, ``w(x) ~ target ** (1 - x) * share ** x``,
so exponent 0 is the target mix and 1 the natural one, in which all sources repeat alike.  The
least exponent at which no source exceeds its repetitions at the budget is found by bisection.
``temperature_weights`` is the plain family ``share ** x``, bisected for a wished entropy.

The weights are realised as block permutations: in each pass over a source every document falls
into a block by a seeded hash and has a place in it; blocks are taken in order until the budget
of the source, and only the block in which it runs out is cut by document.  A block holds a fixed
number of tokens, whatever the size of the source, and sums over blocks are made in two levels,
so no source, however large, passes through one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from math import log
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut_lineage, need

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_key(source):
    """One spelling of a source: trimmed, lower case, runs of blanks, hyphens and underscores as ``_``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens)``, one row per document; null and empty texts have 0 tokens.

    ``tokenizer`` is a rank file that the driver reads and sends to the executors (under 1 MB).
    """
    documents = need(documents, ["doc_id", "source", "text"], "token_counts").where("doc_id is not null")
    ranks = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines()) if a}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    counted = documents.select("doc_id", source_key("source").alias("source"), "text").mapInArrow(count, "doc_id bigint, source string, tokens bigint")
    return counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * log(w) for w in weights.values() if w > 0)


def _tempered(base: dict[str, float], ratio: dict[str, float], x: float) -> dict[str, float]:
    raw = {s: base[s] * ratio[s] ** x for s in base}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def _bisect(good, lo: float = 0.0, hi: float = 1.0, steps: int = 60) -> float:
    """The least x in [lo, hi] that is good, good being monotone and true at hi."""
    if good(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


def temperature_weights(tokens: dict[str, int], target_entropy: float) -> dict[str, float]:
    """``natural share ** x`` normalised, x in [0, 1] the least at which the entropy is at most the target's."""
    total = sum(tokens.values())
    one, shares = {s: 1.0 for s in tokens if tokens[s]}, {s: n / total for s, n in tokens.items() if n}
    return _tempered(one, shares, _bisect(lambda x: entropy(_tempered(one, shares, x)) <= target_entropy))


@dataclass(frozen=True)
class MixPlan:
    """``quota``: tokens to take of each source; ``exponent`` 0 if the targets are met, null for the plain family."""

    budget: int
    exponent: float | None
    weights: dict[str, float]
    quota: dict[str, int]


#: Budgets by name: the largest at which every target is met, and the tokens of all listed sources.
MEET_TARGETS, ALL_TOKENS = "meet_targets", "all_tokens"


def plan_mix(
    tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: int | str | None = None, target_entropy: float | None = None
) -> MixPlan:
    """Weights and quotas for sources with ``tokens``; targets of sources without tokens fall to the others.

    ``budget`` is in tokens, or ``MEET_TARGETS`` (also for None) or ``ALL_TOKENS``.  With
    ``target_entropy`` the weights are the plain ``temperature_weights``.  Sources that exceed a
    repetition limit at that exponent too give all they may and the others share the rest; beyond
    what the repetitions of all sources allow, each gives all it may.
    """
    usable = {s: t for s, t in targets.items() if t > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not usable:
        return MixPlan(0, 0.0, {}, {})
    total_target, total = sum(usable.values()), sum(tokens[s] for s in usable)
    target = {s: t / total_target for s, t in usable.items()}
    limit = {s: tokens[s] * repeats[s] for s in usable}
    if budget is None or budget == MEET_TARGETS:
        budget = int(min(limit[s] / target[s] for s in usable))
    elif budget == ALL_TOKENS:
        budget = total
    if target_entropy is not None:
        weights = temperature_weights({s: tokens[s] for s in usable}, target_entropy)
        return MixPlan(budget, None, weights, {s: min(limit[s], int(w * budget)) for s, w in weights.items()})
    ratio = {s: tokens[s] / total / target[s] for s in usable}
    exponent, quota, free, left = None, {}, set(usable), float(budget)
    while free:
        at = lambda x: _tempered({s: target[s] for s in free}, ratio, x)  # noqa: B023, E731
        over = lambda x: [s for s, w in at(x).items() if w * left > limit[s] * (1 + 1e-12)]  # noqa: B023, E731
        # tempering relieves the sources whose targets are above their natural shares
        relieved = {s for s in free if ratio[s] * sum(target[k] for k in free) < sum(target[k] * ratio[k] for k in free)}
        good = lambda x: not relieved & set(over(x))  # noqa: B023, E731
        x = _bisect(good) if good(1.0) else 1.0
        exponent = x if exponent is None else exponent
        full = over(x)
        quota |= {s: limit[s] for s in full} if full else {s: min(limit[s], int(w * left)) for s, w in at(x).items()}
        left -= sum(limit[s] for s in full)
        free = free - set(full) if full else set()
    size = max(1, sum(quota.values()))
    return MixPlan(budget, exponent, {s: q / size for s, q in quota.items()}, quota)


def _plan(counts: DataFrame, targets: DataFrame, budget: int | str | None, tempered: bool) -> tuple[MixPlan, DataFrame]:
    """The plan and the targets with tokens; one row for each listed source reaches the driver."""
    targets = need(targets, ["source", "target_share", "max_repeats"], "mix").where("source is not null").dropDuplicates(["source"])
    have = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    joined = cut_lineage(
        targets.select("source", "target_share", "max_repeats").join(have, "source", "left").fillna(0, ["tokens", "documents", "max_repeats"]).fillna(0.0, ["target_share"])
    )
    rows = joined.collect()
    wanted = entropy({r.source: r.target_share for r in rows if r.tokens}) if tempered else None
    return (
        plan_mix({r.source: r.tokens for r in rows}, {r.source: r.target_share for r in rows}, {r.source: r.max_repeats for r in rows}, budget, wanted),
        joined,
    )


@dataclass(frozen=True)
class Mixture:
    """``rows``, one for each copy taken (see ``mix``); ``plan``; ``targets``."""

    rows: DataFrame
    plan: MixPlan
    targets: DataFrame


#: Tokens of a block, and blocks whose sizes are summed in one task.
BLOCK_TOKENS, BLOCKS_AT_ONCE = 1_000_000, 4096


def mix(
    documents: DataFrame,
    targets: DataFrame,
    budget: int | str | None = None,
    seed: int = 7,
    block_tokens: int = BLOCK_TOKENS,
    tokenizer: str = TOKENIZER,
    tempered: bool = False,
) -> Mixture:
    """Documents of ``(doc_id, source, text)`` taken for the shares of ``(source, target_share, max_repeats)``.

    Rows are ``(source, pass, block, place, doc_id, tokens, running_tokens, running_share)``: the
    permutation of each source, ``running_tokens`` being those of the source up to the row and
    ``running_share`` their part of its quota.  In order of ``running_share`` the sources come
    mixed, and every prefix has the shares of the whole.

    Sources are compared by ``source_key``; documents of unlisted or null sources and without
    tokens are not taken.  No source is taken more than ``max_repeats`` times, and none beyond
    its quota; what a quota is short of is less than one document.  ``tempered`` takes the plain
    family at the entropy of the targets.
    """
    counts = cut_lineage(token_counts(documents, tokenizer))
    targets = targets.withColumn("source", source_key("source"))
    plan, listed = _plan(counts, targets, budget, tempered)
    spark = documents.sparkSession
    quotas = spark.createDataFrame([(s, q) for s, q in plan.quota.items()], "source string, quota bigint")
    # as many rows as there are listed sources
    sized = listed.join(quotas, "source").where("quota > 0").select(
        "source", "quota", F.col("tokens").alias("source_tokens"), F.ceil(F.col("tokens") / block_tokens).alias("blocks")
    )
    passes = F.ceil(F.col("quota") / F.col("source_tokens")).cast("int")
    docs = counts.where("tokens > 0").join(F.broadcast(sized), "source").withColumn("pass", F.explode(F.sequence(F.lit(1), passes)))
    hashed = F.xxhash64(F.lit(seed), F.col("pass"), F.col("doc_id"))
    key = ["source", "pass", "block"]
    docs = docs.withColumn("hash", hashed).withColumn("block", F.pmod("hash", "blocks"))
    sizes = docs.groupBy(*key).agg(F.sum("tokens").alias("size"), F.min("quota").alias("quota"), F.min("source_tokens").alias("source_tokens"))
    begins = block_starts(sizes, BLOCKS_AT_ONCE).select(
        *key, "before", (F.col("quota") - (F.col("pass") - 1) * F.col("source_tokens")).alias("open")
    ).where("before < open")
    inside = W.partitionBy(*key).orderBy("hash", "doc_id")
    taken = docs.select(*key, "hash", "doc_id", "tokens", "quota", "source_tokens").join(begins, key)
    taken = taken.withColumn("within", F.col("before") + F.sum("tokens").over(inside)).where("within <= open")
    running = (F.col("pass") - 1) * F.col("source_tokens") + F.col("within")
    # what is left of a block after its cut has the first places
    rows = taken.withColumn("place", F.row_number().over(inside)).select(
        *key, "place", "doc_id", "tokens", running.alias("running_tokens"), (running / F.col("quota")).alias("running_share")
    )
    return Mixture(rows, plan, listed)


def block_starts(sizes: DataFrame, at_once: int) -> DataFrame:
    """Block sizes ``(source, pass, block, size, ...)`` with ``before``, the tokens of the pass before the block.

    Summed in groups of ``at_once`` blocks and over the groups, so that no task sums all blocks.
    """
    grouped = sizes.withColumn("range", F.floor(F.col("block") / at_once))
    ranges = grouped.groupBy("source", "pass", "range").agg(F.sum("size").alias("range_size"))
    over = W.partitionBy("source", "pass").orderBy("range")
    ranges = ranges.withColumn("range_before", F.sum("range_size").over(over) - F.col("range_size")).drop("range_size")
    within = W.partitionBy("source", "pass", "range").orderBy("block")
    placed = grouped.withColumn("in_range", F.sum("size").over(within) - F.col("size"))
    return placed.join(ranges, ["source", "pass", "range"]).withColumn("before", F.col("range_before") + F.col("in_range")).drop("range", "range_before", "in_range")


def report(mixture: Mixture) -> DataFrame:
    """A row for each listed source: target, available, taken, the actual share and repetitions."""
    plan = mixture.plan
    spark = mixture.rows.sparkSession
    weights = spark.createDataFrame([(s, w, plan.quota[s]) for s, w in plan.weights.items()], "source string, weight double, quota bigint")
    taken = mixture.rows.groupBy("source").agg(
        F.sum("tokens").alias("taken_tokens"), F.count(F.lit(1)).alias("taken_rows"), F.max("pass").alias("passes")
    )
    # a window over as many rows as there are listed sources
    all_taken = F.sum("taken_tokens").over(W.partitionBy(F.lit(1)))
    return (
        mixture.targets.join(weights, "source", "left")
        .join(taken, "source", "left")
        .fillna(0, ["quota", "taken_tokens", "taken_rows", "passes"])
        .fillna(0.0, ["weight"])
        .select(
            "source", "target_share", "max_repeats", "documents", "tokens", "weight", "quota", "taken_rows", "taken_tokens", "passes",
            F.coalesce(F.try_divide(F.col("taken_tokens"), all_taken), F.lit(0.0)).alias("actual_share"),
            F.when(F.col("tokens") > 0, F.col("taken_tokens") / F.col("tokens")).otherwise(0.0).alias("repetitions"),
            F.lit(plan.exponent).cast("double").alias("exponent"),
        )
    )
