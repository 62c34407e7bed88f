"""Vectorised word streams: the words of a batch of texts as 64-bit hashes.

A word is a maximal run of ``a-z0-9`` of the lower-cased text.  Whole batches are
tokenised with a handful of numpy passes, so the cost per text is linear in its bytes
and no Python object is made per word.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[a-z0-9]+")

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[ord("0") : ord("9") + 1] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: words of text ``i`` are ``hashes[bounds[i]:bounds[i + 1]]``.

    ``None`` and texts without words yield an empty range.
    """
    hashes, bounds, _ = sized_word_stream(texts)
    return hashes, bounds


def sized_word_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, bounds, lengths)``: ``word_stream`` with the letters of each word counted."""
    joined = "\n".join([t or "" for t in texts]) + "\n"
    # one text per segment: newlines inside a text are blanks, so mark the ends by length
    parts = [len((t or "").lower().encode("utf-8", "replace")) + 1 for t in texts]
    raw = np.frombuffer(joined.lower().encode("utf-8", "replace"), dtype=np.uint8)
    ends = np.cumsum(parts) if parts else np.zeros(0, dtype=np.int64)
    if len(ends) and ends[-1] != len(raw):  # context-dependent lower-casing: fall back to per-text bytes
        raw = np.frombuffer(b"".join((t or "").lower().encode("utf-8", "replace") + b"\n" for t in texts), dtype=np.uint8)
    is_word = _IS_WORD[raw]
    starts = np.flatnonzero(is_word & ~np.concatenate(([False], is_word[:-1]))) if len(raw) else np.zeros(0, np.int64)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds, np.zeros(0, dtype=np.int64)
    chars = np.flatnonzero(is_word)
    first = np.searchsorted(chars, starts)
    lengths = np.diff(np.append(first, len(chars)))
    position = np.arange(len(chars)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        weighted = raw[chars].astype(np.uint64) * _powers(int(lengths.max()))[position]
        return mix(np.add.reduceat(weighted, first)), bounds, lengths


def shingle_stream(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word sequences and the index of their text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[:n] == owner[width - 1 :]
    with np.errstate(over="ignore"):
        value = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            value = value * np.uint64(0x100000001B3) + mix(hashes[k : k + n] + np.uint64(k + 1))
    return mix(value[inside]), owner[:n][inside]


def unique_by_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(owner, value)`` pairs, sorted by owner and value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], owner[keep]
