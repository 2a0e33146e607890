"""Likeness of two texts from their longest common subsequence, for many pairs at once in numpy.

A pair's match masks are bits of 64-bit words, so one step along the second text serves all places of the first and all pairs of a
batch. All scores are between 0 and 1, of lower-cased texts; a text without letters is like nothing.

- whole: twice the common subsequence over both lengths.
- words in any order: whole of the alphabetically sorted words.
- shared words: 1 where one text's words are all among the other's; else the best of the shared words against either text's
  words, and of both texts' words with the shared ones first.
- likest stretch: whole of the shorter text and the best stretch of the longer one of its length, also cut off at the ends.
- weighted: the greatest of whole and 0.95 times the word scores. Where one text is 1.5 times as long as the other or more: the
  greatest of whole, 0.9 times the likest stretch and 0.95 * 0.9 times the word scores by likest stretch; beyond 8 times as
  long, 0.6 in place of 0.9.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of word scores and of stretches, and the ratios of lengths from which on and up to which they hold.
WORDS, STRETCH, LONG_STRETCH, LONGER, MUCH_LONGER = 0.95, 0.9, 0.6, 1.5, 8.0
#: Cells (pairs x places x places) that one step of a batch takes.
_STEP = 1 << 24


def _codes(texts: Sequence[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _batch_common(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    n = max(map(len, a))
    words = -(-n // 64)
    x, y = _codes(a, 64 * words, -1), _codes(b, max(map(len, b)), -2)
    rows = np.full((len(a), words), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(y.shape[1]):
        match = np.packbits(x == y[:, j, None], axis=1, bitorder="little").view(np.uint64)
        taken = rows & match
        kept = rows & ~match
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            total = rows[:, w] + taken[:, w]
            over = total < taken[:, w]
            again = total + carry
            carry = (over | (again < carry)).astype(np.uint64)
            rows[:, w] = again | kept[:, w]
    # A place that never matched keeps its bit: zeros are the subsequence, and none lie beyond a text's end.
    return np.bitwise_count(~rows).sum(axis=1)


def common_subsequence(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a[i] and b[i]."""
    out = np.zeros(len(a), np.int64)
    order = sorted((i for i in range(len(a)) if a[i] and b[i]), key=lambda i: (len(a[i]), len(b[i])))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * len(a[order[stop]]) * 8 <= _STEP and len(a[order[stop]]) <= 2 * len(a[order[start]]) + 64:
            stop += 1
        part = order[start:stop]
        out[part] = _batch_common([a[i] for i in part], [b[i] for i in part])
        start = stop
    return out


def whole(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Twice the common subsequence over both lengths; 0 where a text is empty."""
    if not len(a):
        return np.zeros(0)
    total = np.array([len(x) + len(y) for x, y in zip(a, b)])
    return 2 * common_subsequence(a, b) / np.maximum(total, 1)


def _best_of_many(groups: list[list[tuple[str, str]]]) -> np.ndarray:
    """The greatest `whole` among each group's pairs; 0 for an empty group."""
    flat = [p for g in groups for p in g]
    scores = whole([p[0] for p in flat], [p[1] for p in flat])
    out = np.zeros(len(groups))
    np.maximum.at(out, np.repeat(np.arange(len(groups)), [len(g) for g in groups]), scores)
    return out


def likest_stretch(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    groups = []
    for x, y in zip(a, b):
        short, long = sorted((x, y), key=len)
        n = len(short)
        places = range(1 - n, len(long)) if short else ()
        groups.append([(short, s) for s in dict.fromkeys(long[max(0, p) : p + n] for p in places)])
    return _best_of_many(groups)


def _sorted_words(texts: Sequence[str]) -> list[str]:
    return [" ".join(sorted(t.split())) for t in texts]


def words_in_any_order(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return whole(_sorted_words(a), _sorted_words(b))


def _parted(x: str, y: str) -> tuple[str, str, str]:
    one, two = set(x.split()), set(y.split())
    return tuple(" ".join(sorted(s)) for s in (one & two, one - two, two - one))


def shared_words(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    groups, sure = [], np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        both, only_x, only_y = _parted(x, y)
        if both and not (only_x and only_y):
            sure[i] = 1.0
            groups.append([])
            continue
        with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
        groups.append([(with_x, with_y), *([(both, with_x), (both, with_y)] if both else [])])
    return np.maximum(sure, _best_of_many(groups))


def weighted(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The weighted score of each pair of lower-cased texts."""
    out = whole(a, b)
    n = np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    ratio = n.max(axis=1, initial=0) / np.maximum(n.min(axis=1, initial=1 << 62), 1)
    some = n.min(axis=1, initial=1 << 62) > 0
    near, far = np.flatnonzero(some & (ratio < LONGER)), np.flatnonzero(some & (ratio >= LONGER))
    at = lambda texts, where: [texts[i] for i in where]
    if len(near):
        x, y = at(a, near), at(b, near)
        out[near] = np.maximum(out[near], WORDS * np.maximum(words_in_any_order(x, y), shared_words(x, y)))
    if len(far):
        x, y = at(a, far), at(b, far)
        weight = np.where(ratio[far] <= MUCH_LONGER, STRETCH, LONG_STRETCH)
        parts = [_parted(p, q) for p, q in zip(x, y)]
        by_words = likest_stretch(_sorted_words(x), _sorted_words(y))
        apart = likest_stretch([p[1] for p in parts], [p[2] for p in parts])
        by_words = np.maximum(by_words, np.where([bool(p[0]) for p in parts], 1.0, apart))
        out[far] = np.maximum(out[far], weight * np.maximum(likest_stretch(x, y), WORDS * by_words))
    return out


def weighted_likeness(a: Column, b: Column) -> Column:
    """The weighted score of two text columns; null where one is null."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        there = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[there] = weighted([t.lower() for t in x[there]], [t.lower() for t in y[there]])
        return pd.Series(out).where(there, None)

    return score(a, b)
