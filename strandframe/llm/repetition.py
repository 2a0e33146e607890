"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it repeats.

Rolling hashes of several n-gram lengths are computed for many texts at once in numpy. A text fails where the
characters inside its repeated n-grams of any length, or its repeated lines, exceed that length's share.
Everything happens where the text is read; no shuffle.

Null, empty and blank texts have zero counts and fail the base rule. Repeated rows each get their own result, an empty table
none. A share equal to its limit passes. Extra columns pass by only when named in `keep`; a name that is also an output raises.
Bytes of a very long text are hashed a piece at a time; its words and lines are held whole (about 20 bytes of memory for each
byte of text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BEGINS, check_keep, combine, in_steps, line_spans, mix64, span_counts, span_hashes, tidy, utf8, word_spans


@dataclass(frozen=True)
class RepetitionRules:
    #: Share of word characters allowed inside repeated n-grams, by n.
    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.40, 8: 0.30, 12: 0.30})
    #: Share of word characters allowed in lines that equal an earlier one.
    line_share: float = 0.30
    min_words: int = 20
    #: Base rule: per cent of words allowed inside repeated windows of `base_window` words.
    base_window: int = 8
    base_percent: int = 30


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries whose key occurs twice or more, entries whose key occurred before)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1] if len(keys) else []
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], base_window: int) -> dict[str, np.ndarray]:
    """Counts of each text; `ngram_<n>` and `dup_lines` are numbers of characters in words."""
    n = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    chars = span_counts(data, starts, ends, BEGINS)
    per_text = lambda weights: np.bincount(owner, weights=weights, minlength=n).astype(np.int64)
    out = {"n_words": np.bincount(owner, minlength=n).astype(np.int64), "word_chars": per_text(chars), "n_symbols": per_text(span_counts(data, starts, ends, _SYMBOL))}
    words = span_hashes(data, starts, ends)
    own = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))  # sets the texts of a step apart
    last_word = np.searchsorted(owner, np.arange(n), side="right")
    for k in {*lengths, base_window}:
        rolled = combine(words, k)
        begin = np.flatnonzero(last_word[owner[: len(rolled)]] - np.arange(len(rolled)) >= k)
        twice, _ = _repeated(rolled[begin] ^ own[owner[begin]])
        edge = np.zeros(len(words) + 1, np.int32)
        edge[begin[twice]] = 1
        edge[begin[twice] + k] -= 1
        covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
        out[f"ngram_{k}"] = per_text(chars * covered)
        if k == base_window:
            out["n_repeat_words"] = per_text(covered)
    line_starts, line_ends = line_spans(data, offsets)
    word_from, word_to = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    real = word_to > word_from
    line_starts, line_ends, word_from, word_to = line_starts[real], line_ends[real], word_from[real], word_to[real]
    line_owner = owner[word_from]
    _, later = _repeated(span_hashes(data, line_starts, line_ends) ^ own[line_owner])
    sums = np.concatenate([[0], np.cumsum(chars)])
    out["n_dup_lines"] = np.bincount(line_owner, weights=later, minlength=n).astype(np.int64)
    out["dup_lines"] = np.bincount(line_owner, weights=(sums[word_to] - sums[word_from]) * later, minlength=n).astype(np.int64)
    return out


def repetition_quality(df: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, the counts, the share of characters in repeated n-grams of each length and in repeated lines,
    base_failed, and kept: neither the base rule nor any share is exceeded."""
    check_keep(keep, (*_COUNTS, *(f"ngram_share_{k}" for k in rules.ngram_share), "dup_line_share", "base_failed", "kept"))
    lengths = tuple(sorted(rules.ngram_share))
    shares = [f"ngram_share_{k}" for k in lengths] + ["dup_line_share"]
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType(
        [f for f in source.schema if f.name != "__text"]
        + [T.StructField(c, T.LongType(), False) for c in _COUNTS]
        + [T.StructField(c, T.DoubleType(), False) for c in shares]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_steps(batches, "__text"):
            m = measure(*utf8(part.column("__text")), lengths, rules.base_window)
            whole = np.maximum(m["word_chars"], 1)
            columns = [pa.array(m[c], pa.int64()) for c in _COUNTS]
            columns += [pa.array(m[f"ngram_{k}"] / whole, pa.float64()) for k in lengths] + [pa.array(m["dup_lines"] / whole, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], [*keep, *_COUNTS, *shares])

    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.base_percent * F.col("n_words"))
    fine = ~failed & (F.col("dup_line_share") <= rules.line_share)
    for k in lengths:
        fine &= F.col(f"ngram_share_{k}") <= rules.ngram_share[k]
    return source.mapInArrow(tidy(run), schema).withColumns({"base_failed": failed, "kept": fine})
