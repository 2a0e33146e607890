"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every labelled row where it is read; only sums by (language, bucket) are shuffled. The
matrix of log-probabilities (languages x buckets) has a size that the parameters fix and is broadcast. Scoring
gathers matrix rows for the n-grams of a batch and sums them by text.

The posterior of a text of some words is near 1 for the best of the learnt languages, also where the text is in none of
them. `fit` tells that apart: it is the mean log-probability of the text's n-grams of letters less what texts of that language
have on average, so near 0 for them, whatever the length, and far below for other languages.

A text that is null or has no letter gets `und`, score 0 and no fit. Empty training data gives `und` for all. Ties go to the
language that sorts first. Repeated rows each get their own result, an empty table none. Columns pass by only when named in
`keep`; a name that is also an output raises. N-grams of a very long text are counted a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, Shared, check_keep, in_steps, tidy

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


@dataclass
class LanguageModel:
    languages: list[str]
    orders: tuple[int, ...]
    buckets: int
    #: One row for each bucket, one column for each language.
    log_probability: np.ndarray
    log_prior: np.ndarray
    #: Mean log-probability of an n-gram of each language's training texts.
    usual: np.ndarray


def _ngrams(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, index of the text, whether of letters and blanks alone) of all n-grams, a piece at a time. Texts are lower-cased and set apart by a blank."""
    lowered = [x.lower() for x in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in lowered])  # the blank before each text is its own
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, STEP_BYTES):
        piece = points[begin : begin + STEP_BYTES + max(orders) - 1].astype(np.uint64)
        letter = (piece == 32) | (piece >= 97) & (piece <= 122) | (piece >= 0xC0)
        owner = np.searchsorted(ends, np.arange(begin, min(begin + len(piece), int(ends[-1]))), side="right")
        for n in orders:
            size = min(STEP_BYTES, len(owner) - n + 1)
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            for j in range(n):
                h = (h + piece[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            same = owner[:size] == owner[n - 1 : n - 1 + size]
            plain = np.logical_and.reduce([letter[j : j + size] for j in range(n)])
            yield (h >> shift)[same].astype(np.int64), owner[:size][same], plain[same]


def train_language_model(df: DataFrame, text: str = "text", label: str = "lang", orders: tuple[int, ...] = (2, 3), buckets: int = 1 << 16, smoothing: float = 0.5, max_languages: int = 256) -> LanguageModel:
    """Model of all rows of df with a label and a text. `buckets` must be a power of two; more than max_languages labels raise."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    source = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("__label"), F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for part in in_steps(batches, "__text"):
            labels, texts = part.column("__label").to_pylist(), part.column("__text").to_pylist()
            for one in dict.fromkeys(labels):
                own = [x for x, y in zip(texts, labels, strict=True) if y == one]
                for bucket, *_ in _ngrams(own, orders, buckets):
                    totals[one] = totals.get(one, 0) + np.bincount(bucket, minlength=buckets)
                totals.setdefault(one, np.zeros(buckets, np.int64))
                rows[one] = rows.get(one, 0) + len(own)
        for one, total in totals.items():
            used = np.flatnonzero(total)
            at, n = np.concatenate([[-1], used]), np.concatenate([[rows[one]], total[used]])
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at)), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["label", "bucket", "n"])

    sums = source.mapInArrow(tidy(count), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # One row for each language, with at most buckets + 1 pairs, whatever the input.
    table = sums.groupBy("label").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("label").limit(max_languages + 1).toArrow()
    languages = table.column("label").to_pylist()
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} labels: the matrix would be too large to send to every machine")
    if not languages:
        return LanguageModel([], orders, buckets, np.zeros((buckets, 0), np.float32), np.zeros(0), np.zeros(0))
    counts, prior = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    for i, (bucket, n) in enumerate(zip(table.column("bucket"), table.column("n"), strict=True)):
        bucket, n = bucket.values.to_numpy(), n.values.to_numpy()
        prior[i] = n[bucket < 0].sum()
        counts[bucket[bucket >= 0], i] = n[bucket >= 0]
    smooth = counts + smoothing
    log_probability = np.log(smooth / smooth.sum(axis=0))
    usual = (counts * log_probability).sum(axis=0) / np.maximum(counts.sum(axis=0), 1)
    return LanguageModel(languages, orders, buckets, log_probability.astype(np.float32), np.log(prior / prior.sum()), usual)


def _posterior(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each language, one row for each text; fit to the likeliest one)."""
    n = len(texts)
    total = np.zeros((n, len(model.languages)))
    found = lambda: _ngrams(texts, model.orders, model.buckets)
    pieces = list(found()) if sum(map(len, texts)) <= 4 * STEP_BYTES else None  # a very long text is read twice instead
    for bucket, owner, _ in pieces if pieces is not None else found():
        for j in range(len(model.languages)):
            total[:, j] += np.bincount(owner, weights=model.log_probability[:, j][bucket], minlength=n)
    total += model.log_prior
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    best, size, mean = p.argmax(axis=1), np.zeros(n), np.zeros(n)
    for bucket, owner, plain in pieces if pieces is not None else found():
        bucket, owner = bucket[plain], owner[plain]
        size += np.bincount(owner, minlength=n)
        mean += np.bincount(owner, weights=model.log_probability[bucket, best[owner]], minlength=n)
    return p / p.sum(axis=1, keepdims=True), mean / np.maximum(size, 1) - model.usual[best]


def identify_language(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), label_out: str = "lang_pred", score_out: str = "score", fit_out: str = "fit") -> DataFrame:
    """The columns of `keep`, the likeliest language, its posterior probability and how well the text fits it."""
    check_keep(keep, (label_out, score_out, fit_out))
    shared = Shared(df.sparkSession, model)
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(f for f in source.schema if f.name != "__text"), T.StructField(label_out, T.StringType(), False), T.StructField(score_out, T.DoubleType(), False), T.StructField(fit_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.once()
        for part in in_steps(batches, "__text"):
            texts = [x or "" for x in part.column("__text").to_pylist()]
            if m.languages:
                p, fit = _posterior(texts, m)
                best = p.argmax(axis=1)
                known = [_LETTER(x) is not None for x in texts]
                labels = [m.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                scores, fits = np.where(known, p.max(axis=1), 0.0), fit
            else:
                known = [False] * len(texts)
                labels, scores, fits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            columns = [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64(), mask=~np.array(known, bool))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], [*keep, label_out, score_out, fit_out])

    return source.mapInArrow(tidy(run), schema)
