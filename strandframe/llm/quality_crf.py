"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score comes from its own features and those of the lines before and after;
the chain scores label changes. Forward-backward gives each line's probability of being good, and the mean over lines,
weighted by their length, is the document's score. Feature extraction and forward-backward (as prefix products of 2 x 2
matrices) run in numpy for many documents at once, where they are read; the model is a few kilobytes.

Weights are learnt on the driver from at most `max_documents` labelled rows and `max_bytes` of their text (the rows of least
hash, none of over `max_text_bytes`; documented bounds of the training sample, not of what is scored). Only documents have
labels. A first model takes a document's label for all its lines, without the chain; lines that it is sure belong with
the other label then change theirs, and the chain is learnt from these line labels, changes inside documents included.

Null, empty and blank texts have no line and score `empty_score`. Repeated rows each get their own result, an empty table
none. No training rows: every line scores 0.5. Columns pass by
only when named in `keep`; a name that is also an output raises. A very long text is read a piece at a time; the features of its
lines are held whole (about 500 bytes of memory for each line).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, check_keep, in_steps, line_spans, mix64, span_counts, span_hashes, tidy, utf8, word_spans

BINS = 8
#: Upper bounds of the bins of each measure.
EDGES = {
    "symbols": [0.001, 0.005, 0.01, 0.03, 0.06, 0.1, 0.2],
    "upper": [0.005, 0.02, 0.05, 0.1, 0.3, 0.6, 0.9],
    "digits": [0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4],
    "marks": [0.005, 0.015, 0.03, 0.05, 0.08, 0.12, 0.2],
    "word_length": [2.0, 3.0, 4.0, 5.0, 6.0, 7.5, 10.0],
    "repeated_words": [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7],
    "words": [1.5, 3.5, 6.5, 12.5, 25.5, 50.5, 120.5],
    "repeated_line": [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5],
}
N_FEATURES = 3 * len(EDGES) * BINS + 3

_IS_SYMBOL, _IS_UPPER, _IS_DIGIT, _IS_MARK = (np.zeros(256, bool) for _ in range(4))
_IS_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]\\^~_=@+/"]] = True
_IS_UPPER[65:91] = True
_IS_DIGIT[48:58] = True
_IS_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True


@dataclass
class LineChain:
    #: Weight of each feature for "good" against "bad".
    weights: np.ndarray
    #: Score of a label change from row to column, labels bad and good.
    change: np.ndarray
    empty_score: float


@dataclass
class Lines:
    features: np.ndarray  # feature numbers of each line
    length: np.ndarray
    owner: np.ndarray  # index of the line's document, ascending


def extract(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Features of all lines that have a word."""
    starts, ends, text_of = word_spans(data, offsets)
    begin, end = line_spans(data, offsets)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    real = last > first
    begin, end, first, last = begin[real], end[real], first[real], last[real]
    n = len(begin)
    if n == 0:
        return Lines(np.zeros((0, len(EDGES) * 3 + 1), np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner = text_of[first]
    length = (end - begin).astype(np.float64)

    def share(table: np.ndarray) -> np.ndarray:
        return span_counts(data, begin, end, table) / length

    n_words = last - first
    line_of = np.repeat(np.arange(n), n_words)
    words = span_hashes(data, starts, ends) ^ mix64(line_of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(words, kind="stable")
    again = np.zeros(len(words), bool)
    again[order[1:]] = words[order[1:]] == words[order[:-1]]
    copies = np.bincount(line_of, weights=again, minlength=n)
    line_hash = span_hashes(data, begin, end) ^ mix64(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(line_hash, kind="stable")
    same = np.zeros(n + 1, bool)
    same[1:-1] = line_hash[order[1:]] == line_hash[order[:-1]]
    repeated = np.zeros(n)
    repeated[order] = same[:-1] | same[1:]
    sizes = np.concatenate([[0], np.cumsum(ends - starts)])
    measures = {
        "symbols": share(_IS_SYMBOL), "upper": share(_IS_UPPER), "digits": share(_IS_DIGIT), "marks": share(_IS_MARK),
        "word_length": (sizes[last] - sizes[first]) / n_words, "repeated_words": copies / n_words, "words": n_words, "repeated_line": repeated,
    }
    own = np.stack([np.digitize(measures[k], edges) + BINS * i for i, (k, edges) in enumerate(EDGES.items())], axis=1).astype(np.int16)
    width = len(EDGES) * BINS
    nothing = 3 * width  # the feature "no such neighbour" does not tell the two sides apart, nor the measures
    before, after = np.full_like(own, nothing), np.full_like(own, nothing)
    joined = owner[1:] == owner[:-1]
    before[1:][joined] = own[:-1][joined] + width
    after[:-1][joined] = own[1:][joined] + 2 * width
    bias = np.full((n, 1), nothing + 1, np.int16)
    return Lines(np.concatenate([own, before, after, bias], axis=1), length.astype(np.int64), owner)


def _products(steps: np.ndarray, longest: int) -> np.ndarray:
    """Products of each 2 x 2 matrix (last axis) with up to `longest` - 1 before it: distances double, so it takes few passes."""
    distance = 1
    while distance < longest:
        before, own = steps[:, :, :-distance], steps[:, :, distance:]
        new = steps.copy()
        for i in (0, 1):
            for j in (0, 1):
                new[i, j, distance:] = before[i, 0] * own[0, j] + before[i, 1] * own[1, j]
        steps = new / new.max(axis=(0, 1))
        distance *= 2
    return steps


def marginals(score: np.ndarray, owner: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good for each line, expected label changes), by forward-backward. score: of good against bad."""
    n = len(score)
    if n == 0:
        return np.zeros(0), np.zeros((2, 2))
    emit = np.stack([np.zeros(n), score], axis=1)
    emit = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -300))
    move = np.exp(change - change.max())
    joined = np.append(False, owner[1:] == owner[:-1])
    longest = int(np.diff(np.append(np.flatnonzero(~joined), n)).max())
    # The first line of a document forgets what came before it, so products may run over all lines.
    into = np.where(joined, move[:, :, None] * emit.T[None], emit.T[None])
    ahead = _products(into, longest)[0].T
    back = np.ones((2, 2, n))
    back[:, :, :-1][:, :, joined[1:]] = into[:, :, joined]
    behind = _products(back.transpose(1, 0, 2)[:, :, ::-1], longest)[:, :, ::-1].sum(axis=0).T
    ahead = ahead / ahead.sum(axis=1, keepdims=True)
    behind = behind / behind.sum(axis=1, keepdims=True)
    at = np.flatnonzero(joined)
    joint = ahead[at - 1][:, :, None] * move[None] * (emit[at] * behind[at])[:, None, :]
    pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = ahead * behind
    return p[:, 1] / p.sum(axis=1), pairs


def fit(lines: Lines, truth: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-4, chain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights of greatest conditional likelihood of the line labels `truth`; without the chain changes score 0."""
    weights, change = np.zeros(N_FEATURES), np.zeros((2, 2))
    if len(lines.owner) == 0:
        return weights, change
    truth = truth.astype(float)
    joined = lines.owner[1:] == lines.owner[:-1]
    seen = np.bincount(2 * truth[:-1][joined].astype(int) + truth[1:][joined].astype(int), minlength=4).reshape(2, 2).astype(float)
    n, width = len(truth), lines.features.shape[1]
    flat = lines.features.ravel()
    first, second = [np.zeros(N_FEATURES), np.zeros((2, 2))], [np.zeros(N_FEATURES), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        score = weights[lines.features].sum(axis=1)
        p, pairs = marginals(score, lines.owner, change) if chain else (1 / (1 + np.exp(-score)), seen)
        slopes = [np.bincount(flat, weights=np.repeat(truth - p, width), minlength=N_FEATURES) / n - decay * weights, (seen - pairs) / n - decay * change]
        for i, (value, slope) in enumerate(zip((weights, change), slopes, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            value += rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return weights, change


def line_labels(lines: Lines, labels: np.ndarray, sure: float) -> np.ndarray:
    """A label for each line: its document's, or the other one where a model without the chain, which saw each document's
    label at all its lines, gives that a probability of `sure` or more."""
    truth = labels[lines.owner].astype(int)
    weights, _ = fit(lines, truth, chain=False)
    p = 1 / (1 + np.exp(-weights[lines.features].sum(axis=1)))
    return np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, truth))


def train_line_chain(labelled: DataFrame, text: str = "text", label: str = "quality", max_documents: int = 4000, max_bytes: int = 64 << 20, max_text_bytes: int = 1 << 20, sure: float = 0.95, empty_score: float = 0.0) -> LineChain:
    """Model of the rows of `labelled` with a text and a label of 0 or 1, or of the first of least hash within the bounds."""
    rows = labelled.where(F.col(label).isin(0, 1) & (F.octet_length(text) <= max_text_bytes)).select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.xxhash64(text).alias("h"))
    sizes = rows.select("h", "y", F.octet_length("t").alias("size")).orderBy("h", "y").limit(max_documents).collect()
    n = int((np.cumsum([r["size"] for r in sizes]) <= max_bytes).sum()) if sizes else 0
    if n == 0:
        return LineChain(np.zeros(N_FEATURES), np.zeros((2, 2)), empty_score)
    rows = rows.orderBy("h", "y").limit(n).select("t", "y").toArrow()
    parts, before = [], 0
    for part in in_steps(iter(rows.to_batches()), "t"):
        own = extract(*utf8(part.column("t")))
        parts.append(Lines(own.features, own.length, own.owner + before))
        before += part.num_rows
    lines = Lines(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("features", "length", "owner")))
    weights, change = fit(lines, line_labels(lines, rows.column("y").to_numpy(), sure))
    return LineChain(weights, change, empty_score)


def sample_labels(labels: DataFrame, doc_id: str = "doc_id", max_documents: int = 4000) -> DataFrame:
    """All labels, or the max_documents of least hash of their id where there are more; so joining them to texts moves no text."""
    return labels.where(F.col(doc_id).isNotNull()).orderBy(F.xxhash64(doc_id), doc_id).limit(max_documents)


def score_documents(data: np.ndarray, offsets: np.ndarray, model: LineChain) -> np.ndarray:
    n = len(offsets) - 1
    lines = extract(data, offsets)
    score = np.concatenate([model.weights[lines.features[i : i + 50_000]].sum(axis=1) for i in range(0, max(1, len(lines.owner)), 50_000)])
    good, _ = marginals(score, lines.owner, model.change)
    size = np.bincount(lines.owner, weights=lines.length, minlength=n)
    total = np.bincount(lines.owner, weights=lines.length * good, minlength=n)
    return np.where(size > 0, total / np.maximum(size, 1), model.empty_score)


def score_quality(df: DataFrame, model: LineChain, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns of `keep` and the quality score, 0 to 1."""
    check_keep(keep, (out,))
    shared = Shared(df.sparkSession, model)
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(f for f in source.schema if f.name != "__text"), T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_steps(batches, "__text"):
            score = np.clip(score_documents(*utf8(part.column("__text")), shared.once()), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score)], [*keep, out])

    return source.mapInArrow(tidy(run), schema)
