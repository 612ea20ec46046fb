"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features, those of the lines beside it and the
label of the line before. Forward-backward gives each line's probability of being good; the
length-weighted mean and spread of these make the document's quality, which a logistic
calibration turns into a score.

Labels are known for documents, not lines, so a training document's lines all bear its label; the
field learns on a bounded sample: at most TRAIN_DOCS labelled documents outside the held-out fold, of at
most TRAIN_BYTES bytes each, chosen by a hash of the id. Scores use the text alone.

Nulls: a null text is one empty line; a null id is never held out or trained on. A label row without
label or id is ignored, and the largest of an id's labels holds. Without training documents of both labels every
score is the share of good ones (0.5 with none). Repeated rows get equal scores. Empty table: no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 6_000
TRAIN_BYTES = 200_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
STEPS = 200
# Training sequences are cut here, scored ones never.
TRAIN_LINES = 64

# Classes of bytes: upper, lower or non-ASCII, digit, white, sentence signs, shouts, symbols, other.
_CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b" \t\r\n\x0b\x0c")] = 3
_CLASS[list(b".,;:'\"-()")] = 4
_CLASS[list(b"!?")] = 5
_CLASS[list(b"#*$%&|<>{}[]=_^~\\/@+")] = 6
_OWN = _CLASSES + 8


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes of each line, lines of each text). Features are shares, or logarithms of counts."""
    counts = np.empty(len(texts), np.int64)
    sizes: list[int] = []
    rest: list[tuple[float, ...]] = []
    for i, text in enumerate(texts):
        lines = text.split(b"\n")
        counts[i] = len(lines)
        seen: set[bytes] = set()
        for line in lines:
            words = line.split()
            n = len(words)
            sizes.append(len(line))
            rest.append(
                (
                    n,
                    len(set(words)),
                    sum(map(eq, words, words[1:])),
                    line in seen and n > 0,
                    sum(map(bytes.isupper, words)),
                    len(words[0]) if n else 0,
                )
            )
            seen.add(line)
    size = np.array(sizes, np.float64)
    table = np.array(rest, np.float64).reshape(-1, 6)
    whole = b"\n".join(texts)
    # Every line's bytes and its line end, the last one's missing.
    line_of = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64) + 1)[: len(whole)]
    kinds = _CLASS[np.frombuffer(whole, np.uint8)]
    kind = np.bincount(line_of * _CLASSES + kinds, minlength=len(sizes) * _CLASSES).reshape(-1, _CLASSES)
    out = np.empty((len(sizes), _OWN))
    out[:, :_CLASSES] = kind / np.maximum(size + 1, 1)[:, None]
    n, different, doubled, seen_before, shouted, first = table.T
    some = np.maximum(n, 1)
    out[:, _CLASSES + 0] = np.log1p(n) / 5
    out[:, _CLASSES + 1] = 1 - different / some
    out[:, _CLASSES + 2] = doubled / some
    out[:, _CLASSES + 3] = seen_before
    out[:, _CLASSES + 4] = shouted / some
    out[:, _CLASSES + 5] = size / some / 10
    out[:, _CLASSES + 6] = n == 0
    out[:, _CLASSES + 7] = n <= 3
    return out, size, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of a line, of the one before and of the one behind in the same text, and a constant."""
    ends = np.cumsum(counts)
    first = np.zeros(len(own), bool)
    last = np.zeros(len(own), bool)
    first[ends - counts] = True
    last[ends - 1] = True
    before = np.vstack([np.zeros((1, own.shape[1])), own[:-1]])
    behind = np.vstack([own[1:], np.zeros((1, own.shape[1]))])
    before[first] = 0
    behind[last] = 0
    return np.hstack([own, before, behind, first[:, None], last[:, None], np.ones((len(own), 1))])


@dataclass
class Field:
    """Weights for a line's score of being bad (label 1), and of each label after each."""

    weights: np.ndarray
    steps: np.ndarray
    calibration: np.ndarray

    def marginals(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of each line to be good."""
        return forward_backward(with_neighbours(own, counts) @ self.weights, self.steps, counts)


def forward_backward(scores: np.ndarray, steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of label 0 for each line. Both messages are kept as log-odds of label 1."""
    (a, b), (c, d) = steps.tolist()
    ea, eb, ec, ed = (math.exp(x) for x in (a, b, c, d))

    def onward(odds: float, from_good: tuple[float, float], from_bad: tuple[float, float]) -> float:
        r = math.exp(max(-50.0, min(50.0, odds)))
        return math.log((from_good[1] + r * from_bad[1]) / (from_good[0] + r * from_bad[0]))

    out = np.empty(len(scores))
    begin = 0
    for n in counts.tolist():
        own = scores[begin : begin + n].tolist()
        ahead = [0.0] * n
        odds = 0.0
        for i in range(n):
            ahead[i] = odds = own[i] + (onward(odds, (ea, eb), (ec, ed)) if i else 0.0)
        odds = 0.0
        for i in range(n - 1, -1, -1):
            out[begin + i] = ahead[i] + odds
            odds = onward(odds + own[i], (ea, ec), (eb, ed))
        begin += n
    return 1 / (1 + np.exp(np.clip(out, -50, 50)))


def document_features(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean and smallest probability of good lines, and the amount of text."""
    begins = np.cumsum(counts) - counts
    weight = size + 1
    total = np.add.reduceat(weight, begins)
    mean = np.add.reduceat(good * weight, begins) / total
    least = np.minimum.reduceat(np.where(size > 0, good, 1.0), begins)
    logit = np.log((mean + 1e-3) / (1 - mean + 1e-3))
    return np.stack([logit, mean, least, np.log1p(total) / 10, np.ones(len(counts))], axis=1)


def _adam(weights: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m = np.zeros_like(weights)
    v = np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = gradient(weights)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights


def train_field(own: np.ndarray, counts: np.ndarray, bad: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of lines and steps by the gradient of the conditional likelihood; `bad` per text."""
    x = with_neighbours(own, counts)
    begins = np.cumsum(counts) - counts
    pieces = [
        (b + at, min(TRAIN_LINES, n - at), y)
        for b, n, y in zip(begins.tolist(), counts.tolist(), bad.tolist())
        for at in range(0, n, TRAIN_LINES)
    ]
    pieces.sort(key=lambda p: -p[1])
    start, size, label = (np.array(c) for c in zip(*pieces))
    longest = int(size[0])
    alive = [int((size > t).sum()) for t in range(longest)]
    dims = x.shape[1]

    def gradient(theta: np.ndarray) -> np.ndarray:
        w, trans = theta[:dims], theta[dims:].reshape(2, 2)
        score = x @ w
        node = [np.stack([np.zeros(k), score[start[:k] + t]], axis=1) for t, k in enumerate(alive)]
        ahead = [node[0]]
        for t in range(1, longest):
            k = alive[t]
            ahead.append(np.logaddexp.reduce(ahead[-1][:k, :, None] + trans, axis=1) + node[t])
        back = [np.zeros((k, 2)) for k in alive]
        for t in range(longest - 2, -1, -1):
            k = alive[t + 1]
            back[t][:k] = np.logaddexp.reduce(trans + (node[t + 1] + back[t + 1])[:, None, :], axis=2)
        both = np.logaddexp.reduce(ahead[0] + back[0], axis=1)
        error = np.zeros(len(x))
        moved = np.zeros((2, 2))
        for t, k in enumerate(alive):
            p = np.exp(ahead[t][:, 1] + back[t][:, 1] - both[:k])
            error[start[:k] + t] = p - label[:k]
            if t:
                pair = ahead[t - 1][:k, :, None] + trans + (node[t] + back[t])[:, None, :]
                moved += np.exp(pair - both[:k, None, None]).sum(axis=0)
                n_bad = label[:k].sum()
                moved[1, 1] -= n_bad
                moved[0, 0] -= k - n_bad
        n = len(x)
        return np.concatenate([x.T @ error / n, moved.ravel() / n]) + 1e-4 * theta

    return _adam(np.zeros(dims + 4), gradient, steps, 0.1)


def train(texts: list[bytes], good: np.ndarray) -> Field:
    """Field and calibration from texts and their labels (1 good, 0 bad)."""
    dims = 3 * _OWN + 3
    if len(texts) == 0 or good.min() == good.max():
        share = (good.sum() + 1) / (len(texts) + 2)
        constant = np.array([0, 0, 0, 0, math.log(share / (1 - share))])
        return Field(np.zeros(dims), np.zeros((2, 2)), constant)
    own, size, counts = line_features(texts)
    theta = train_field(own, counts, 1 - good)
    field = Field(theta[:dims], theta[dims:].reshape(2, 2), np.zeros(5))
    x = document_features(field.marginals(own, counts), size, counts)

    def gradient(c: np.ndarray) -> np.ndarray:
        return x.T @ (1 / (1 + np.exp(-x @ c)) - good) / len(x) + 1e-4 * c

    field.calibration = _adam(np.zeros(5), gradient, 3 * STEPS, 0.1)
    return field


def score_texts(field: Field, texts: list[bytes]) -> np.ndarray:
    own, size, counts = line_features(texts)
    x = document_features(field.marginals(own, counts), size, counts)
    return 1 / (1 + np.exp(-np.clip(x @ field.calibration, -50, 50)))


def in_fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[list[bytes], np.ndarray]:
    """At most `limit` labelled texts outside the held-out fold, and their labels. Ids are chosen by
    hash from the labels first, so only the chosen texts move."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("quality").alias("quality"))
    )
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # `limit` rows of an id and a label; a repeated id contributes one of its texts.
    sample = (
        texts.join(F.broadcast(chosen), "id")
        .where(F.octet_length("text") <= TRAIN_BYTES)
        .groupBy("id", "quality")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    sample.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id))
    return [r.text.encode() for r in sample], np.array([float(r.quality > 0) for r in sample])


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """Every row of `docs` as `row` (all its columns), with `score` (0 to 1, higher is better)."""
    field = train(*training_sample(docs, labels, limit))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            scores = np.empty(len(row))
            for at in range(0, len(row), 64):
                texts = pa.compute.fill_null(pa.compute.struct_field(row.slice(at, 64), [place]), "")
                scores[at : at + 64] = score_texts(sent.value, [t.encode() for t in texts.to_pylist()])
            yield pa.record_batch([row, pa.array(scores)], ["row", "score"])

    place = docs.columns.index("text")
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double")
