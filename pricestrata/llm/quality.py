"""A quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear support vector machine.

A text's features are the distinct n-grams that it holds: of 1 to 4 characters, of one and two words; a word
that repeats the one before it is written as a mark there, whichever it is. Each is hashed to one of BUCKETS. A bounded sample of labelled rows gives every bucket the logarithm of the ratio of
its smoothed share among good texts to that among bad ones; an indicator is worth that much. A linear model of
hinge loss is then fitted by dual coordinate descent, and a logistic curve through scores of held-out folds
turns its margins into probabilities. Every whole text is scored, by as many sums as it has distinct n-grams.

Learning rows are those of labels whose quality is 0 or 1 and that `learns` admits, with their texts; of more
than SAMPLE rows those of the least hashes are taken. A row of labels for each copy of a document counts, and so
does each copy. Without rows of both kinds, every score is the share of good ones (0.5 without any).

A null text is an empty one: it has no n-grams, and the model's constant decides. Repeated rows get equal
scores, rows without an id are scored and never learnt from, and other columns are left alone. Texts of any
length are taken whole, in pieces that overlap. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the model is fitted on, at most.
SAMPLE = 8000
BUCKETS = 1 << 18
ORDERS = 4
#: Added to the counts of both kinds; the loss's weight; passes over the sample; folds for the curve.
SMOOTH, COST, PASSES, FOLDS, SEED = 1.0, 0.01, 12, 3, 7
#: The hash of the mark of a repeated word.
AGAIN = 1
#: Code points that are hashed at a time.
PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def _buckets(h: np.ndarray, salt: int) -> np.ndarray:
    mixed = (h ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _spaces(points: np.ndarray) -> np.ndarray:
    return (points == 32) | (points >= 9) & (points <= 13)


def features(text: str | None) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    if not text:
        return np.zeros(0, np.int64)
    found = np.zeros(BUCKETS, bool)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points), PIECE):
        part = points[at : at + PIECE + ORDERS - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, ORDERS + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint64(_ODD) + part[n - 1 :]
            found[_buckets(h, n)] = True
    space = _spaces(points)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        words = np.zeros(len(starts), np.uint64)
        # A word's hash is a difference of running sums of points times powers, brought back to power 0.
        power, back = np.uint64(_ODD), np.uint64(_BACK)
        for first, last in _word_pieces(starts, ends):
            own = points[starts[first] : ends[last - 1]].astype(np.uint64)
            raised = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(own), power))), dtype=np.uint64)
            lowered = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(own), back))), dtype=np.uint64)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * raised[:-1], dtype=np.uint64)))
            a, b = starts[first:last] - starts[first], ends[first:last] - starts[first]
            words[first:last] = (total[b] - total[a]) * lowered[a]
        words[1:] = np.where(words[1:] == words[:-1], np.uint64(AGAIN), words[1:])
        found[_buckets(words, ORDERS + 1)] = True
        found[_buckets(words[:-1] * np.uint64(_ODD) + words[1:], ORDERS + 2)] = True
    return np.flatnonzero(found)


def _word_pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole words of about PIECE code points each."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE)))
        yield first, last
        first = last


class Model(NamedTuple):
    """Weights by bucket, a constant, and the curve from margins to probabilities."""

    weights: np.ndarray
    constant: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        m = self.slope * (float(self.weights[found].sum()) + self.constant) + self.shift
        return float(1 / (1 + np.exp(-np.clip(m, -500, 500))))


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """The logarithm, by bucket, of its smoothed share among good rows to that among others."""
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, good) if g == kind] or [np.zeros(0, np.int64)]), minlength=BUCKETS) + SMOOTH for kind in (True, False)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def descent(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(weights, constant) of least hinge loss: each row's dual value in turn takes its best place between 0 and cost.

    A kind of row weighs as much as the other, however many it has.
    """
    r = np.random.default_rng(seed)
    values = [ratio[x] for x in rows]
    square = np.array([v @ v + 1.0 for v in values])
    sign = np.where(good, 1.0, -1.0)
    share = np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))
    alpha, w, b = np.zeros(len(rows)), np.zeros(BUCKETS), 0.0
    for _ in range(passes):
        for i in r.permutation(len(rows)):
            x, v, y = rows[i], values[i], sign[i]
            now = min(max(alpha[i] - (y * (w[x] @ v + b) - 1) / square[i], 0.0), cost * share[i])
            if now != alpha[i]:
                step = (now - alpha[i]) * y
                w[x] += step * v
                b += step
                alpha[i] = now
    return w * ratio, b


def curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of greatest likelihood, both targets drawn in by a pseudo-count; by Newton steps."""
    up, down = good.sum(), (~good).sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 0.0, float(np.log((up + 1) / (down + 1)))
    x = np.column_stack((margins, np.ones(len(margins))))
    loss = lambda t: float(np.sum(np.logaddexp(0, x @ t) - target * (x @ t)))
    at = np.array([a, b])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        gradient = x.T @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-10 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(at[0], 0.0)), float(at[1])


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """The model of rows of buckets, good or not."""
    if not good.any() or good.all():
        p = (good.sum() + 1) / (len(good) + 2) if len(good) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(p / (1 - p))))
    margins, held = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for fold in range(FOLDS):
        inner = np.arange(len(rows)) % FOLDS != fold
        if good[inner].any() and not good[inner].all():
            own = [x for x, i in zip(rows, inner) if i]
            w, b = descent(own, good[inner], ratios(own, good[inner]))
            margins[~inner] = [w[x].sum() + b for x, i in zip(rows, inner) if not i]
            held |= ~inner
    slope, shift = curve(margins[held], good[held]) if held.any() and good[held].any() and not good[held].all() else (1.0, 0.0)
    return Model(*descent(rows, good, ratios(rows, good)), slope or 1.0, shift)


def learnt(docs: DataFrame, labels: DataFrame, learns: Column, sample: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text) by labels (doc_id, quality); learns admits rows by doc_id.

    Only ids and labels of the sample are sent to where texts are: sample rows, whatever the tables' sizes.
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("__good")).where(F.col("doc_id").isNotNull() & F.col("__good").isin(0, 1) & learns)
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = rows.orderBy(order, "doc_id", "__good").limit(sample)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = features(b.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), pa.array([found.astype("<i4").tobytes()], pa.binary())], names=["doc_id", "good", "found"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        found = [np.frombuffer(v.as_py(), "<i4") for b in got for v in b.column(1)]
        model = fit(found, np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in got] or [np.zeros(0)]) == 1)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([v], pa.float64()) for v in model[1:])], names=["weights", "constant", "slope", "shift"])

    kind = dict(own.dtypes)["doc_id"]
    # Copies of an id may be many more than its labels: they are cut to the bound, too. The bounded sample is fitted in one task.
    got = own.mapInArrow(read, f"doc_id {kind}, good int, found binary").orderBy(order, "doc_id", "good", "found").limit(sample)
    model = got.select("good", "found").mapInArrow(made, "weights binary, constant double, slope double, shift double").toArrow()
    if not model.num_rows:
        return fit([], np.zeros(0, bool))
    return Model(np.frombuffer(model.column("weights")[0].as_py(), np.float64), *(model.column(c)[0].as_py() for c in ("constant", "slope", "shift")))


def scored(docs: DataFrame, model: Model, is_held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    kind = dict(docs.dtypes)["doc_id"]
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    constants = tuple(model[1:])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights.value, *constants)
        for b in batches:
            scores = [own.score(features(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    own = docs.select("doc_id", F.coalesce(is_held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(read, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): held out are rows whose crc32(doc_id as text) leaves 1 on division by 3."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return scored(docs, learnt(docs, labels, rest != 1, sample), rest == 1)
