"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) is the logistic function of threshold k minus the text's score, a sum of weights shared by all thresholds
over the text's features: which words and which beginnings of words occur in it, hashed to a fixed number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import small_batches

CELLS = 1 << 22
PREFIXES = (4, 5, 6)
#: Bound of the labelled sample, for each grade. Every feature gets a weight, under a ridge penalty, that at least LEAST of its rows have and whose rows'
#: mean grade is EVIDENCE standard errors or more from that of all: however many there are, and no others, which would be learned by heart.
SAMPLE, LEAST, EVIDENCE = 3000, 3, 3.0
RIDGE, STEPS = 1e-4, 300
#: One in so many rows of the sample is left out of a first fit and chooses the chance from which a text counts as toxic.
FOLD = 5
_JUNK = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, cells): sorted distinct feature cells of each row, one row after the other."""
    data = _JUNK[data]
    starts, ends, rows = tokens.words(data, offsets)
    # Words occur again and again: their cells are made for the distinct ones of each row.
    whole = tokens.word_hashes(data, starts, ends)
    parts = [whole]
    for k, length in enumerate(PREFIXES):
        longer = ends - starts >= length
        parts.append(tokens.mix64(tokens.word_hashes(data, starts[longer], starts[longer] + length) + np.uint64(k + 1)))
    own = np.concatenate([rows, *(rows[ends - starts >= length] for length in PREFIXES)])
    cells = np.concatenate(parts) >> np.uint64(64 - 22)
    keys = np.sort(own.astype(np.uint64) << np.uint64(22) | cells)
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(22)), (keys & np.uint64(CELLS - 1)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Grades in order, their thresholds, the weights of the known cells (sorted), and the chance of a grade above the least from which a text is toxic."""

    grades: list[int]
    thresholds: np.ndarray
    cells: np.ndarray
    weights: np.ndarray
    cut: float = 0.5

    def scores(self, starts: np.ndarray, cells: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(starts) - 1)
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        value = np.where(self.cells[at] == cells, self.weights[at], 0.0)
        sums = np.append(0, np.cumsum(value))
        return sums[starts[1:]] - sums[starts[:-1]]

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades)."""
        below = np.column_stack([np.zeros(len(score)), _sigmoid(self.thresholds - score[:, None]), np.ones(len(score))])
        return np.diff(below, axis=1)


def fit(rows: list[tuple[int, np.ndarray]], counts: dict[int, int] | None = None) -> Model:
    """Fit on (grade, cells) rows by accelerated gradient descent on the penalised likelihood.

    Grades weigh as often as ``counts`` says that they occur among all labelled rows, else as in ``rows``.
    """
    grades = sorted({g for g, _ in rows})
    if len(grades) < 2:
        return Model(grades, np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    y = np.array([grades.index(g) for g, _ in rows])
    lengths = np.array([len(c) for _, c in rows])
    known, index, count = np.unique(np.concatenate([c for _, c in rows]), return_inverse=True, return_counts=True)
    mean = (np.bincount(index, np.repeat(y, lengths)) + y.mean()) / (count + 1)
    kept = np.flatnonzero((count >= LEAST) & (np.abs(mean - y.mean()) * np.sqrt(count) > EVIDENCE * y.std()))
    place = np.full(len(known), -1)
    place[kept] = np.arange(len(kept))
    inside = place[index] >= 0
    column, row = place[index][inside], np.repeat(np.arange(len(rows)), lengths)[inside]
    often = np.array([counts[g] for g in grades], float) if counts else np.bincount(y).astype(float)
    balance = (often / often.sum() / np.bincount(y))[y]
    share = np.cumsum(np.bincount(y, balance))[:-1]
    theta, w = np.log(share / (1 - share)), np.zeros(len(kept))
    theta_0, w_0, momentum = theta.copy(), w.copy(), 1.0
    step = 1 / _curvature(column, row, balance, len(kept))
    for _ in range(STEPS):
        score = np.bincount(row, w[column], minlength=len(rows))
        high, low = np.append(theta, np.inf)[y] - score, np.append(-np.inf, theta)[y] - score
        up, down = _sigmoid(high), _sigmoid(low)
        p = np.maximum(up - down, 1e-12)
        d_high, d_low = up * (1 - up) / p * np.isfinite(high), down * (1 - down) / p * np.isfinite(low)
        g_score = balance * (d_high - d_low)
        g_w = np.bincount(column, g_score[row], minlength=len(kept)) + RIDGE * w
        g_theta = np.bincount(y, -balance * d_high, minlength=len(grades))[:-1] + np.bincount(y, balance * d_low, minlength=len(grades))[1:]
        new_w, new_theta = w - step * g_w, np.maximum.accumulate(theta - step * g_theta)
        m = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        w, theta = new_w + (momentum - 1) / m * (new_w - w_0), np.maximum.accumulate(new_theta + (momentum - 1) / m * (new_theta - theta_0))
        w_0, theta_0, momentum = new_w, new_theta, m
    return Model(grades, theta_0, known[kept], w_0)


def _curvature(column: np.ndarray, row: np.ndarray, balance: np.ndarray, n: int) -> float:
    """A bound of the likelihood's second derivative: half of the largest eigenvalue of the weighted features' square, thresholds with them."""
    x, size = np.ones(n + 1), 1.0
    for _ in range(15):
        along = np.bincount(row, x[column], minlength=len(balance)) + x[n]
        x = np.append(np.bincount(column, (balance * along)[row], minlength=n), balance @ along)
        size = float(np.linalg.norm(x))
        x /= max(size, 1e-12)
    return 0.5 * size + RIDGE


def best_cut(chance: np.ndarray, worse: np.ndarray, weight: np.ndarray) -> float:
    """The chance that parts rows of a worse grade from the others with the best F1; halfway between the two rows that it is between."""
    order = np.argsort(-chance, kind="stable")
    hit, all_ = np.cumsum((worse * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (worse * weight).sum())
    last = np.append(chance[order][1:] < chance[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((chance[order][k] + (chance[order][k + 1] if k + 1 < len(order) else 0)) / 2)


def fit_with_cut(rows: list[tuple[int, np.ndarray]], counts: dict[int, int]) -> Model:
    """``fit`` on all rows, with the cut that suits the rows that a fit on the others has not seen."""
    model = fit(rows, counts)
    out = [r for k, r in enumerate(rows) if k % FOLD == 0]
    part = fit([r for k, r in enumerate(rows) if k % FOLD], counts)
    grades = np.array([g for g, _ in out])
    if part.grades != model.grades or len(model.grades) < 2 or len(set(grades)) < 2:
        return model
    starts = np.append(0, np.cumsum([len(c) for _, c in out]))
    chance = 1 - part.probabilities(part.scores(starts, np.concatenate([c for _, c in out])))[:, 0]
    weight = np.array([counts[g] / (grades == g).sum() for g in grades])
    model.cut = best_cut(chance, grades > model.grades[0], weight)
    return model


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, after, data, offsets in tokens.slices(batch["text"]):
            starts, cells = features(data, offsets)
            packed = [cells[a:b].astype(np.int32).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["grade"][first:after], batch["o"][first:after], pa.array(packed, pa.binary())], ["grade", "o", "cells"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each grade; ``labels`` has doc_id and grade."""
    labels = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = {r[0]: r[1] for r in labels.groupBy("grade").count().collect()}
    if not counts:
        return fit([])
    rate = F.element_at(F.create_map(*(F.lit(x) for g, n in counts.items() for x in (g, min(1.0, 1.2 * sample / n + 20 / n)))), F.col("grade"))
    # The sample's bound is known, so its ids can be sent to all tasks; texts are not shuffled.
    chosen = labels.withColumn("o", F.xxhash64("doc_id")).where(F.pmod("o", F.lit(1_000_000)) < F.ceil(rate * 1_000_000)).select(F.col("doc_id").alias("_id"), "grade", "o")
    labelled = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # Of a document that occurs again and again one row comes.
    found = labelled.groupBy("grade", "o").agg(F.min("text").alias("text")).mapInArrow(_features_of, "grade int, o long, cells binary").toArrow()
    found = sorted(zip(*(found[c].to_pylist() for c in ("grade", "o", "cells")), strict=True))
    taken: dict[int, int] = {}
    rows = []
    for grade, _, cells in found:
        taken[grade] = taken.get(grade, 0) + 1
        if taken[grade] <= sample:
            rows.append((grade, np.frombuffer(cells, np.int32).astype(np.int64)))
    return fit_with_cut(rows, counts)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = np.array(model.grades or [0], np.int64)
        for batch in batches:
            for first, after, data, offsets in tokens.slices(batch["text"]):
                n = after - first
                chance = model.probabilities(model.scores(*features(data, offsets))) if len(grades) > 1 else np.ones((n, 1))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][first:after], pa.array(grades[chance.argmax(1)].astype(np.int32)), pa.array(chance @ grades.astype(float)), pa.array(1 - chance[:, 0] >= model.cut)], ["doc_id", "grade", "expected_severity", "toxic"])

    return run


def predict_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, grade, expected_severity, toxic`` for every row of ``docs``.

    ``labels`` has doc_id and an integer grade, whose levels are the severity grades in order; of several grades of a document the
    largest counts. grade is the likeliest one, expected_severity the mean grade, toxic whether a grade above the least has a chance that
    parts the labelled documents best which a first fit has not seen. Whole texts are read, of any length.
    A null or empty text has no features and gets the thresholds alone. Without labels, or with one grade only, every
    text has that grade (0 without any). Repeated rows get equal results; an empty table gives none; other columns are ignored.
    """
    small_batches(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(plain, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")), sample)
    return plain.mapInArrow(_predict(model), "doc_id long, grade int, expected_severity double, toxic boolean")
