"""Language identification by string kernels.

The blended-spectrum presence kernel counts the byte n-grams (1 to 4, hashed to a fixed number of cells) that two texts
share, over the geometric mean of how many each has. Landmark texts give Nystroem features, on which one-versus-rest
ridge regression is fitted. As the kernel is linear in a text's presence vector, the landmarks' presence matrix times
the fitted coefficients is formed once, and a batch is scored by the product of its presence matrix and that one.
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

CELLS = 1 << 15
LONGEST = 4
#: Rows of a slice: each has a flag for every cell.
ROWS = 256
#: The labelled sample that the classifier is fitted on, and the landmarks among it, are of about these sizes, spread evenly over all languages;
#: each language has LEAST rows and a landmark at least, however many languages there are.
SAMPLE, LANDMARKS, LEAST = 4000, 256, 10
RIDGE = 1e-3
UNKNOWN = "und"
#: A text that resembles no language has regression values near 0, a score of about 0.5. Of the 249 held-out documents
#: of sf0.01 three score below 0.55, all of less than 90 letters.
MIN_SCORE = 0.55
#: Bytes of letters as they are, every other byte as a space; text is lower-cased before.
_PLAIN = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def _lettered() -> F.Column:
    """Whether a text has a letter, in learning as in prediction."""
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def presence_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, cells) flags: which n-gram cells each row has."""
    n, size = len(offsets) - 1, len(data)
    flags = np.zeros(n * CELLS, bool)
    plain = _PLAIN[data]
    row = np.repeat(np.arange(n, dtype=np.int64) * CELLS, np.diff(offsets))
    # Bytes left to the end of the row: an n-gram does not cross it.
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(size)
    gram = np.zeros(size, np.uint32)
    for length in range(1, LONGEST + 1):
        gram = (gram[: size - length + 1] << np.uint32(8)) | plain[length - 1 :] if size >= length else gram[:0]
        cell = ((gram * np.uint32(2654435761) + np.uint32(0x9E3779B9 * length & 0xFFFFFFFF)) * np.uint32(2246822519)) >> np.uint32(32 - 15)
        inside = left[: len(gram)] >= length
        flags[(row[: len(gram)] + cell)[inside]] = True
    return flags.reshape(n, CELLS)


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, cells): the sorted distinct n-gram cells of each row, one row after the other."""
    at = np.flatnonzero(presence_matrix(data, offsets))
    return np.searchsorted(at, np.arange(len(offsets)) * CELLS), (at % CELLS).astype(np.int32)


@dataclass
class Model:
    """Languages, and for each the weight of every cell."""

    langs: list[str]
    weights: np.ndarray

    def scores(self, flags: np.ndarray) -> np.ndarray:
        """(rows, languages) regression values: presence matrix @ weights, over the root of each row's count of n-grams."""
        return flags.astype(np.float32) @ self.weights / np.sqrt(np.maximum(flags.sum(1), 1))[:, None]


def fit(rows: list[tuple[str, np.ndarray]]) -> Model:
    """Fit on (language, cells) rows, in their order."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((CELLS, 0), np.float32))
    by_lang = {g: [k for k, (lang, _) in enumerate(rows) if lang == g] for g in langs}
    share = max(1, LANDMARKS // len(langs))
    marks = [k for g in langs for k in by_lang[g][:share]]
    base = np.zeros((len(marks), CELLS), np.float32)
    for k, r in enumerate(marks):
        base[k, rows[r][1]] = 1 / np.sqrt(len(rows[r][1]))
    kernel = np.empty((len(rows), len(marks)), np.float32)
    for first in range(0, len(rows), 256):
        part = rows[first : first + 256]
        block = np.zeros((len(part), CELLS), np.float32)
        for k, (_, cells) in enumerate(part):
            block[k, cells] = 1 / np.sqrt(len(cells))
        kernel[first : first + 256] = block @ base.T
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # landmarks' kernel matrix to the power -1/2
    features = kernel @ root
    # Languages weigh the same, however many rows each has.
    index = np.array([langs.index(lang) for lang, _ in rows])
    balance = (len(rows) / len(langs) / np.bincount(index, minlength=len(langs)))[index]
    target = np.where(index[:, None] == np.arange(len(langs)), 1.0, -1.0)
    gram = (features * balance[:, None]).T @ features
    solved = np.linalg.solve(gram + RIDGE * len(rows) * np.eye(gram.shape[0]), (features * balance[:, None]).T @ target)
    return Model(langs, (base.T @ (root @ solved)).astype(np.float32))


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, after, data, offsets in tokens.slices(batch["text"], rows=ROWS):
            starts, cells = presence(data, offsets)
            packed = [cells[a:b].astype(np.uint16).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["lang"][first:after], batch["o"][first:after], pa.array(packed, pa.binary())], ["lang", "o", "cells"])


def train(docs: DataFrame, learn: F.Column, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` of the labelled rows that ``learn`` picks, spread evenly over their languages, at least ``LEAST`` of each, and all languages."""
    rows = docs.where(learn & F.col("lang").isNotNull() & _lettered())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    each = max(LEAST, sample // len(counts))
    # The rows with the least hashes of each language; the rate lets through a few more than are taken.
    rate = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * each / n + 20 / n)))), F.col("lang"))
    hashed = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("o")).where((F.pmod("o", F.lit(1_000_000)) < F.ceil(rate * 1_000_000)))
    # A row that occurs again and again has one hash and comes once.
    found = hashed.groupBy("lang", "o").agg(F.first("text").alias("text")).mapInArrow(tokens.slim(_cells_of), "lang string, o long, cells binary").toArrow()
    found = sorted(zip(*(found[c].to_pylist() for c in ("lang", "o", "cells")), strict=True))
    taken: dict[str, int] = {}
    rows_ = []
    for lang, _, cells in found:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= each and cells:
            rows_.append((lang, np.frombuffer(cells, np.uint16).astype(np.int32)))
    return fit(rows_)


def _predict(model: Model):
    """(lang_pred, score) from (text, lettered), other columns before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for c in batch.schema.names if c not in ("text", "lettered")]
            for first, after, data, offsets in tokens.slices(batch["text"], rows=ROWS):
                known = np.array(batch["lettered"][first:after].to_pylist(), bool) & bool(model.langs)
                best, score = np.zeros(after - first, int), np.zeros(after - first)
                if model.langs:
                    values = model.scores(presence_matrix(data, offsets))
                    best, score = values.argmax(1), np.clip((1 + values.max(1)) / 2, 0, 1)
                langs = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c][first:after] for c in others), pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], [*others, "lang_pred", "score"])

    return run


def held_out(modulus: int = 4, remainder: int = 2) -> F.Column:
    """Rows by crc32 of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def predict_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Learns from rows with a language that are not held out. The score is the best regression value, brought from [-1, 1] to [0, 1].
    A null text or one without a letter (Unicode's category L) is ``und`` with score 0, as is every text if there is nothing to learn from; an
    empty table gives no rows. Whole texts are read; only the text decides a prediction. Repeated rows get equal
    predictions; other columns are ignored.
    """
    small_batches(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(plain, ~held_out(), sample)
    rows = plain.select("doc_id", held_out().alias("held_out"), "text", _lettered().alias("lettered"))
    return rows.mapInArrow(tokens.slim(_predict(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text is in some language: not ``und``, and a score of ``min_score`` or more (below: no language fits).

    So a null or empty text goes, and every row if there is nothing to learn from. Whole texts are read, of any length. Repeated rows have the
    same fate, a null doc_id has none; an empty table stays empty. All columns stay, whatever their names.
    """
    small_batches(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(plain, ~held_out(), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch["row"]
            texts = pa.RecordBatch.from_arrays([batch["text"], batch["lettered"]], ["text", "lettered"])
            told = pa.Table.from_batches(_predict(model)(iter([texts])), pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]))
            good = np.array([g != UNKNOWN for g in told["lang_pred"].to_pylist()], bool) & (told["score"].to_numpy() >= min_score)
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(good, pa.bool_()))], ["row"])

    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), _lettered().alias("lettered"))
    schema = docs.select(F.struct(*docs.columns).alias("row")).schema
    return named.mapInArrow(tokens.slim(run), schema).select("row.*")
