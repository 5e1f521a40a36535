"""Language-model scoring with a log-bilinear neural model.

Every word with ``LEAST`` occurrences or more in the training texts, up to ``VOCABULARY`` of them, and the end of a text have vectors of their own; a
rarer word has those of its shape. The predicted vector is the sum of those of the two words before, each through a matrix of its position, and
a word's score is the product with its own vector, plus a bias. Normalising goes in two steps, over the classes of words and over the words of
the class, so that it is exact and costs little: both are batched matrix products. Both steps are trained by noise-contrastive estimation: classes, and
words of the token's class, are drawn by their training frequencies as noise. Each pass reads all training texts: every task goes on from the
parameters of the pass before with its own texts, and their results are averaged, weighted by their tokens. A rare word's share of its shape is by its
smoothed count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import checkpoint, small_batches

WIDTH, VOCABULARY, LEAST = 32, 1 << 13, 5
#: The most frequent words are classes by themselves; the others share classes of a number that keeps both steps small.
ALONE, GROUP = 64, 128
SHAPES = 18
#: Neural ids: shapes, then the end, then words by their frequency.
END_ID = SHAPES
NOISE, PASSES, BATCH, RATE = 24, 1, 1 << 15, 0.05
#: Tokens scored at a time.
BLOCK = 8192
SMOOTH = 0.1
#: Words with the highest counts, up to this many, are looked up in memory; the others by a join.
HEAD = 1 << 19
CHUNK_TOKENS = 6_000_000
END = np.uint64(0x454E44)
#: Parameters travel in pieces of this many numbers.
PIECE = 1 << 16


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A shape by how a word ends, whether it is plain ASCII, and its length."""
    final = data[ends - 1] if len(ends) else data[:0]
    ending = np.where(final == ord("."), 1, np.where((final == ord(",")) | (final == ord("!")) | (final == ord("?")), 2, 0))
    wide = np.append(0, np.cumsum(data >= 128))
    other = (wide[ends] > wide[starts]).astype(np.int64)
    return ending * 6 + other * 3 + np.searchsorted([5, 9], ends - starts, "right")


def _stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, row) of all tokens of a slice, each row's end token after its words."""
    n = len(offsets) - 1
    starts, ends, rows = tokens.words(data, offsets)
    hashes, shapes = tokens.word_hashes(data, starts, ends), _shapes(data, starts, ends)
    at = np.cumsum(np.bincount(rows, minlength=n)) if n else np.zeros(0, np.int64)
    return np.insert(hashes, at, END), np.insert(shapes, at, END_ID), np.insert(rows, at, np.arange(n))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words among the training texts (c) and among all (a)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        hashes, shapes, learned = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes)
        hashes, shapes, learned = hashes[order], shapes[order], learned[order]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(shapes[at].astype(np.int32)), pa.array(np.add.reduceat(learned.astype(np.int64), at)), pa.array(np.diff(np.append(at, len(hashes))))], ["h", "shape", "c", "a"])

    for batch in batches:
        out = np.array(batch["held_out"].to_pylist(), bool)
        for first, after, data, offsets in tokens.slices(batch["text"]):
            hashes, shapes, rows = _stream(data, offsets)
            held.append((hashes, shapes.astype(np.int16), ~out[first:after][rows]))
            size += len(hashes)
            if size >= CHUNK_TOKENS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _find(sorted_keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of each hash among sorted keys; looked up in order, which keeps to the cache."""
    order = np.argsort(hashes)
    place = np.empty(len(hashes), np.int64)
    place[order] = np.minimum(np.searchsorted(sorted_keys, hashes[order]), max(len(sorted_keys) - 1, 0))
    return place, sorted_keys[place] == hashes if len(sorted_keys) else np.zeros(len(hashes), bool)


def _before(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids two places and one place before each token; before a text stand ends."""
    two, one = np.full(len(ids), END_ID), np.full(len(ids), END_ID)
    one[1:] = np.where(rows[1:] == rows[:-1], ids[:-1], END_ID)
    two[2:] = np.where(rows[2:] == rows[:-2], ids[:-2], END_ID)
    return two, one


def _in_order(ids: np.ndarray) -> np.ndarray:
    """Places of neural ids in their order, equal ones as they come; few bits are sorted by counting."""
    return np.argsort(ids.astype(np.uint16) if VOCABULARY + END_ID < 1 << 16 else ids, kind="stable")


def class_starts(n: int) -> np.ndarray:
    """Where each class of neural ids begins, and n: classes of one id, then of GROUP ids."""
    alone = min(n, SHAPES + 1 + ALONE)
    return np.unique(np.concatenate([np.arange(alone), np.arange(alone, n, GROUP), [n]]))


class LogBilinear:
    """Vectors of the words before, a matrix for each of their two positions, and vectors and biases of classes and of words."""

    NAMES = ("context", "position", "klass", "klass_bias", "word", "word_bias")

    def __init__(self, counts: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n = len(counts)
        self.starts = class_starts(n)
        sizes = np.diff(self.starts)
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        smooth = counts + SMOOTH
        total = np.add.reduceat(smooth, self.starts[:-1])
        #: The noise: frequencies of classes, and of words in theirs.
        self.class_noise = (total / total.sum()).astype(np.float32)
        self.word_noise = (smooth / total[self.of]).astype(np.float32)
        self.context = rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        self.position = np.stack([np.eye(WIDTH), np.eye(WIDTH)]).astype(np.float32)
        self.klass, self.klass_bias = rng.normal(0, 0.1, (len(sizes), WIDTH)).astype(np.float32), np.log(self.class_noise)
        self.word, self.word_bias = rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32), np.log(self.word_noise)

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def unpack(self, numbers: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, numbers[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def vectors(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        """The predicted vector after each pair of words."""
        return np.take(self.context, two, 0) @ self.position[0] + np.take(self.context, one, 0) @ self.position[1]

    def _members(self, target: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first id, id after the last, the tokens) of each class of several words that occurs among the targets."""
        own = self.of[target]
        order = _in_order(own)
        sizes = np.diff(self.starts)
        edges = np.searchsorted(own[order], np.arange(len(sizes) + 1))
        for c in np.flatnonzero((np.diff(edges) > 0) & (sizes > 1)):
            yield int(self.starts[c]), int(self.starts[c + 1]), order[edges[c] : edges[c + 1]]

    def log10(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the targets: classes block by block, then words class by class."""
        out, q = np.empty(len(target)), np.empty((len(target), WIDTH), np.float32)
        # Each word's part of the predicted vector, made once.
        far, near = (self.context @ p for p in self.position)
        for first in range(0, len(target), BLOCK):
            part = slice(first, first + BLOCK)
            q[part] = np.take(far, two[part], 0) + np.take(near, one[part], 0)
            out[part] = _picked(q[part] @ self.klass.T + self.klass_bias, self.of[target[part]])
        for low, high, every in self._members(target):
            for first in range(0, len(every), BLOCK):
                mine = every[first : first + BLOCK]
                out[mine] += _picked(np.take(q, mine, 0) @ self.word[low:high].T + self.word_bias[low:high], target[mine] - low)
        return out / np.log(10)

    def draw(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Noise for all tokens of a step: classes, and for each class words of it."""
        classes = np.minimum(np.searchsorted(np.cumsum(self.class_noise, dtype=np.float64), rng.random(NOISE)), len(self.class_noise) - 1)
        edges = np.append(0.0, np.cumsum(self.word_noise, dtype=np.float64))
        low, high = edges[self.starts[:-1]], edges[self.starts[1:]]
        words = np.searchsorted(edges, low[:, None] + rng.random((len(low), NOISE)) * (high - low)[:, None], "right") - 1
        return classes, np.clip(words, self.starts[:-1, None], self.starts[1:, None] - 1)

    def gradients(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, noise: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """Of the noise-contrastive loss, the mean over the tokens: classes are told from noise classes, words from noise words of their class."""
        order = _in_order(target)
        two, one, target, n = two[order], one[order], target[order], np.float32(len(target))
        q = self.vectors(two, one)
        own, (classes, words) = self.of[target], noise
        # Targets are in order, and so are their classes: sums over equal ones are sums over runs.
        runs, class_runs = (np.flatnonzero(np.append(True, x[1:] != x[:-1])) for x in (target, own))
        k = np.take(self.klass, own, 0)
        g = _told(np.einsum("ij,ij->i", q, k) + self.klass_bias[own], self.class_noise[own], True) / n
        g_q = g[:, None] * k
        g_class, g_class_bias = np.zeros_like(self.klass), np.zeros_like(self.klass_bias)
        g_class[own[class_runs]], g_class_bias[own[class_runs]] = np.add.reduceat(g[:, None] * q, class_runs), np.add.reduceat(g, class_runs)
        g = _told(q @ self.klass[classes].T + self.klass_bias[classes], self.class_noise[classes], False) / n
        g_q += g @ self.klass[classes]
        np.add.at(g_class, classes, g.T @ q)
        np.add.at(g_class_bias, classes, g.sum(0))
        # A class of one word tells no words apart.
        several = (np.diff(self.starts) > 1)[own]
        w = np.take(self.word, target, 0)
        g = np.where(several, _told(np.einsum("ij,ij->i", q, w) + self.word_bias[target], self.word_noise[target], True) / n, np.float32(0))
        g_q += g[:, None] * w
        g_word, g_word_bias = np.zeros_like(self.word), np.zeros_like(self.word_bias)
        g_word[target[runs]], g_word_bias[target[runs]] = np.add.reduceat(g[:, None] * q, runs), np.add.reduceat(g, runs)
        for first, after in zip(class_runs, np.append(class_runs[1:], len(own)), strict=True):
            if several[first]:
                drawn, part = words[own[first]], slice(first, after)
                g = _told(q[part] @ self.word[drawn].T + self.word_bias[drawn], self.word_noise[drawn], False) / n
                g_q[part] += g @ self.word[drawn]
                np.add.at(g_word, drawn, g.T @ q[part])
                np.add.at(g_word_bias, drawn, g.sum(0))
        g_context, g_position = np.zeros_like(self.context), []
        for ids, matrix in ((two, self.position[0]), (one, self.position[1])):
            by = _in_order(ids)
            own_ids = ids[by]
            at = np.flatnonzero(np.append(True, own_ids[1:] != own_ids[:-1]))
            once, sums = own_ids[at], np.add.reduceat(np.take(g_q, by, 0), at)
            g_context[once] += sums @ matrix.T
            # A word's sum is all that its own vector needs to be multiplied by.
            g_position.append(self.context[once].T @ sums)
        return {"context": g_context, "position": np.stack(g_position), "klass": g_class, "klass_bias": g_class_bias, "word": g_word, "word_bias": g_word_bias}

    def loss(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, noise: tuple[np.ndarray, np.ndarray]) -> float:
        """What ``gradients`` is the gradient of, token by token."""
        out = 0.0
        for q, t in zip(self.vectors(two, one).astype(np.float64), target, strict=True):
            c = self.of[t]
            score = lambda v, b, p: float(q @ v + b - np.log(NOISE * p))  # noqa: B023, E731
            out += np.logaddexp(0, -score(self.klass[c], self.klass_bias[c], self.class_noise[c]))
            out += sum(np.logaddexp(0, score(self.klass[j], self.klass_bias[j], self.class_noise[j])) for j in noise[0])
            if self.starts[c + 1] - self.starts[c] > 1:
                out += np.logaddexp(0, -score(self.word[t], self.word_bias[t], self.word_noise[t]))
                out += sum(np.logaddexp(0, score(self.word[j], self.word_bias[j], self.word_noise[j])) for j in noise[1][c])
        return out / len(target)


def _picked(scores: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The natural logarithm of the targets' shares; the scores are used up."""
    if scores.max(initial=0) > 60:
        scores -= scores.max(1, keepdims=True)
    taken = scores[np.arange(len(target)), target]
    return taken - np.log(np.exp(scores, out=scores).sum(1))


def _told(scores: np.ndarray, noise: np.ndarray, real: bool) -> np.ndarray:
    """The loss's derivative by the scores of what is real, or of noise: how far it is from being told for sure."""
    chance = 1 / (1 + np.exp(np.clip(np.log(np.float32(NOISE) * noise) - scores, -60, 60)))
    return chance - 1 if real else chance


class Adam:
    """Steps whose length follows the gradients' first and second moments."""

    def __init__(self, model: LogBilinear, rate: float) -> None:
        self.model, self.rate, self.count = model, rate, 0
        self.moments = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in model.NAMES}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.count += 1
        for k, g in gradients.items():
            m, v = self.moments[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            mean, spread = m / np.float32(1 - 0.9**self.count), np.sqrt(v / np.float32(1 - 0.99**self.count))
            setattr(self.model, k, getattr(self.model, k) - np.float32(self.rate) * mean / (spread + np.float32(1e-6)))


@dataclass
class Words:
    """The words looked up in memory: hashes (sorted), training counts and neural ids."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    def look_up(self, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(neural id, place, whether there) of each token."""
        place, there = _find(self.hashes, hashes)
        ids = shapes.copy()
        ids[there] = self.ids[place[there]]
        return ids, place, there


def _local_training(model: LogBilinear, words: Words, rate: float):
    """The parameters after one partition's texts, times its tokens, in pieces; the last piece is the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        optimiser, rng, seen, held, size = Adam(model, rate), np.random.default_rng(23), 0, [], 0

        def learn() -> int:
            two, one, target = (np.concatenate(x) for x in zip(*held, strict=True))
            steps = min(len(target), max(8, round(len(target) / BATCH)))
            # Every step gets tokens from all over what is held.
            for k in range(steps):
                optimiser.step(model.gradients(two[k::steps], one[k::steps], target[k::steps], model.draw(rng)))
            return len(target)

        for batch in batches:
            for _, _, data, offsets in tokens.slices(batch["text"]):
                hashes, shapes, rows = _stream(data, offsets)
                ids = words.look_up(hashes, shapes)[0]
                held.append((*_before(ids, rows), ids))
                size += len(ids)
                if size >= 16 * BATCH:
                    seen += learn()
                    held, size = [], 0
        if size:
            seen += learn()
        if seen:
            numbers = model.packed().astype(np.float64) * seen
            pieces = [numbers[k : k + PIECE].tobytes() for k in range(0, len(numbers), PIECE)] + [np.array([float(seen)]).tobytes()]
            for k, piece in enumerate(pieces):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece], pa.binary())], ["piece", "numbers"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces that came to one task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, numbers in zip(batch["piece"].to_pylist(), batch["numbers"].to_pylist(), strict=True):
            sums[piece] = sums.get(piece, 0.0) + np.frombuffer(numbers, np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "numbers"])


def train_passes(model: LogBilinear, texts: DataFrame, words: Words, passes: int = PASSES) -> None:
    """``passes`` times over all texts; what comes to the driver is one set of parameters, of a bounded size."""
    count = len(model.packed())
    pieces = -(-count // PIECE) + 1
    for k in range(passes):
        sent = texts.mapInArrow(tokens.slim(_local_training(model, words, RATE / 2**k)), "piece int, numbers binary")
        found = sent.repartition(pieces, "piece").mapInArrow(_added, "piece int, numbers binary").toArrow()
        parts = dict(zip(found["piece"].to_pylist(), found["numbers"].to_pylist(), strict=True))
        if not parts:
            return
        numbers = np.concatenate([np.frombuffer(parts[j], np.float64) for j in range(pieces - 1)])
        model.unpack(numbers / np.frombuffer(parts[pieces - 1], np.float64)[0])


@dataclass
class Model:
    """What scoring needs of the corpus: totals, the words in memory, the neural model and the logarithm of each shape's total."""

    n: int
    v: int
    words: Words
    neural: LogBilinear
    shape_log: np.ndarray


def train(rows: DataFrame, passes: int = PASSES) -> tuple[Model, DataFrame]:
    """(model, counts of all words) from (held_out, text); words are told by (h, c, a), their counts in training texts and in all."""
    counts = checkpoint(rows.select("held_out", "text").mapInArrow(tokens.slim(_word_counts), "h long, shape int, c long, a long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"), F.sum("a").alias("a")))
    v, n = (int(x or 0) for x in counts.agg(F.count_if(F.col("c") > 0), F.sum("c")).first())
    end = int(END)
    # The head: whole steps of the logarithm of a word's count in all texts, from the top, as long as it stays below its bound. So no word that
    # is beyond it is frequent in any texts.
    step = F.floor(F.log2("a") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    least, size = None, 0
    for s, k in sizes:
        if size + k > HEAD:
            break
        least, size = s, size + k
    head = counts.where(step >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    hashes = head["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, ids, c = hashes[order], head["shape"].to_numpy()[order].astype(np.int64), head["c"].to_numpy()[order].astype(np.int64)
    # Words with vectors of their own, by frequency.
    known = np.flatnonzero((c >= LEAST) & (hashes != END))
    known = known[np.lexsort((hashes[known], -c[known]))][:VOCABULARY]
    ids[known] = END_ID + 1 + np.arange(len(known))
    ids[hashes == END] = END_ID
    words = Words(hashes, c, ids)
    # Totals of the shapes, without the words that have vectors.
    totals = np.zeros((SHAPES, 2))
    for r in counts.where(F.col("h") != end).groupBy("shape").agg(F.sum("c"), F.count_if(F.col("c") > 0)).collect():
        totals[r[0]] = r[1], r[2]
    shapes = head["shape"].to_numpy()[order][known]
    np.subtract.at(totals, shapes, np.column_stack([c[known], np.ones(len(known))]))
    neural = LogBilinear(np.concatenate([totals[:, 0], c[hashes == END] if (hashes == END).any() else [0], c[known]]).astype(np.float64))
    if n:
        train_passes(neural, rows.where("not held_out").select("text"), words, passes)
    return Model(n, v, words, neural, np.log10(totals[:, 0] + SMOOTH * (totals[:, 1] + 1))), counts


def token_scores(model: Model, hashes: np.ndarray, shapes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probability but for the counts of words beyond the head, log10 of the smoothed count, whether in the head) of each token of a stream."""
    ids, place, there = model.words.look_up(hashes, shapes)
    log_count = np.zeros(len(hashes))
    log_count[there] = np.log10(model.words.counts[place[there]] + SMOOTH)
    # A word with a vector has all of what the model gives; one without has its smoothed count's share of its shape.
    shared = ids < SHAPES
    share = np.where(shared, log_count - model.shape_log[np.minimum(ids, SHAPES - 1)], 0.0)
    return model.neural.log10(*_before(ids, rows), ids) + share, log_count, there


def _partial_scores(model: Model):
    """Per row what the head gives, and the other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10(model.n + SMOOTH * (model.v + 1))
        for batch in batches:
            for first, after, data, offsets in tokens.slices(batch["text"]):
                n = after - first
                hashes, shapes, rows = _stream(data, offsets)
                scores, log_count, there = token_scores(model, hashes, shapes, rows)
                seen = there & (log_count > np.log10(SMOOTH) + 1e-9)
                score, count = np.bincount(rows, scores, minlength=n), np.bincount(rows, minlength=n)
                own, rest, times = tokens.counted(rows[~there], hashes[~there])
                cuts = np.searchsorted(own, np.arange(n + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))) for x in (rest, times)]
                columns = [batch[c][first:after] for c in ("uid", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(count.astype(np.int64)), pa.array(np.bincount(rows[seen], minlength=n).astype(np.int64)), pa.array(np.bincount(rows, log_count, minlength=n) - base * count), pa.array(score), *lists],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_head", "base", "score", "rest", "times"],
                )

    return run


def held_out(modulus: int = 10, remainder: int = 0) -> F.Column:
    """Rows by crc32 of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Tokens are runs of other characters than ASCII white space, A-Z in lower case, then one end; a null text counts as empty and
    has the end only. Counts are of all rows that are not held out, whole texts of any length, and so is what the model learns from. base_score is the sum of log10((c + 0.1) / (N + 0.1
    (V + 1))), score that of the model's log10 probabilities. Words go by 64-bit hashes. Repeated rows get equal results; an empty
    table gives no rows; other columns are ignored.
    """
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    model, counts = train(rows)
    partial = checkpoint(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_partial_scores(model), "uid long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, score double, rest array<long>, times array<long>"))
    rest = partial.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("h"), F.col("x.times").alias("k"))
    # Counts of words beyond the head, in all rows, are below the head's: no key here is frequent.
    joined = rest.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = joined.groupBy("uid").agg(F.sum(F.col("k") * F.log10(F.col("c") + SMOOTH)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"))
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return partial.join(sums, "uid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_head") + known).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
