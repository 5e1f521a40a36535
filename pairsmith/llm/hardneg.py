"""Hard-negative mining with an orthogonal PCA rotation.

Rows and anchors are packed into blocks of a bounded number of bytes, and every block of anchors meets every block of rows that may hold
its positives (rows of the same labels) or negatives. Vectors are rotated so that their leading components have most of their mass.
Partial products are added up a few components at a time; what is missing is at most the product of the norms of the remainders, and
rounding adds a slack that is bounded too. A pair that cannot reach what its anchor still wants goes; what is left is verified by integer products.
The rotation is a matter of speed alone: any orthogonal matrix gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, staged

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative has at least this many hundredths of its positive's score, and at most all of it.
LEAST_SHARE = 80
#: Bytes of the vectors of a block of rows or anchors.
BLOCK_BYTES = 4 << 20
#: Tasks that a block of anchors is sent to at most; each of them returns its own best rows.
LANES = 64
#: Rows are told apart by their labels in so many parts.
LABEL_PARTS = 64
#: Rows that the rotation is fitted on at most, twice that while they are drawn.
ROTATION_ROWS = 4_000
#: Rows of a block's first product of matrices, which is small as its anchors want every row as yet, and of the others at most; and anchors of each.
FIRST_ROWS, TILE_ROWS, TILE_ANCHORS = 64, 4096, 512
#: Components of a step, and the share of pairs below which those left are verified one by one.
STEP, FEW_LEFT = 16, 0.02
#: Pairs whose vectors are gathered at a time.
GATHER = 1 << 16
#: Whole numbers up to this are exact as doubles; and products of such size, times 100, as longs.
_SAFE, _LONG = float(1 << 53), 1 << 55
#: Beyond this largest component no bound is trusted.
_HUGE = 1e100


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, dim): labels noised where vec_id is divisible by 7, components floor(256 x); equal rows once."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE).alias("x"))
    finite = F.forall("x", lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    # A double of 2^53 or more is a whole number already, and may be too large for a long.
    whole = F.transform("x", lambda y: F.when(F.abs(y) < _SAFE, F.floor(F.when(F.abs(y) < _SAFE, y)).cast("double")).otherwise(y))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", label.alias("label"), whole.alias("v")).distinct().withColumn("dim", F.size("v"))


def _rotation(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the sample's principal directions, the leading one first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if sample.size else np.eye(sample.shape[1])


class Block:
    """Vectors with what the bounds need: rotated components and the norms of what remains after every step."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, rotation: np.ndarray) -> None:
        self.ids, self.labels, self.whole = ids, labels, whole
        self.largest = float(np.abs(whole).max(initial=0))
        self.bounded = self.largest < _HUGE
        self.norms = np.sqrt((whole**2).sum(1)) if self.bounded else None
        self.turned = whole @ rotation if self.bounded else None
        if self.bounded:
            square = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
            self.rest = [np.sqrt(square[:, k]) for k in range(STEP, whole.shape[1], STEP)] + [np.zeros(len(ids))]

    def part(self, rows: slice) -> Block:
        out = object.__new__(Block)
        out.ids, out.labels, out.whole, out.largest, out.bounded = self.ids[rows], self.labels[rows], self.whole[rows], self.largest, self.bounded
        if self.bounded:
            out.norms, out.turned, out.rest = self.norms[rows], self.turned[rows], [r[rows] for r in self.rest]
        return out


def products(anchors: Block, rows: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the pairs (i, j): longs, or Python's integers where they might not fit."""
    if anchors.largest * rows.largest * max(anchors.whole.shape[1], 1) < _LONG:
        a, b = anchors.whole.astype(np.int64), rows.whole.astype(np.int64)
        parts = [np.einsum("ij,ij->i", a[i[k : k + GATHER]], b[j[k : k + GATHER]]) for k in range(0, len(i), GATHER)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(anchors.whole[p], rows.whole[q], strict=True)) for p, q in zip(i, j, strict=True)] + [None], object)[:-1]


def survivors(anchors: Block, rows: Block, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that may score from ``least`` to ``most`` of their anchor, among the allowed ones; none that does is missed."""
    if not (anchors.bounded and rows.bounded):
        return np.nonzero(allowed)
    dim = anchors.whole.shape[1]
    # Rotating and adding up rounds by less than this share of the product of the norms.
    slack = (anchors.norms[:, None] * rows.norms[None, :] + 1) * (64 * (dim + 4) * np.finfo(float).eps)
    least, most = least[:, None], most[:, None]
    alive, partial = allowed.copy(), np.zeros(allowed.shape)
    for step, start in enumerate(range(0, dim, STEP)):
        if alive.mean() < FEW_LEFT:
            break
        partial += anchors.turned[:, start : start + STEP] @ rows.turned[:, start : start + STEP].T
        room = anchors.rest[step][:, None] * rows.rest[step][None, :] + slack
        alive &= (partial + room >= least) & (partial - room <= most)
    return np.nonzero(alive)


class Best:
    """The best few (score, id) of each anchor: highest scores first, ties by smaller id."""

    def __init__(self, anchors: int, k: int) -> None:
        self.k, self.least = k, np.full(anchors, -np.inf)
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        at, ids, scores = np.append(self.at, at), np.append(self.ids, ids), np.append(self.scores, scores)
        order = np.array(sorted(range(len(at)), key=lambda k: (at[k], -scores[k], ids[k])), np.int64) if scores.dtype == object else np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        # An id counts once for an anchor, with its best score.
        fresh = np.ones(len(at), bool)
        pair = np.lexsort((np.arange(len(at)), ids, at))
        fresh[pair[1:]] = (at[pair[1:]] != at[pair[:-1]]) | (ids[pair[1:]] != ids[pair[:-1]])
        at, ids, scores = at[fresh], ids[fresh], scores[fresh]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        full = rank == self.k - 1
        self.least[at[full]] = scores[full].astype(float)


def _reach(scores: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Those of ``least`` or more. Doubles order longs as they are, but for ties; they may be above a larger integer that they stand for."""
    return np.ones(len(scores), bool) if scores.dtype == object else scores >= least


def _fits(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and not all(-(1 << 63) <= s < 1 << 63 for s in scores):
        raise ValueError("a score does not fit in a long")
    return scores.astype(np.int64)


class Positives:
    """The best other rows of the anchors' own labels."""

    schema = "anchor_id long, dim int, k int, id long, score long"
    names = ("anchor_id", "dim", "k", "id", "score")

    def __init__(self, anchors: Block, bands: list[list[int]] | None) -> None:
        self.anchors, self.best = anchors, Best(len(anchors.ids), POSITIVES)

    def meet(self, rows: Block) -> None:
        for a in range(0, len(self.anchors.ids), TILE_ANCHORS):
            some = self.anchors.part(slice(a, a + TILE_ANCHORS))
            allowed = (some.labels[:, None] == rows.labels[None, :]) & (some.ids[:, None] != rows.ids[None, :])
            least = self.best.least[a : a + TILE_ANCHORS]
            i, j = survivors(some, rows, allowed, least, np.full(len(least), np.inf))
            scores = products(some, rows, i, j)
            keep = _reach(scores, least[i])
            self.best.add(a + i[keep], rows.ids[j[keep]], scores[keep])

    def found(self) -> tuple[np.ndarray, ...]:
        b = self.best
        return self.anchors.ids[b.at], np.zeros(len(b.at), np.int32), b.ids, _fits(b.scores)


class Negatives:
    """For each positive's rank the best rows of other labels in the band that its score allows."""

    schema = Positives.schema
    names = Positives.names

    def __init__(self, anchors: Block, bands: list[list[int]] | None) -> None:
        self.anchors = anchors
        self.bands = np.array([[b[k] if k < len(b) else -1 for k in range(POSITIVES)] for b in bands], object).reshape(len(bands), POSITIVES)
        self.best = [Best(len(anchors.ids), NEGATIVES) for _ in range(POSITIVES)]
        # Of a negative score nothing lies between its share and itself.
        self.open = np.array(self.bands >= 0, bool)
        self.high = np.where(self.open, self.bands.astype(float), -np.inf)
        self.low = np.where(self.open, self.high * LEAST_SHARE / 100, np.inf)

    def meet(self, rows: Block) -> None:
        for a in range(0, len(self.anchors.ids), TILE_ANCHORS):
            part = slice(a, a + TILE_ANCHORS)
            some, own = self.anchors.part(part), self.bands[part]
            allowed = (some.labels[:, None] != rows.labels[None, :]) & self.open[part].any(1)[:, None]
            wanted = np.column_stack([np.where(self.open[part, k], np.maximum(self.low[part, k], self.best[k].least[part]), np.inf) for k in range(POSITIVES)])
            # Doubles of large scores are rounded; the exact comparison follows.
            least, most = np.nan_to_num(wanted.min(1)), np.nan_to_num(self.high[part].max(1))
            i, j = survivors(some, rows, allowed, least - np.abs(least) * 1e-9, most + np.abs(most) * 1e-9)
            scores = products(some, rows, i, j)
            for k in range(POSITIVES):
                band = own[i, k] if scores.dtype == object else own[i, k].astype(np.int64)
                keep = np.array((scores * 100 >= band * LEAST_SHARE) & (scores <= band) & self.open[part][i, k] & _reach(scores, self.best[k].least[part][i]), bool)
                self.best[k].add(a + i[keep], rows.ids[j[keep]], scores[keep])

    def found(self) -> tuple[np.ndarray, ...]:
        each = [(self.anchors.ids[b.at], np.full(len(b.at), k + 1, np.int32), b.ids, _fits(b.scores)) for k, b in enumerate(self.best)]
        return tuple(np.concatenate(c) for c in zip(*each, strict=True))


def _pack(keys: list[str]):
    """Rows (keys, vec_id, label, v, bands) of a group to one row with their vectors as bytes, of whole numbers as small as will do."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        whole = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        largest = np.abs(whole).max(initial=0)
        kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
        out = {k: rows[k].slice(0, 1) for k in keys}
        lists = {"ids": rows["vec_id"], "labels": rows["label"]} | ({"bands": rows["bands"]} if "bands" in rows.column_names else {})
        out |= {name: pa.array([column.to_pylist()], pa.list_(column.type)) for name, column in lists.items()}
        if "bands" not in out:
            out["bands"] = pa.array([None], pa.list_(pa.list_(pa.int64())))
        return pa.table(out | {"kind": pa.array([kind]), "vectors": pa.array([whole.astype(kind).tobytes()], pa.binary())})

    return run


_BLOCK = "ids array<long>, labels array<long>, bands array<array<long>>, kind string, vectors binary"


def _block(batch: pa.RecordBatch, k: int, rotation: np.ndarray) -> Block:
    ids = batch["ids"][k].values.to_numpy()
    whole = np.frombuffer(batch["vectors"][k].as_py(), batch["kind"][k].as_py()).astype(np.float64).reshape(len(ids), -1)
    return Block(ids, batch["labels"][k].values.to_numpy(), whole, rotation)


def _meet(task: type, rotations: dict[int, np.ndarray]):
    """Blocks in the order of (task's key, anchors before rows): for each key what ``task`` has found when all its rows have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, work = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if work is not None and len((columns := work.found())[0]):
                anchors, k, ids, scores = columns
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(np.full(len(ids), key[0]), pa.int32()), pa.array(k, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], task.names)

        for batch in batches:
            for k in range(batch.num_rows):
                now = tuple(batch[c][k].as_py() for c in ("dim", "part", "team", "lane"))
                block = _block(batch, k, rotations[now[0]])
                if not batch["rows"][k].as_py():
                    yield from done()
                    key, work = now, task(block, batch["bands"][k].as_py())
                elif key == now:
                    at, step = 0, FIRST_ROWS
                    while at < len(block.ids):
                        work.meet(block.part(slice(at, at + step)))
                        at, step = at + step, min(4 * step, TILE_ROWS)
        yield from done()

    return run


def _dealt(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` packed into blocks of a bounded expected size, ``name`` being the block's number among those of its keys; and the numbers of blocks."""
    size = F.floor(F.lit(BLOCK_BYTES) / (F.greatest("dim", F.lit(1)) * 2))
    counts = checkpoint(rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.greatest(F.first(size), F.lit(1))).cast("long").alias("blocks")))
    # There is a row for each length of vectors and part of the labels.
    dealt = rows.join(F.broadcast(counts), keys).withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))
    kinds = ", ".join(f"{k} {'int' if k == 'dim' else 'long'}" for k in [*keys, name])
    columns = [*keys, name, "vec_id", "label", "v", *(["bands"] if "bands" in rows.columns else [])]
    return dealt.select(*columns).groupBy(*keys, name).applyInArrow(_pack([*keys, name]), f"{kinds}, {_BLOCK}"), counts


def _matched(anchors: DataFrame, blocks: DataFrame, keys: list[str], task: type, rotations: dict[int, np.ndarray]) -> DataFrame:
    """What ``task`` finds for every block of anchors against all ``blocks`` of the same keys, in lanes of a bounded number of blocks."""
    teams, team_counts = _dealt(anchors, keys, "team")
    part = F.col("part") if "part" in keys else F.lit(0).cast("long").alias("part")
    content = ["ids", "labels", "bands", "kind", "vectors"]
    # A row for each length of vectors, part of the labels and lane, and for each of the first two: that is all that is broadcast.
    lanes = blocks.select(*keys, "lane").distinct()
    asked = teams.join(F.broadcast(lanes), keys).select("dim", part, "team", "lane", F.lit(False).alias("rows"), *content)
    given = blocks.join(F.broadcast(team_counts), keys).withColumn("team", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    given = given.select("dim", part, "team", "lane", F.lit(True).alias("rows"), *content)
    where = ["dim", "part", "team", "lane"]
    return asked.unionByName(given).repartition(*where).sortWithinPartitions(*where, "rows").mapInArrow(_meet(task, rotations), task.schema)


def hard_negatives(vectors: DataFrame, anchor_step: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose vec_id is divisible by ``anchor_step``. An anchor's positives are its 5 best other rows of the same label by integer inner product of
    the components floor(256 x), ties by smaller vec_id; for each of them the 5 best rows of other labels whose score is between 80% and 100% of the positive's.
    Where vec_id is divisible by 7, label first becomes (label + 1) % 10.

    Rows with a null vec_id, label or vector, or null or non-finite components, take no part; the empty vector scores 0. Components may have
    any size: scores are exact, and one returned that does not fit in a long is an error. Vectors are compared with those of their own length.
    Of equal rows one counts; where a vec_id has several labels or vectors of a length, the anchor is the least of them by label and components, each is a candidate, and of each anchor's
    candidates with one vec_id the best counts. Empty tables give no rows; other columns are ignored.
    """
    small_batches(vectors)
    rows = staged(quantised(vectors))
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    empty = rows.selectExpr("vec_id as anchor_id", "vec_id as positive_id", "0 as rank", "vec_id as negative_id", "vec_id as positive_score", "vec_id as negative_score")
    if not sizes:
        return empty
    rate = F.element_at(F.create_map(*(F.lit(x) for dim, n in sizes.items() for x in (dim, min(1.0, ROTATION_ROWS / n)))), F.col("dim"))
    drawn: dict[int, list] = {dim: [] for dim in sizes}
    for r in rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < rate * (1 << 30)).groupBy("dim").agg(F.slice(F.collect_list("v"), 1, 2 * ROTATION_ROWS).alias("v")).collect():
        drawn[r.dim] = r.v
    rotations = {dim: _rotation(sample if (sample := np.array(drawn[dim], np.float64).reshape(len(drawn[dim]), dim)).size and np.abs(sample).max() < _HUGE else np.zeros((0, dim))) for dim in sizes}
    parted = rows.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(LABEL_PARTS)))
    blocks = staged(_dealt(parted, ["dim", "part"], "block")[0])
    anchors = parted.where(F.col("vec_id") % anchor_step == 0).groupBy("vec_id", "dim").agg(F.min(F.struct("label", "v", "part")).alias("r")).select("vec_id", "dim", "r.*")
    anchors = checkpoint(anchors)
    met = _matched(anchors, blocks.withColumn("lane", F.pmod("block", F.lit(LANES))), ["dim", "part"], Positives, rotations)
    # An anchor has at most 5 rows from each lane.
    best = Window.partitionBy("anchor_id", "dim").orderBy(F.desc("score"), "id")
    positives = checkpoint(met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= POSITIVES))
    bands = positives.groupBy(F.col("anchor_id").alias("vec_id"), "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("bands"))
    every = blocks.withColumn("lane", F.pmod(F.xxhash64("part", "block"), F.lit(LANES)))
    found = _matched(anchors.drop("part").join(bands, ["vec_id", "dim"]), every, ["dim"], Negatives, rotations)
    pairs = found.select("anchor_id", "dim", "k", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select("anchor_id", "dim", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    last = Window.partitionBy("anchor_id", "dim", "k").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.join(named, ["anchor_id", "dim", "k"]).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
