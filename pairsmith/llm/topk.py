"""Exact top-k search by best-first descent of an M-tree.

Scores are integer inner products, which are no metric; a vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M no less than any
norm, and a query gets 0 there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors are those with the largest scores. The
tree's upper level are pages: rows go to the nearest of some pivots, and a page has its pivot, covering radius and trees of
a bounded number of rows. A query first descends a tree of the page that promises most; its k-th score there rules out
every page whose covering radius promises less, and only to the others is it sent. Inside of a tree a node is entered in the order of the best
score that its covering radius allows; a child's distance is not computed where the stored distance to its parent already rules it out.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, staged

K, SCALE, QUERY_STEP = 5, 256, 50
LEAF, TREE_ROWS, QUERY_ROWS = 256, 16_384, 4096
#: Pages of one length of vectors, at most: a page of more rows has several trees.
PAGES = 2048
#: Whole numbers up to this are exact as doubles.
_SAFE = float(1 << 53)


def _inner(vectors: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of whole numbers that are held as doubles; beyond what doubles are exact for, by Python's integers."""
    if largest * float(np.abs(query).max(initial=0)) * max(len(query), 1) < _SAFE:
        return vectors @ query
    whole = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(v, whole, strict=True)) for v in vectors] + [None], object)[:-1]


class Tree:
    """A bulk-loaded M-tree: arrays of nodes, each with a centre, covering radius and distance to its parent's centre."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        vectors = vectors.astype(np.float64)
        norms = (vectors**2).sum(1)
        self.bound, self.largest = float(norms.max()), float(np.abs(vectors).max(initial=0))
        self.ids, self.vectors = ids, vectors
        points = np.column_stack([vectors, np.sqrt(np.maximum(self.bound - norms, 0))])
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self._build(points, np.arange(len(ids)), None, leaf)

    def _build(self, points: np.ndarray, own: np.ndarray, parent: np.ndarray | None, leaf: int) -> int:
        node, mine = len(self.radii), points[own]
        centre = mine.mean(0)
        away = np.sqrt(((mine - centre) ** 2).sum(1))
        self.centres.append(centre)
        self.radii.append(float(away.max()))
        self.to_parent.append(0.0 if parent is None else float(np.sqrt(((centre - parent) ** 2).sum())))
        self.children.append([])
        self.rows.append(own)
        if len(own) <= leaf or away.max() == 0:
            return node
        # Pivots by farthest-first choice; each row goes to its nearest.
        pivots = [int(away.argmax())]
        nearest = np.sqrt(((mine - mine[pivots[0]]) ** 2).sum(1))
        side = np.zeros(len(own), int)
        for k in range(1, 8):
            if nearest.max() == 0:
                break
            pivots.append(int(nearest.argmax()))
            d = np.sqrt(((mine - mine[pivots[-1]]) ** 2).sum(1))
            side[d < nearest] = k
            nearest = np.minimum(nearest, d)
        self.rows[node] = own[:0]
        for k in range(len(pivots)):
            if (side == k).any():
                self.children[node].append(self._build(points, own[side == k], centre, leaf))
        return node

    def search(self, query_id: int | None, query: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of ``least`` or more, ties to the smaller id; rows with the query's own id take no part."""
        q = np.append(query.astype(np.float64), 0.0)
        length = float(q @ q)
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its least entry goes first
        root = float(np.sqrt(((q - self.centres[0]) ** 2).sum()))

        def wanted() -> float:
            return best[0][0] if len(best) == k else least

        queue = [(-most(length, self.bound, root - self.radii[0]), 0, root)]
        while queue:
            bound, node, distance = heapq.heappop(queue)
            if -bound < wanted():
                break
            for child in self.children[node]:
                # |d(q, parent) - d(parent, child)| is a lower bound of d(q, child), free of charge.
                if most(length, self.bound, abs(distance - self.to_parent[child]) - self.radii[child]) < wanted():
                    continue
                d = float(np.sqrt(((q - self.centres[child]) ** 2).sum()))
                reach = most(length, self.bound, d - self.radii[child])
                if reach >= wanted():
                    heapq.heappush(queue, (-reach, child, d))
            own = self.rows[node]
            if len(own):
                scores = _inner(self.vectors[own], query, self.largest)
                close = np.flatnonzero(scores >= wanted())
                for s, i in sorted(((int(scores[j]), -int(self.ids[own[j]])) for j in close), reverse=True):
                    if -i == query_id:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, i))
                    elif (s, i) > best[0]:
                        heapq.heapreplace(best, (s, i))
                    else:
                        break
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def most(length: float, bound: float, distance: float) -> float:
    """No vector at that distance or farther scores more, with |q|^2 and M^2; a little room covers rounding."""
    score = (length + bound - max(0.0, distance) ** 2) / 2
    return score + 1e-6 * (abs(score) + length + bound)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(SCALE * x) of every vector without null or non-finite components, once each; whole numbers as doubles."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE).alias("x"))
    finite = F.forall("x", lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    # A double of 2^53 or more is a whole number already, and may be too large for a long.
    whole = F.transform("x", lambda y: F.when(F.abs(y) < _SAFE, F.floor(F.when(F.abs(y) < _SAFE, y)).cast("double")).otherwise(y))
    return x.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("v")).distinct()


def _packed(column: pa.Array) -> list[bytes]:
    return [np.asarray(v, np.float64).tobytes() for v in column.to_pylist()]


def _lifted(vectors: np.ndarray, bound: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(bound - (vectors**2).sum(1), 0))])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(points, pivots), in blocks of a product; what rounding may take off is left to the bounds' room."""
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _paged(pivots: dict[int, tuple[float, np.ndarray]]):
    """Each row with its page, the nearest pivot of its length, the distance to it, and its vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch["dim"].to_pylist(), np.int64)
            page, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            raw = _packed(batch["v"])
            for dim in np.unique(sizes):
                bound, points = pivots[int(dim)]
                own = np.flatnonzero(sizes == dim)
                d = _distances(_lifted(_matrix([raw[k] for k in own], int(dim)), bound), points)
                page[own], away[own] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["dim"], pa.array(raw, pa.binary()), pa.array(page), pa.array(away)], ["vec_id", "dim", "v", "page", "away"])

    return run


def _promising(pages: dict[int, tuple[float, np.ndarray, np.ndarray]], home: bool):
    """Each query with the page that promises most, or with all that promise its k-th score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, least = batch["dim"].to_pylist(), batch["least"].to_pylist()
            row, page = [], []
            for k, (v, dim) in enumerate(zip(batch["v"].to_pylist(), sizes, strict=True)):
                bound, points, radii = pages[dim]
                q = np.append(np.frombuffer(v, np.float64), 0.0)
                length = float(q @ q)
                away = np.maximum(np.sqrt(((points - q) ** 2).sum(1)) * (1 - 1e-9) - radii * (1 + 1e-6), 0)
                score = (length + bound - away**2) / 2
                reach = np.where(radii < 0, -np.inf, score + 1e-6 * (np.abs(score) + length + bound))
                own = [int(reach.argmax())] if home else np.flatnonzero((reach >= (-np.inf if least[k] is None else least[k])) & (radii >= 0)).tolist()
                row += [k] * len(own)
                page += own
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(take) for c in ("vec_id", "dim", "v", "least")), pa.array(page, pa.int64())], ["vec_id", "dim", "v", "least", "page"])

    return run


def _matrix(rows: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), dim)


def _plant(pdf):
    """The tree of one part of a page."""
    import pandas as pd

    dim = int(pdf["dim"].iloc[0])
    pdf = pdf.sort_values(["vec_id", "v"])
    tree = Tree(pdf["vec_id"].to_numpy(np.int64), _matrix(list(pdf["v"]), dim))
    return pd.DataFrame({"dim": [dim], "page": [int(pdf["page"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "blob": [pickle.dumps(tree)]})


def _block(pdf):
    import pandas as pd

    pdf = pdf.sort_values("vec_id")
    least = [-np.inf if x != x or x is None else float(x) for x in pdf["least"]]
    return pd.DataFrame({**{c: [int(pdf[c].iloc[0])] for c in ("dim", "page", "part", "block")}, "ids": [list(pdf["vec_id"])], "least": [least], "vectors": [b"".join(pdf["v"])]})


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, ids, least = pickle.loads(batch["blob"][row].as_py()), batch["ids"][row].as_py(), batch["least"][row].as_py()
                queries = np.frombuffer(batch["vectors"][row].as_py(), np.float64).reshape(len(ids), batch["dim"][row].as_py())
                hits = [(q, i, s) for q, x, t in zip(ids, queries, least, strict=True) for s, i in tree.search(q, x, k, t)]
                if too_large := next(((q, i) for q, i, s in hits if not -(1 << 63) <= s < 1 << 63), None):
                    raise ValueError(f"the score of vectors {too_large[0]} and {too_large[1]} does not fit in a long")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*hits, strict=True) if hits else ([], [], []))], ["query_id", "vec_id", "score"])

    return run


def _hits(asked: DataFrame, forest: DataFrame, k: int, query_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of the queries (vec_id, dim, v, least, page, part) in their trees; queries go in blocks of a bounded number."""
    keys = ["dim", "page", "part"]
    asked = checkpoint(asked)
    counts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("long").alias("blocks"))
    dealt = asked.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    blocks = dealt.groupBy(*keys, "block").applyInPandas(_block, "dim int, page long, part long, block long, ids array<long>, least array<double>, vectors binary")
    pairs = blocks.join(forest.hint("shuffle_merge"), keys)
    tasks = max(1, min(asked.sparkSession.sparkContext.defaultParallelism * 64, counts.agg(F.sum("blocks")).first()[0] or 1))
    return pairs.repartition(int(tasks), *keys, "block").select("blob", "dim", "ids", "least", "vectors").mapInArrow(_search(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k best rows of ``vectors`` by integer inner product.

    Components become floor(256 x). Queries are the rows whose vec_id is divisible by ``query_step``, candidates all rows with another
    vec_id; ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components take no part, nor does a
    row without vec_id. Finite components may have any size: scores are exact, and one among the k best that does not fit in a long is an error.
    Vectors are compared with those of their own length. Of repeated rows one counts; where a vec_id has different
    vectors of a length, each is a candidate, and the query is the least of them, component by component. Empty tables give no rows; other
    columns are ignored.
    """
    rows = checkpoint(quantised(vectors).withColumn("dim", F.size("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = {r.dim: (r.n, r.m) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("m")).collect()}
    if not sizes:
        return rows.selectExpr("vec_id as query_id", "0 as rank", "vec_id", "vec_id as score")
    # Pivots: of each length the rows with the least hashes, as many as there are pages; a rate of all rows has twice as many.
    pages_of = {dim: min(PAGES, -(-n // tree_rows)) for dim, (n, _) in sizes.items()}
    rate = F.element_at(F.create_map(*(F.lit(x) for dim, (n, _) in sizes.items() for x in (dim, min(1.0, (2 * pages_of[dim] + 20) / n)))), F.col("dim"))
    hashed = rows.withColumn("o", F.xxhash64("vec_id", "v")).where(F.pmod("o", F.lit(1 << 30)) < F.ceil(rate * (1 << 30))).select("dim", "o", "v")
    chosen, pivots = sorted((r.dim, r.o, r.v) for r in hashed.collect()), {}
    for dim, (_, m) in sizes.items():
        own = [v for d, _, v in chosen if d == dim][: pages_of[dim]] or [[0.0] * dim]
        pivots[dim] = m * (1 + 1e-9), _lifted(np.array(own, np.float64).reshape(len(own), dim), m * (1 + 1e-9))
    paged = staged(rows.select("vec_id", "dim", "v").mapInArrow(_paged(pivots), "vec_id long, dim int, v binary, page long, away double"))
    filled = paged.groupBy("dim", "page").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    pages, parts = {}, {}
    for dim, (bound, points) in pivots.items():
        radii = np.full(len(points), -1.0)
        for r in filled:
            if r.dim == dim:
                radii[r.page], parts[f"{dim}:{r.page}"] = r.radius, -(-r.n // tree_rows)
        pages[dim] = bound, points, radii
    # Few pages have several trees: those of more rows than a tree takes.
    large = {name: n for name, n in parts.items() if n > 1}
    several = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in large.items() for x in pair)), F.concat_ws(":", "dim", "page")), F.lit(1)) if large else F.lit(1)
    planted = paged.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), several).cast("long"))
    forest = staged(planted.groupBy("dim", "page", "part").applyInPandas(_plant, "dim int, page long, part long, blob binary"))
    queries = rows.where(F.pmod("vec_id", F.lit(query_step)) == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    queries = queries.mapInArrow(_as_bytes, "vec_id long, dim int, v binary, least double")
    schema = "vec_id long, dim int, v binary, least double, page long"
    home = checkpoint(queries.mapInArrow(_promising(pages, True), schema).withColumn("part", F.pmod(F.xxhash64("vec_id"), several).cast("long")))
    first = checkpoint(_hits(home, forest, k, query_rows))
    # The k-th score of a query's first tree, if there are so many: what is below it is not asked for.
    least = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("vec_id", F.col("s").cast("double").alias("_s"))
    known = home.drop("least").withColumnsRenamed({"page": "_page", "part": "_part"}).join(least, "vec_id", "left").select("vec_id", "dim", "v", (F.col("_s") - F.abs(F.col("_s")) * 1e-9).alias("least"), "_page", "_part")
    others = known.select("vec_id", "dim", "v", "least").mapInArrow(_promising(pages, False), schema)
    others = others.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), several - F.lit(1).cast("long"))))
    others = others.join(home.select("vec_id", "dim", "page", "part"), ["vec_id", "dim", "page", "part"], "left_anti")
    hits = first.union(_hits(others, forest, k, query_rows))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # k hits of each tree at most meet here.
    return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["dim"], pa.array(_packed(batch["v"]), pa.binary()), pa.nulls(batch.num_rows, pa.float64())], ["vec_id", "dim", "v", "least"])
