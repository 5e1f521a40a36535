import math
import random

import numpy as np
import pytest

from pairsmith.llm.topk import Tree, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k=5, step=50, exact=False):
    good = {(i, tuple(math.floor(256 * (x if exact else float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in good if i % step == 0}):
        for dim in {len(v) for i, v in good if i == q}:
            x = min(v for i, v in good if i == q and len(v) == dim)
            best = {}
            for i, v in good:
                if i != q and len(v) == dim:
                    best[i] = max(best.get(i, -(1 << 200)), sum(a * b for a, b in zip(x, v, strict=True)))
            out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k], 1)]
    return sorted(out)


def test_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert sorted(map(tuple, top_k(vectors, tree_rows=128, query_rows=4).collect())) == brute([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_odd_rows_and_ties(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for k in range(400)]
    rows += [(50, rows[50][1]), (500, None), (550, [1.0, None, 0.0, 0.0]), (600, [float("nan"), 0.0, 0.0, 0.0]), (650, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0]), (700, [1.0, 2.0]), (750, []), *[(10_000 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(300)]]
    frame = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, top_k(frame, tree_rows=64, query_rows=3).collect())) == brute(rows)
    assert top_k(frame.limit(0)).count() == 0
    assert sorted(map(tuple, top_k(frame.where("vec_id = 700")).collect())) == []


def test_tree_prunes():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (64, 8))
    vectors = (centres[rng.integers(0, 64, 20_000)] + rng.integers(-9, 9, (20_000, 8))).astype(np.int64)
    tree = Tree(np.arange(20_000), vectors)
    seen, real = [0], tree.vectors

    class Counting:
        def __getitem__(self, own):
            seen[0] += len(own)
            return real[own]

    tree.vectors = Counting()
    query = vectors[0]
    want = sorted(((int(s), -i) for i, s in enumerate(real @ query) if i), reverse=True)[:5]
    assert tree.search(0, query, 5) == [(s, -i) for s, i in want]
    assert seen[0] < 5_000


def test_large_components_take_part(spark):
    rows = [(k, [1e9 * (k % 7 - 3), float(k), 0.5]) for k in range(120)] + [(200, [3e37, 0.0, 0.0]), (201, [-1e-38, -0.0, -1e-3])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit in a long"):
        top_k(frame, tree_rows=32).collect()
    fitting = [(i, [x / 300, y, z]) for i, (x, y, z) in rows if i != 200]
    frame = spark.createDataFrame(fitting, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(frame, tree_rows=32).collect())) == brute(fitting, exact=True)


def test_queries_go_to_few_trees(spark, monkeypatch):
    """Clustered vectors: the pairs of queries and trees grow with the queries, not with queries times trees."""
    from pairsmith.llm import topk

    rng = np.random.default_rng(4)
    centres, asked = rng.normal(0, 4, (24, 6)), []
    hits = topk._hits
    monkeypatch.setattr(topk, "_hits", lambda a, *more: (asked.append(a.count()), hits(a, *more))[1])
    rows = [(k, (centres[k % 24] / np.linalg.norm(centres[k % 24]) + rng.normal(0, 0.01, 6)).tolist()) for k in range(4800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = top_k(frame, query_step=10, tree_rows=50)
    assert sorted(map(tuple, out.collect())) == brute(rows, step=10, exact=True)
    # 480 queries, about 96 trees.
    assert asked[0] == 480 and sum(asked) < 480 * 96 / 3
