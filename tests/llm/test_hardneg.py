import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pairsmith.llm import hardneg
from pairsmith.llm.hardneg import Block, hard_negatives, products, survivors
from pairsmith.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, block string, k string, part string"


def brute(rows, step=100):
    """The contract by its words, over (vec_id, vector, label) of distinct ids."""
    whole = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in whole:
        if i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in whole if j != i and len(w) == len(v))
            positives = [(-s, j) for s, j, other in scored if other == label][:5]
            for p, j in positives:
                fit = [(-s, n) for s, n, other in scored if other != label and 80 * p <= 100 * -s <= 100 * p][:5]
                out += [(i, j, k, n, p, s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def found(frame, **options):
    return sorted(map(tuple, hard_negatives(frame, **options).collect()))


def test_documents_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    frame = QUERIES["op12_hardneg"](spark, "/root/testdata/sf0.01")
    expected = con.sql(ORACLE_SQL["op12_hardneg"])
    assert expected.columns == frame.columns
    assert sorted(map(tuple, frame.collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    """Vectors of two lengths, skewed spectra, ties, and one label with a third of the rows; blocks and tiles of any size."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        dim = 24 if i % 5 else 7
        v = rng.normal(size=dim) * np.exp(-np.arange(dim) / 4) + (i % 3 == 0) * 0.2
        rows.append((i, [round(float(x), 1 if i % 4 else 9) for x in v], 3 if i % 3 == 0 else int(rng.integers(0, 9))))
    if small:
        monkeypatch.setattr(hardneg, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(hardneg, "LANES", 3)
    frame = spark.createDataFrame([(*r, "b", "k", "p") for r in rows], SCHEMA)
    expected = brute(rows, 50)
    assert len(expected) > 100 and found(frame, anchor_step=50) == expected


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 2), (4, None, 1), (5, [1.0, None], 1), (6, [1.0, 0.5], None),
        (7, [math.nan, 1.0], 1), (8, [math.inf, 1.0], 1), (9, [], 1), (100, [], 1), (11, [], 2), (None, [1.0, 0.5], 2), (200, [-1.0, -0.5], 4), (12, [0.0, 0.0], 4),
        (13, [0.0, 0.0], 5), (300, [3e5, 1.0], 6), (14, [2.9e5, 1.0], 6), (15, [2.8e5, 1.0], 7),
    ]
    frame = spark.createDataFrame([(*r, "b", "k", "p") for r in rows], SCHEMA)
    assert found(frame) == brute(rows) != []
    assert found(frame.union(frame)) == brute(rows)
    assert hard_negatives(frame.limit(0)).count() == 0
    assert found(frame.where("label = 1")) == []


def test_large_components(spark):
    rows = [(0, [2.0**24, 1.5], 1), (1, [2.0**21, 1.25], 1), (2, [2.0**21 - 1 / 256, 7.0], 2), (3, [2.0**21 + 1 / 256, 9.0], 2)]
    frame = spark.createDataFrame([(*r, "b", "k", "p") for r in rows], SCHEMA)
    assert found(frame) == brute(rows) != []
    over = spark.createDataFrame([(100, [1e200], 1, "", "", ""), (1, [1e200], 1, "", "", "")], SCHEMA)
    with pytest.raises(Exception, match="does not fit"):
        hard_negatives(over).collect()


def test_no_pair_is_missed_and_most_are_discarded_early():
    rng = np.random.default_rng(5)
    whole = np.floor(256 * rng.normal(size=(800, 64)) * np.exp(-np.arange(64) / 8))
    turn = hardneg._rotation(whole)
    assert np.allclose(turn @ turn.T, np.eye(64))
    labels = np.arange(800) % 4
    a, b = Block(np.arange(50), labels[:50], whole[:50], turn), Block(np.arange(800), labels, whole, turn)
    scores = whole[:50] @ whole.T
    least, most = np.sort(scores, 1)[:, -9], np.sort(scores, 1)[:, -4]
    allowed = labels[:50, None] != labels[None, :]
    i, j = survivors(a, b, allowed, least, most)
    got = defaultdict(set)
    for x, y, s in zip(i, j, products(a, b, i, j), strict=True):
        assert s == scores[x, y] and allowed[x, y]
        got[x].add(y)
    for x in range(50):
        assert set(np.flatnonzero(allowed[x] & (scores[x] >= least[x]) & (scores[x] <= most[x]))) <= got[x]
    assert len(i) < 50 * 800 // 20
