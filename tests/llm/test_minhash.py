import math
import random
from collections import Counter, defaultdict

import numpy as np

from pairsmith.llm import tokens
from pairsmith.llm.minhash import drop_near_copies, near_classes

SCHEMA = "doc_id long, text string, node string, class_id string"


def cells_of(words):
    """The cell of each run of five words: the first 20 bits of its hash."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    offsets = np.array([0, len(data)])
    starts, ends, rows = tokens.words(data, offsets)
    return [int(h) >> 44 for h in tokens.shingles(tokens.word_hashes(data, starts, ends), rows, 1)[1]]


def brute_classes(rows, threshold=0.8):
    """Components by comparing every pair that shares a shingle, from plain definitions."""
    sets, cell = {}, {}
    for doc_id, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
        sets[doc_id] = Counter(grams)
        cell.update(zip(grams, cells_of(words), strict=True))
    n = len(rows)
    df = Counter(cell[g] for s in sets.values() for g in s)
    typical = float(np.median([math.log(n / min(c, n)) for c in df.values()])) if df else 0
    idf = {g: round(min(1, 0.5 + 0.5 * math.log(n / min(df[c], n)) / typical) * 8) / 8 if typical else 1.0 for g, c in cell.items()}
    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = set()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                common = sum(min(c, sets[b][g]) * idf[g] for g, c in sets[a].items() if g in sets[b])
                total = sum(c * idf[g] for s in (sets[a], sets[b]) for g, c in s.items()) - common
                if common >= threshold * total:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: find(d) for d in sets}


def test_same_as_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    assert got == want


def test_planted_near_copies(spark):
    rng = random.Random(3)
    rows, group = [], {}
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in range(3):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(200)] = "zzz"
            rows.append((3 * g + k, " ".join(words)))
            group[3 * g + k] = 3 * g
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_classes(docs).collect()} == group


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "  \n", "a", "b"), (4, "one two", "a", "b"), (5, "ONE  two", "a", "b"), (None, "one two", "a", "b"), (6, long, "a", "b"), (7, long, "a", "b"), (7, long, "a", "b"), (8, "one two three", None, None)]
    out = near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.class_id)
    assert by[4] == by[5] == by[None] and by[6] == by[7] == {6} and len({*by[1], *by[2], *by[3], *by[8], *by[4]}) == 5
    assert near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_with_similarities_near_the_threshold(spark, monkeypatch):
    from pairsmith.llm import minhash

    monkeypatch.setattr(minhash, "PAGE", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 1 and got == want


def test_one_row_of_each_class_stays(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    near = a.replace("a49", "other")
    docs = spark.createDataFrame([(3, a, "x", "x"), (7, a, "x", "x"), (7, b, "x", "x"), (None, a, "x", "x"), (None, a, "x", "x")], "doc_id long, text string, _row string, _h string")
    assert sorted((r.doc_id, r.text) for r in drop_near_copies(docs).collect()) == [(3, a), (7, b)]
    unnamed = spark.createDataFrame([(None, near, "x"), (None, a, "y"), (None, a, "y"), (5, b, "z"), (5, b, "z"), (6, None, "n"), (6, None, "n"), (None, " ", "n")], "doc_id long, text string, _d string")
    kept = drop_near_copies(unnamed)
    assert kept.columns == ["doc_id", "text", "_d"]
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == 5 and rows.count((5, b)) == 1 and rows.count((6, None)) == 2 and rows.count((None, " ")) == 1 and sum(t in (a, near) for _, t in rows) == 1
    assert drop_near_copies(docs.limit(0)).count() == 0
