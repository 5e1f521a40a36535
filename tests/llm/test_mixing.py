import re
from collections import Counter, defaultdict

from pairsmith.llm.mixing import mix, take_mix

SCHEMA = "doc_id long, source string, text string, copies string, p string"


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Share by weight, cap, and share the excess again among the others until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        over = {s: most * sizes[s] for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {**share, **capped}
        capped |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def verify(rows, out):
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += words(t)
    want = targets(dict(sizes))
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((d, s, words(t)) for d, s, t in rows)
    taken, largest = Counter(), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate - 1e-9) <= r.copies <= rate + 1
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    # Up to the last residual, words stay at their targets.
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    out = mix(docs).collect()
    verify(rows, out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix(docs).collect()))
    copies = Counter((r.doc_id) for r in out for _ in range(r.copies))
    assert Counter(r.doc_id for r in take_mix(docs).collect()) == copies


def test_odd_rows(spark):
    rows = [(k, "hot", "w " * (k % 50)) for k in range(300)] + [(None, None, "a b c"), (1, None, None), (2, "", "x"), (2, "", "x"), (3, "Z", ""), (4, "é", "one two"), (5, "z", "long " * 30_000), *[(9, "same", "five words in this row")] * 100]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    verify(rows, mix(frame).collect())
    taken = take_mix(frame)
    assert taken.columns == frame.columns
    assert sum(words(r.text) for r in taken.collect()) == sum(r.taken for r in mix(frame).collect())
    assert mix(frame.limit(0)).count() == 0 == take_mix(frame.limit(0)).count()


def test_expectations(spark):
    frame = spark.createDataFrame([(k, "a" if k % 2 else "b", "word " * (5 + k % 11)) for k in range(60)], "doc_id long, source string, text string")
    got = Counter()
    for seed in range(12):
        got.update({r.doc_id: r.copies for r in mix(frame, seed=1000 * seed).collect()})
    rate = {r.doc_id: r.target / r.source_size for r in mix(frame).collect()}
    low = [got[k] / 12 for k in rate if rate[k] < 0.9]
    assert abs(sum(low) / len(low) - min(rate.values())) < 0.1
    assert len(set(low)) > 1


def test_other_columns_may_have_any_name(spark):
    from pairsmith.llm.mixing import take_mix

    rows = [(k, "some words here " * (1 + k % 3), "s", 10 + k, 5, "c", 1.0) for k in range(12)]
    rows += [(None, "no id", "s", 1, 1, "c", 1.0)] * 3 + [(None, None, None, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _words int, _copies int, _row string, _i double")
    out = take_mix(frame)
    assert out.columns == frame.columns
    got = out.collect()
    # One source with words: everything is taken once, the rows without a source and words not at all.
    assert sorted((str(r.doc_id), r._words, r._copies) for r in got) == sorted((str(r[0]), r[3], r[4]) for r in rows if r[2])


def test_rows_are_numbered_in_parts(spark):
    from pairsmith.llm.common import numbered_copies, numbered_rows

    frame = spark.createDataFrame([(k, None if k % 3 else "a") for k in range(300)], "v long, key string").repartition(6)
    numbered = numbered_rows(frame, ["key"], "no").collect()
    for key, n in (("a", 100), (None, 200)):
        assert sorted(r.no for r in numbered if r.key == key) == list(range(1, n + 1))
    many = spark.createDataFrame([("x", 25_001), ("y", 1)], "k string, n long")
    assert {tuple(r) for r in numbered_copies(many).groupBy("k").agg({"i": "max"}).collect()} == {("x", 25_001), ("y", 1)}
