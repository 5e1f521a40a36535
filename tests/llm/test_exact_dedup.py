import hashlib
from collections import defaultdict

from pairsmith.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, keep_id string, h string, n long"


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(d)
    out = []
    for text, ids in groups.items():
        keep, seen = max(ids, key=lambda d: (d is not None, d or 0)), False
        for d in ids:
            out.append((d, keep, len(ids), d == keep and not seen, hashlib.sha256(text.encode()).hexdigest()))
            seen |= d == keep
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(ed.exact_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_recursion_and_odd_rows(spark):
    long = "Long Text " * 50_000
    rows = [(k, f"Text {k % 7}") for k in range(50)] + [(100, None), (101, ""), (102, "ÄB"), (103, "äB"), (104, "Äb"), (None, "text 1"), (None, None), (105, long), (106, long.upper()), (106, long), (107, "x\x00y")]
    rows += [(None, "only null"), (None, "ONLY null")]
    frame = spark.createDataFrame([(d, t, "a", "b", 1) for d, t in rows], SCHEMA)
    for size, fanout in ((300, 2), (300, 64), (1 << 20, 64)):
        assert found(ed.exact_dedup(frame, size, fanout)) == brute(rows)
    kept = ed.drop_copies(frame, 300)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in brute(rows) if x[3])
    assert ed.exact_dedup(frame.limit(0)).count() == 0 == ed.drop_copies(frame.limit(0)).count()


def test_table_compares_contents():
    table = ed.OpenTable(2)
    for k in range(100):
        table.add(7, b"%d" % (k % 10), k)
    assert len(table.contents) == 10 and table.counts == [10] * 10 and table.ids == list(range(90, 100))


def test_other_columns_may_have_any_name(spark):
    rows = [(1, "a", "x", "s", 1, True), (2, "A", "y", "s", 2, False), (2, "b", "z", "s", 3, True), (2, "b", "z", "s", 3, True), (None, "c", None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string, _h string, _d int, _u boolean")
    kept = ed.drop_copies(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id or 0, r.text, r._row) for r in kept.collect()) == [(0, "c", None), (2, "A", "y"), (2, "b", "z")]
