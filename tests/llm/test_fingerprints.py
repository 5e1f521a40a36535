import hashlib
import re
from base64 import b64encode

import duckdb
import pytest
from pyspark.sql import functions as F

from pairsmith.llm.fingerprints import BLANK, PIECE, codes, fingerprint_edits, likeness, locate_edits, with_fingerprint, with_tree
from pairsmith.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, n_chars string, fingerprint string, _block string, edited string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups(items, ends):
    out, run = [], []
    for k, x in enumerate(items):
        run.append(x)
        if ends(x) or k + 1 == len(items):
            out.append(run)
            run = []
    return out


def brute_print(text):
    pieces = [m.group() for m in re.finditer(PIECE, text)]
    assert "".join(pieces) == text
    leaves = [(sha("0" + p), p) for p in pieces]
    paragraphs = [(sha("1" + "".join(d for d, _ in run)), bool(re.search(BLANK, run[-1][1]))) for run in groups(leaves, lambda x: "\n" in x[1])]
    sections = [sha("2" + "".join(d for d, _ in run)) for run in groups(paragraphs, lambda x: x[1] or x[0][-1] in "08")]
    own = [d[:6] for d, _ in leaves]
    return sha("3" + "".join(sections)) + ":" + b64encode(bytes.fromhex("".join(own))).decode(), set(own)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    texts, out = [t or "" for _, t in order], []
    prints = {t: brute_print(t) for t in texts}

    def near(a, b):
        (fa, ca), (fb, cb) = a, b
        return 1.0 if fa == fb else 2.0 * len(ca & cb) / max(len(ca) + len(cb), 1)

    for k, (doc, _) in enumerate(order):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, new = prints[text], brute_print(edited)
        out.append((doc, len(text), sha(edited), own[0], new[0], near(own, new), near(own, prints[after])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [256, 7])
def test_documents_against_brute_force(spark, block_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, fingerprint_edits(docs, block_rows).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    # The edit leaves two thirds of a text, which is about what two fingerprints share; other texts share little.
    edited = sorted(r[5] for r in got if r[1] > 500)
    assert edited[len(edited) // 10] > 0.5 and sorted(r[6] for r in got)[len(got) // 2] < 0.1


def test_odd_rows(spark):
    rows = [(9, "one two. three\n\n\nfour\n"), (9, "a"), (9, "a"), (None, "null id"), (None, None), (5, ""), (4, None), (3, "é🙂 ü\r\nx " * 3), (2, "w" * 100_000), (1, "…,,,!\t\t"), (0, " \n \n")]
    frame = spark.createDataFrame([(d, t, "l", "n", "f", "b", "e") for d, t in rows], SCHEMA)
    for block_rows in (1, 3, 256):
        assert sorted(map(tuple, fingerprint_edits(frame, block_rows).collect()), key=repr) == brute(rows)
    for some in ([(None, "x y z w v"), (None, "b")], [(7, "alone in the world")], [(7, None)]):
        assert sorted(map(tuple, fingerprint_edits(spark.createDataFrame(some, "doc_id long, text string"), 1).collect()), key=repr) == brute(some)
    assert fingerprint_edits(frame.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    frame, found = QUERIES["op11_fingerprints"](spark, "/root/testdata/sf0.01"), con.sql(ORACLE_SQL["op11_fingerprints"])
    assert found.columns == frame.columns
    assert sorted(map(tuple, frame.collect())) == sorted(found.fetchall())


def test_tree_and_edits(spark):
    old = "Title here.\nFirst line of text, with some words in it.\n\nSecond section starts here; it goes on.\nLast line\n"
    new = old.replace("some words", "other words").replace("Last line", "Last lines of all")
    pairs = spark.createDataFrame([(1, old, new), (2, old, old), (3, None, "added"), (4, None, "")], "k int, a string, b string")
    tree = with_tree(pairs, "a", "t").where("k = 1").first().t
    assert sum(s.chars for s in tree.sections) == len(old) == sum(x.chars for x in tree.leaves)
    assert [x.digest for s in tree.sections for p in s.paragraphs for x in p.pieces] == [x.digest for x in tree.leaves]
    got = {(r.k, r.side): [] for r in locate_edits(pairs, "k", "a", "b").collect()}
    for r in locate_edits(pairs, "k", "a", "b").collect():
        text = old if r.side == "old" else {1: new, 3: "added"}[r.k]
        got[r.k, r.side].append((r.start, text[r.start : r.start + r.chars]))
    assert {k: sorted(v) for k, v in got.items()} == {
        (1, "old"): [(old.index("with"), "with some words in "), (old.index("Last"), "Last line\n")],
        (1, "new"): [(new.index("with"), "with other words in "), (new.index("Last"), "Last lines of all\n")],
        (3, "new"): [(0, "added")],
    }


def test_fingerprints_tell_texts_apart(spark):
    texts = ["a b c d e f", "a b c d e g", "a b c d  e f", "a b c d\ne f", "a b c d e f ", ""]
    frame = with_fingerprint(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "f")
    assert len({r.f for r in frame.collect()}) == len(texts)
    both = frame.where("t <> ''").crossJoin(frame.where("t = 'a b c d e f'").select(F.col("f").alias("g"))).select("t", likeness("f", "g", codes("f"), codes("g")).alias("n"))
    assert {r.t: r.n for r in both.collect()} == {"a b c d e f": 1.0, "a b c d e g": 0.5, "a b c d  e f": 0.5, "a b c d\ne f": 0.5, "a b c d e f ": 0.5}
