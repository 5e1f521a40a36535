import re
from collections import Counter, defaultdict

import duckdb
import pytest

from pairsmith.llm.phrases import candidates, top_phrases
from pairsmith.llm.queries import ORACLE_SQL, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n string, l string, place string, chunk string"


def brute(rows, least, top=2000):
    """The contract by its words, over (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    phrases = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    covered = {(lang, g[i : i + k]) for (lang, g), a in phrases.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 80 * f[lang, g[i : i + k]]}
    ranked = defaultdict(list)
    for (lang, g), a in phrases.items():
        if (lang, g) not in covered:
            score, k = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            ranked[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in ranked.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize("chunk_words", [1 << 20, 700])
def test_documents_against_brute_force(spark, chunk_words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = sorted(map(tuple, top_phrases(docs, least=5, chunk_words=chunk_words).collect()))
    assert len(got) > 100 and got == brute(rows, 5)
    assert sorted(map(tuple, top_phrases(docs, top=3, least=5, chunk_words=chunk_words).collect())) == brute(rows, 5, 3)


def test_odd_rows(spark):
    rows = [
        *[(None, "New York city hall\tand New  York City, new york! City hall")] * 3,
        *[("en", "a a a a a a a")] * 4,
        *[("en", "É É É b")] * 3,
        ("en", None), (None, None), ("en", ""), ("de", ",;.\n\r\x0b\x0c \t"), ("fr", "once only"),
        ("es", "uno dos " * 20_000),
        ("es", "x" * 300_000),
        ("nul", "\x00 \x00 \x00 \x00"),
    ]
    frame = spark.createDataFrame([(1, t, lang, "1", "2", "3", "4") for lang, t in rows], SCHEMA)
    for least in (2, 3):
        for words in (1 << 20, 5):
            assert sorted(map(tuple, top_phrases(frame, least=least, chunk_words=words).collect())) == brute(rows, least)
    assert top_phrases(frame.limit(0)).count() == 0


def test_all_candidates_with_the_longer_ones(spark):
    frame = spark.createDataFrame([("en", "big red dog")] * 6 + [("en", "red dog")] * 2, "lang string, text string")
    got = {r.phrase: (r.words, r.a, r.l, r.r, r.n, r.score, r.longer) for r in candidates(frame, least=3).collect()}
    assert got == {
        "big red": (2, 6, 6, 8, 22, 857142, 6),
        "red dog": (2, 8, 8, 8, 22, 1000000, 6),
        "big red dog": (3, 6, 6, 8, 22, 857142, None),
    }


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    frame = QUERIES["op13_phrases"](spark, "/root/testdata/sf0.01")
    columns = frame.columns
    found = con.sql(ORACLE_SQL["op13_phrases"])
    assert found.columns == columns
    assert sorted(map(tuple, frame.collect())) == sorted(found.fetchall())
