from collections import Counter

import pytest

import corpus_pipeline
from pairsmith.llm import sentencepiece as sp
from tests.llm.test_minhash import brute_classes
from tests.llm.test_mixing import targets, words

library = pytest.importorskip("sentencepiece")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "encoding"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [t.collect() for t in tables]
    # Every document of these tables has a language.
    assert len(rows[1]) == len(rows[0])
    last = {}
    for r in sorted(rows[1], key=lambda r: r.doc_id):
        last["".join(c.lower() if c.isascii() else c for c in r.text)] = r.doc_id
    assert sorted(r.doc_id for r in rows[2]) == sorted(last.values())
    classes = brute_classes([(r.doc_id, r.text) for r in rows[2]])
    assert sorted(r.doc_id for r in rows[3]) == sorted(set(classes.values()))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows[3]:
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in rows[4]:
        taken[r.source] += words(r.text)
    want = targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    assert max(Counter(r.doc_id for r in rows[4]).values()) <= 3
    model, text = library.SentencePieceProcessor(model_file=sp.MODEL), {r.doc_id: r.text for r in rows[0]}
    assert Counter(r.doc_id for r in rows[5]) == Counter(r.doc_id for r in rows[4])
    assert all(r.pieces == model.encode(text[r.doc_id]) for r in rows[5])
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.pieces_crc32) for r in ran) == sorted((r.doc_id, r.pieces_crc32) for r in rows[5])


def test_odd_rows(spark, tmp_path):
    rows = [(k, f"the number {k} is {'even' if k % 2 == 0 else 'odd'} and that is all there is to say of it", "en", f"s{k % 3}", 1) for k in range(30)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, "12 34", "en", "s1", 5), (None, "a text without id but with words", "en", None, 1), (103, "twice the same row", "en", "s2", 1), (103, "twice the same row", "en", "s2", 1), (104, "long " * 40_000, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert not ids & {100, 101, 102}
    assert docs.where("not round_trip").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_columns_of_any_name_and_rows_without_id(spark, tmp_path):
    """Names that the stages use themselves, and null ids: copies and near copies without an id go as others do."""
    words = [" ".join(f"{w}{k}" for w in ("river", "forest", "mountain", "valley", "meadow", "village") for _ in range(8)) for k in range(12)]
    rows = [(k, words[k], "en", "s0", 1) for k in range(12)] + [(None, words[0].upper(), "en", "s0", 1), (None, words[1] + " more", "en", "s0", 1), (None, "a text of its own without an id, which stays", "en", "s0", 1)]
    extra = "string _row, string keys, string h, string rid, string lettered, string row, string _d, string _i, string _copies, string _words".split(", ")
    names = [x.split()[1] for x in extra]
    docs = spark.createDataFrame([(*r, *(f"{n}{j}" for n in names)) for j, r in enumerate(rows)], SCHEMA + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[5:] == names
    kept = docs.collect()
    # The larger id of equal texts, the only id of near ones.
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, range(12)), "None"]) and all(r["_row"][4:] == r["keys"][4:] for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 13
