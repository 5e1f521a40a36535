import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairsmith.llm import sentencepiece as sp

library = pytest.importorskip("sentencepiece")
MODEL = library.SentencePieceProcessor(model_file=sp.MODEL)
PIECES = sp.Pieces.load()


def rows(texts):
    ids, offsets = sp.encode(PIECES, texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], sp.decode(PIECES, ids, offsets)


ODD = ["", None, " ", "hello world", "  two   runs ", "a\nb\tc", "ñé 你好\U0001f600 x", "\n", "ﬁ ① é", " <s> <0x41>", "　a\xa0b", " " * 15 + "x", " " * 100, "x" + " " * 31 + "ñ", "a" * 3000, "\x00\x01 a", "1234567 89", "internationalization" * 50]


def test_odd_texts_as_the_library_does():
    got, back = rows(ODD)
    assert got == [MODEL.encode(t or "") for t in ODD]
    assert back == [(t or "").encode() for t in ODD]
    assert rows(["▁a b▁"])[0] == [MODEL.encode("▁a b▁")]
    assert rows([])[0] == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" aeinorst.,\n"), st.characters(exclude_categories=["Cs"], exclude_characters="▁"))), max_size=4))
def test_any_texts(texts):
    got, back = rows(texts)
    assert got == [MODEL.encode(t) for t in texts]
    assert back == [t.encode() for t in texts]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    encoded = sp.encode_documents(docs)
    out = {r.doc_id: r for r in encoded.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(texts) and all(out[d].pieces == MODEL.encode(t) and out[d].round_trip and out[d].n_pieces == len(out[d].pieces) for d, t in texts.items())
    assert {r.doc_id: r.text for r in sp.decode_documents(encoded).collect()} == texts


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abc dé") for _ in range(300_000))
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b", 5), (4, long, None)], "doc_id long, text string, pieces int")
    out = sorted(sp.encode_documents(docs).collect(), key=lambda r: r.n_pieces)
    assert [r.n_pieces for r in out[:4]] == [0, 0, 0, 2] and out[4].pieces == MODEL.encode(long) and all(r.round_trip for r in out)
    assert sp.encode_documents(docs.limit(0)).count() == 0


def test_pairs_that_may_follow_one_another():
    t = PIECES.tables()
    rng, texts = np.random.default_rng(2), [PIECES.texts[i] for i in t["ids"]]
    a, b = rng.integers(0, len(texts), (2, 3000))
    want = [PIECES.merge(list(texts[x] + texts[y])) == [texts[x], texts[y]] for x, y in zip(a, b, strict=True)]
    assert sp.may_follow(t, a, b).tolist() == want
