import math
import re
import zlib
from collections import Counter

import numpy as np

from pairsmith.llm import lm

SCHEMA = "doc_id long, text string, h string, score string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def compare(spark, rows, monkeypatch=None):
    out = lm.score_documents(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()
    counts = Counter(w for d, t in rows if not is_held_out(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), is_held_out(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 5)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    return out


def test_counts_and_base_score_on_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = compare(spark, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Ab aB ÄB äb"), (4, "Ab aB ÄB äb"), (None, "zz top"), (6, "word " * 50_000), *((k, f"w{k} the") for k in range(20, 60))]
    out = compare(spark, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def small_model(seed=5, n=40):
    rng = np.random.default_rng(seed)
    model = lm.LogBilinear(rng.integers(0, 50, n).astype(float))
    for k in model.NAMES:
        old = getattr(model, k)
        setattr(model, k, (old + rng.normal(0, 0.3, old.shape)).astype(np.float32))
    return model, rng


def test_probabilities_add_up(monkeypatch):
    monkeypatch.setattr(lm, "ALONE", 4)
    monkeypatch.setattr(lm, "GROUP", 7)
    model, rng = small_model()
    everything = np.arange(40)
    for _ in range(5):
        two, one = rng.integers(0, 40, 2)
        assert math.isclose((10 ** model.log10(np.full(40, two), np.full(40, one), everything)).sum(), 1, abs_tol=1e-5)
    assert model.starts[-1] == 40 and (np.diff(model.starts) > 0).all() and np.diff(model.starts).max() == 7


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(lm, "ALONE", 4)
    monkeypatch.setattr(lm, "GROUP", 7)
    model, rng = small_model()
    two, one, target = rng.integers(0, 40, (3, 30))
    noise = model.draw(rng)
    assert all((model.of[own] == c).all() for c, own in enumerate(noise[1]))
    for name, g in model.gradients(two, one, target, noise).items():
        flat = getattr(model, name)
        places = [np.unravel_index(int(k), flat.shape) for k in np.argsort(-np.abs(g), axis=None)[:4]]
        for at in places:
            before, both = flat[at], []
            for h in (1e-2, -1e-2):
                flat[at] = before + h
                both.append(model.loss(two, one, target, noise))
            flat[at] = before
            assert math.isclose((both[0] - both[1]) / 2e-2, g[at], rel_tol=0.03, abs_tol=2e-4)


def test_scores_same_as_a_loop_over_the_tokens(spark, monkeypatch):
    """Each token's probability by its definition, from the trained parameters: dense softmax over classes, over the class, share of the shape."""
    monkeypatch.setattr(lm, "HEAD", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", lm.held_out().alias("held_out"), "text")
    model, counts = lm.train(rows)
    count, neural = {r.h: r.c for r in counts.collect()}, model.neural
    ids = dict(zip(model.words.hashes.tolist(), model.words.ids.tolist(), strict=True))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def score(text):
        data = lm.tokens.LOWER[np.frombuffer(text.encode(), np.uint8)]
        hashes, shapes, _ = lm._stream(data, np.array([0, len(data)]))
        out, two, one = 0.0, lm.END_ID, lm.END_ID
        for h, shape in zip(hashes.tolist(), shapes.tolist(), strict=True):
            k = ids.get(h, shape)
            q = neural.context[two].astype(float) @ neural.position[0] + neural.context[one].astype(float) @ neural.position[1]
            c = neural.of[k]
            members = slice(neural.starts[c], neural.starts[c + 1])
            p = softmax(neural.klass @ q + neural.klass_bias)[c] * softmax(neural.word[members] @ q + neural.word_bias[members])[k - neural.starts[c]]
            signed = h - (1 << 64) if h >> 63 else h
            out += math.log10(p) + (math.log10(count.get(signed, 0) + 0.1) - model.shape_log[k] if k < lm.SHAPES else 0)
            two, one = one, k
        return out

    found = lm._partial_scores(model)
    scored = {}
    for r in docs.limit(12).collect():
        data = lm.tokens.LOWER[np.frombuffer(r.text.encode(), np.uint8)]
        hashes, shapes, own = lm._stream(data, np.array([0, len(data)]))
        s, log_count, there = lm.token_scores(model, hashes, shapes, own)
        rest = sum(math.log10(count.get(int(h), 0) + 0.1) for h in hashes[~there].view(np.int64))
        scored[r.doc_id] = s.sum() + rest
        assert math.isclose(scored[r.doc_id], score(r.text), rel_tol=1e-4)
    assert found is not None and len(model.neural.context) > 100


def test_training_learns_from_the_words_before(spark):
    """Texts in which each word follows from the two before: held-out scores beat a smoothed bigram model's."""
    rng = np.random.default_rng(2)
    pairs = {(a, b): int(rng.integers(0, 12)) for a in range(12) for b in range(12)}
    rows = []
    for k in range(1500):
        a, b = rng.integers(0, 12, 2)
        text = [f"w{a}", f"w{b}"]
        for _ in range(40):
            a, b = b, pairs[a, b] if rng.random() < 0.9 else int(rng.integers(0, 12))
            text.append(f"w{b}")
        rows.append((k, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    rows_ = frame.select("doc_id", lm.held_out().alias("held_out"), "text")
    held = [t for d, t in rows if is_held_out(d)]
    model, _ = lm.train(rows_, passes=12)
    data = lm.tokens.LOWER[np.frombuffer("".join(held).encode(), np.uint8)]
    offsets = np.append(0, np.cumsum([len(t) for t in held]))
    score = lm.token_scores(model, *lm._stream(data, offsets))[0].sum()
    bigram, single = Counter(), Counter()
    for d, t in rows:
        if not is_held_out(d):
            seq = [None, *words(t)]
            bigram.update(zip(seq, seq[1:], strict=False))
            single.update(seq[:-1])
    other = sum(math.log10((bigram[p] + 0.1) / (single[p[0]] + 1.4)) for t in held for p in zip([None, *words(t)], words(t), strict=False))
    assert score > other


def test_held_out_scores_beat_the_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.score_documents(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
