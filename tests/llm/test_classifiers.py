import random

import numpy as np

from pairsmith.llm import langid, toxicity

SCHEMA = "doc_id long, text string, lang string, grade string, score string"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = langid.predict_language(docs).collect()
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert 150 < len(held) < 350 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_language_of_odd_rows(spark):
    rows = [(k, f"the quick brown fox number {k} and the dog", "en") for k in range(40)] + [(100 + k, f"der schnelle braune fuchs nummer {k} und der hund", "de") for k in range(40)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !? 456", None), (903, "the dog", None), (903, "the dog", None), (None, "und der hund", None), (904, "der hund " * 60_000, None)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = {}
    for r in langid.predict_language(frame).collect():
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert got[900] == got[901] == got[902] == ["und"] and got[903] == ["en"] * 2 and got[None] == ["de"] and got[904] == ["de"]
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns and {str(r.doc_id) for r in kept.collect()} == {str(r[0]) for r in rows} - {"900", "901", "902"}
    assert langid.predict_language(frame.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict_language(frame.withColumn("lang", frame["text"].substr(1, 0)).replace("", None, "lang")).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(20 * g + k, f"{chr(97 + g % 26)}{chr(97 + g // 26)}qx " * (3 + k), f"l{g:03}") for g in range(30) for k in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, frame["doc_id"].isNotNull(), sample=40)
    assert len(model.langs) == 30


def test_letters_are_those_of_unicode(spark):
    rows = [(k, "the quick fox", "en") for k in range(20)] + [(100 + k, t, None) for k, t in enumerate(("\u00bd \u00b2", "\u2167 \u2460", "12_3", "\u00e9", "\u4eba"))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + k][0] for k in range(5)] == ["und", "und", "und", "en", "en"] and got[100] == ("und", 0.0)


def test_language_same_as_dense_kernel_regression(spark):
    """Every step by its definition: kernel matrices of sets of cells, the landmarks' inverse root, a ridge solution of each language."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("o")).collect()}
    rows = {r.doc_id: r for r in docs.collect()}

    def cells(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        plain = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low)
        out = set()
        for n in range(1, 5):
            for i in range(len(plain) - n + 1):
                gram = int.from_bytes(plain[i : i + n], "big")
                out.add((((gram * 2654435761 + (0x9E3779B9 * n & 0xFFFFFFFF)) & 0xFFFFFFFF) * 2246822519 & 0xFFFFFFFF) >> 17)
        return out

    sets = {d: cells(r.text) for d, r in rows.items()}
    out = {r.doc_id: r for r in langid.predict_language(docs).collect()}
    learned = sorted((rows[d].lang, order[d], d) for d, r in out.items() if not r.held_out and rows[d].lang)
    langs = sorted({g for g, _, _ in learned})
    share = langid.LANDMARKS // len(langs)
    marks = [d for g in langs for d in [d for lang, _, d in learned if lang == g][:share]]
    kernel = lambda xs, ys: np.array([[len(sets[x] & sets[y]) / np.sqrt(len(sets[x]) * len(sets[y])) for y in ys] for x in xs])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel([d for _, _, d in learned], marks) @ root
    counts = {g: sum(lang == g for lang, _, _ in learned) for g in langs}
    balance = np.array([len(learned) / len(langs) / counts[g] for g, _, _ in learned])
    everyone = sorted(rows)
    all_features = kernel(everyone, marks) @ root
    values = []
    for g in langs:
        target = np.array([1.0 if lang == g else -1.0 for lang, _, _ in learned])
        gram = features.T @ (features * balance[:, None]) + langid.RIDGE * len(learned) * np.eye(features.shape[1])
        values.append(all_features @ np.linalg.solve(gram, features.T @ (balance * target)))
    values = np.array(values).T
    for k, d in enumerate(everyone):
        assert abs(out[d].score - min(1, max(0, (1 + values[k].max()) / 2))) < 2e-3
        second = np.sort(values[k])[-2]
        assert out[d].lang_pred == langs[values[k].argmax()] or values[k].max() - second < 1e-2


def test_presence_kernel_by_definition():
    texts = [b"abcab", b"", b"zz top", b"abc"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    starts, cells = langid.presence(data, offsets)
    grams = [{t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    sets = [set(cells[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [len(s) for s in sets] == [len(g) for g in grams]
    assert len(sets[0] & sets[3]) == len(grams[0] & grams[3])


def test_toxicity_of_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("toxic", "grade")
    truth = {r.doc_id: r.grade for r in labels.collect()}
    out = toxicity.predict_toxicity(docs, labels.where("doc_id % 3 > 0")).collect()
    test = [r for r in out if r.doc_id in truth and r.doc_id % 3 == 0]
    hit = sum(r.toxic for r in test if truth[r.doc_id]) / sum(truth[r.doc_id] for r in test)
    wrong = sum(r.toxic for r in test if not truth[r.doc_id]) / sum(not truth[r.doc_id] for r in test)
    assert hit > 0.85 and wrong < 0.01


def test_ordered_grades():
    rng = random.Random(8)
    rows = []
    for _ in range(1200):
        bad = rng.choice([0, 0, 1, 2, 4])
        grade = {0: 0, 1: 1, 2: 2, 4: 3}[bad]
        rows.append((grade, np.array(sorted({*rng.sample(range(50, 500), 12), *rng.sample(range(8), bad)}))))
    model = toxicity.fit(rows)
    assert (np.diff(model.thresholds) >= 0).all() and model.grades == [0, 1, 2, 3]
    starts, cells = np.append(0, np.cumsum([len(c) for _, c in rows])), np.concatenate([c for _, c in rows])
    chance = model.probabilities(model.scores(starts, cells))
    severity = chance @ np.arange(4.0)
    means = [severity[[g == k for g, _ in rows]].mean() for k in range(4)]
    assert np.allclose(chance.sum(1), 1) and all(b - a > 0.4 for a, b in zip(means, means[1:], strict=False))


def test_fit_reaches_the_least_loss():
    """The fitted model against an explicit design matrix: the penalised likelihood's gradient is next to nothing, and no step away is better."""
    rng = random.Random(3)
    rows = [(rng.randrange(3), np.array(sorted(rng.sample(range(30), 5)))) for _ in range(400)]
    model = toxicity.fit(rows)
    design = np.zeros((400, 30))
    for k, (_, c) in enumerate(rows):
        design[k, c] = 1
    y = np.array([g for g, _ in rows])

    def loss(w, theta):
        score = design[:, model.cells] @ w
        edges = np.column_stack([np.full(400, -np.inf), theta[0] - score, theta[1] - score, np.full(400, np.inf)])
        below = 1 / (1 + np.exp(-edges))
        p = below[np.arange(400), y + 1] - below[np.arange(400), y]
        return -np.log(p).mean() + toxicity.RIDGE / 2 * (w @ w)

    least = loss(model.weights, model.thresholds)
    for _ in range(60):
        w, theta = np.array([rng.gauss(0, 1) for _ in model.weights]), np.array([rng.gauss(0, 1), rng.gauss(0, 1)])
        assert loss(model.weights + 0.05 * w, model.thresholds + 0.05 * theta) > least - 1e-7
    one = model.probabilities(model.scores(np.array([0, 5]), rows[0][1]))[0]
    assert np.allclose(one.sum(), 1) and (one > 0).all()


def test_predictions_same_as_a_loop_over_the_words(spark):
    """Features, scores and chances of every document by a plain loop over its words, with the trained weights."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    labels = labels.withColumnRenamed("toxic", "grade")
    plain = docs.select("doc_id", "text")
    model = toxicity.train(plain, labels.select("doc_id", "grade"))
    weight = dict(zip(model.cells.tolist(), model.weights.tolist(), strict=True))
    out = {r.doc_id: r for r in toxicity.predict_toxicity(docs, labels).collect()}

    def cell(word, k):
        data = np.frombuffer(word, np.uint8)
        h = toxicity.tokens.word_hashes(data, np.array([0]), np.array([len(data)]))
        return int((toxicity.tokens.mix64(h + np.uint64(k)) if k else h)[0]) >> 42

    for r in docs.collect():
        text = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in bytes(b + 32 if 65 <= b <= 90 else b for b in (r.text or "").encode()))
        cells = set()
        for word in set(text.split()):
            cells.add(cell(word, 0))
            cells |= {cell(word[:n], k + 1) for k, n in enumerate(toxicity.PREFIXES) if len(word) >= n}
        score = sum(weight.get(c, 0.0) for c in cells)
        toxic = 1 - 1 / (1 + np.exp(-(model.thresholds[0] - score)))
        assert abs(out[r.doc_id].expected_severity - toxic) < 1e-9 and out[r.doc_id].grade == int(toxic > 0.5) and out[r.doc_id].toxic == (toxic >= model.cut)


def test_cut_by_hand():
    chance, worse = np.array([0.9, 0.8, 0.3, 0.2]), np.array([True, True, False, True])
    assert abs(toxicity.best_cut(chance, worse, np.ones(4)) - 0.1) < 1e-12
    assert abs(toxicity.best_cut(chance, worse, np.array([1.0, 1, 5, 1])) - 0.55) < 1e-12


def test_toxicity_of_odd_rows(spark):
    rows = [(k, "you vile creature" if k % 2 else "a kind and gentle word", "en") for k in range(60)] + [(900, None, None), (901, "", None), (None, "vile", None), (902, "VILE", None), (902, "VILE", None), (903, "gentle " * 60_000, None)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (5, None)], "doc_id long, grade int")
    got = {}
    for r in toxicity.predict_toxicity(frame, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[None][0].toxic and [r.toxic for r in got[902]] == [True, True] and not got[903][0].toxic and got[900][0].expected_severity == got[901][0].expected_severity
    assert toxicity.predict_toxicity(frame.limit(0), labels).count() == 0
    assert {r.grade for r in toxicity.predict_toxicity(frame, labels.limit(0)).collect()} == {0}
