import random

from pairsmith.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(1)
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由,在尊严和权利上一律平等",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι",
        "Wszyscy ludzie rodzą się wolni i równi w godności i prawach",
        "".join(rng.choice("0123456789abcdef") for _ in range(400)),
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(80)),
    ]
    known = docs.count()
    kept = langid.keep_identified(docs.union(spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(foreign)], SCHEMA))).collect()
    assert not [r.text for r in kept if r.doc_id < 0]
    assert len(kept) >= 0.99 * known
