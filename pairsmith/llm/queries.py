"""Queries over the driver's tables, one for each operator of this subpackage, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .fingerprints import BLANK, PIECE, fingerprint_edits
from .hardneg import hard_negatives
from .langid import predict_language
from .linededup import dedup_lines
from .lm import score_documents
from .minhash import near_classes
from .mixing import mix
from .phrases import top_phrases
from .sentencepiece import encode_documents
from .sharding import assign_shards
from .topk import top_k
from .toxicity import predict_toxicity


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("i")



def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return predict_toxicity(table(spark, sf_dir, "documents"), labels)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), whole=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash": op1_minhash, "op2_sentencepiece": op2_sentencepiece, "op3_mixing": op3_mixing, "op4_topk": op4_topk, "op5_lm": op5_lm, "op6_toxicity": op6_toxicity, "op7_langid": op7_langid, "op8_linededup": op8_linededup, "op9_exact_dedup": op9_exact_dedup, "op10_sharding": op10_sharding, "op11_fingerprints": op11_fingerprints, "op12_hardneg": op12_hardneg, "op13_phrases": op13_phrases}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
            (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_fingerprints": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        e AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS other,
                     coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM d WINDOW o AS (ORDER BY doc_id DESC)),
        x AS (SELECT doc_id, next_id, n, text, left(text, n - n // 3) || left(other, n // 3) AS edited FROM e),
        t AS (SELECT doc_id, 'text' AS side, text AS t FROM x UNION ALL SELECT doc_id, 'edited', edited FROM x),
        p AS (SELECT doc_id, side, regexp_extract_all(t, '{PIECE}') AS p FROM t),
        h AS (SELECT *, list_transform(p, lambda y: sha256('0' || y)) AS h FROM p),
        l AS (SELECT *, list_filter(list_transform(p, lambda y, i: CASE WHEN contains(y, chr(10)) OR i = len(p) THEN i END), lambda i: i IS NOT NULL) AS l FROM h),
        q AS (SELECT *, list_transform(l, lambda k, j: {{'d': sha256('1' || array_to_string(list_slice(h, coalesce(l[j - 1], 0) + 1, k), '')), 'b': regexp_matches(p[k], '{BLANK}')}}) AS q FROM l),
        s AS (SELECT *, list_filter(list_transform(q, lambda y, i: CASE WHEN y.b OR right(y.d, 1) IN ('0', '8') OR i = len(q) THEN i END), lambda i: i IS NOT NULL) AS s FROM q),
        r AS (SELECT *, list_transform(s, lambda k, j: sha256('2' || array_to_string(list_transform(list_slice(q, coalesce(s[j - 1], 0) + 1, k), lambda y: y.d), ''))) AS r FROM s),
        f AS (SELECT doc_id, side, list_distinct(list_transform(h, lambda y: left(y, 6))) AS c, sha256('3' || coalesce(array_to_string(r, ''), ''))
                     || ':' || base64(unhex(coalesce(array_to_string(list_transform(h, lambda y: left(y, 6)), ''), ''))) AS f FROM r)
        SELECT x.doc_id, x.n AS n_chars, sha256(x.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
               CASE WHEN a.f = b.f THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.c, b.c)) / greatest(len(a.c) + len(b.c), 1) END AS near_edited,
               CASE WHEN a.f = c.f THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.c, c.c)) / greatest(len(a.c) + len(c.c), 1) END AS near_next
        FROM x JOIN f a ON a.doc_id = x.doc_id AND a.side = 'text' JOIN f b ON b.doc_id = x.doc_id AND b.side = 'edited' JOIN f c ON c.doc_id = x.next_id AND c.side = 'text'""",
    "op12_hardneg": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                     row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
        n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
              WHERE k <= 5)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_phrases": f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
        sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM words), grams AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized WHERE len(w) >= k),
        f AS (SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k, count(*) AS a FROM grams GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
        sides AS (SELECT lang, phrase, a, k, w, unnest(generate_series(1, k - 1)) AS j FROM c),
        named AS (SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS p, array_to_string(list_slice(w, j + 1, k), ' ') AS q FROM sides),
        cuts AS (SELECT s.lang, s.phrase, s.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * s.a) // (x.a::HUGEINT + y.a) AS score
                 FROM named s JOIN f x ON x.lang = s.lang AND x.phrase = s.p JOIN f y ON y.lang = s.lang AND y.phrase = s.q),
        low AS (SELECT DISTINCT ON (lang, phrase) * FROM cuts ORDER BY lang, phrase, score, j),
        parts AS (SELECT lang, a, w, k, unnest([2, 3]) AS p FROM c), places AS (SELECT *, unnest(generate_series(1, k - p + 1)) AS i FROM parts WHERE p < k),
        over AS (SELECT lang, array_to_string(list_slice(w, i, i + p - 1), ' ') AS phrase, max(a) AS longer FROM places GROUP BY ALL),
        kept AS (SELECT low.* FROM low LEFT JOIN over USING (lang, phrase) WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
