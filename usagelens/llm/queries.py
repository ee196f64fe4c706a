"""Registered queries of the operators on training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import (
    ann, collocations, hard_negatives, html_text, langid, minhash, mixing, packing, pii, quality, token_counts,
    token_files, topk,
)
from usagelens.plans.views import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 move on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.cast("bigint").alias("label"), "embedding")
    return hard_negatives.hard_negatives(vectors)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_token_counts, op3_exact_top_k, op4_packing, op5_main_text, op6_near_duplicates,
        op7_nearest_neighbours, op8_personal_data, op9_language_id, op10_mixing,
        op11_collocations, op12_hard_negatives, op13_token_files,
    )
}

ORACLES = {
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
    SELECT a.rid, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
        CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
    SELECT rid, anchor_id, id AS positive_id, score AS positive_score, r FROM (
        SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS r FROM s WHERE same
    ) WHERE r <= 5
), n AS (
    SELECT p.*, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.rid, p.r ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.rid = p.rid AND NOT s.same
        AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
""",
    "op11_collocations": r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND a >= 100),
cuts AS (
    SELECT lang, phrase, a, j, array_to_string(w[:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM c)
), s AS (
    SELECT x.lang, x.phrase, x.a, x.j, l.a AS l, r.a AS r, n.n,
        (CAST(1000 AS HUGEINT) * x.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
    FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest
    JOIN n ON n.lang = x.lang
), low AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS i FROM s) WHERE i = 1
), kept AS (
    SELECT * FROM low WHERE NOT EXISTS (
        SELECT 1 FROM c WHERE c.lang = low.lang AND length(c.phrase) > length(low.phrase) AND 100 * c.a >= 100 * low.a
            AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
""",
    "op6_near_duplicates": r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, list_filter(
        string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS words
    FROM documents
), s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 OR words IS NULL THEN [] WHEN len(words) < 4 THEN [words]
        ELSE list_transform(range(1, len(words) - 2), lambda i: words[i:i + 3]) END) AS shingle
    FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS MATERIALIZED (SELECT doc_id, hash(shingle) AS g FROM s),
shared AS MATERIALIZED (SELECT g FROM h GROUP BY g HAVING count(*) > 1),
r AS MATERIALIZED (SELECT h.* FROM h JOIN shared USING (g)),
links AS MATERIALIZED (
    SELECT a.doc_id AS u, b.doc_id AS v
    FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION
    SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node AND r.root < l.v
), c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op3_exact_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s
) WHERE r <= 5
""",
}
