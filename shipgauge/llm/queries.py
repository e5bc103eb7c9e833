"""The operators as queries over whole tables, with production parameters, and their SQL where SQL can express them.

Tokenizer files come from the ``public_tokenizers`` package; every function of the
operators takes a path.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shipgauge.llm.exact_dup import exact_duplicates
from shipgauge.llm.frames import new_path
from shipgauge.llm.language import language_id
from shipgauge.llm.mixing import domain_labels, mixing_rates
from shipgauge.llm.near_dup import near_duplicates
from shipgauge.llm.near_vectors import near_vectors
from shipgauge.llm.packing import pack
from shipgauge.llm.passages import repeated_passages
from shipgauge.llm.phrases import phrases
from shipgauge.llm.resampling import LIGHT_SMOOTHING, resample
from shipgauge.llm.token_counts import TokenCache, token_counts
from shipgauge.llm.topk import exact_top_k
from shipgauge.llm.wavelet import token_shards
from shipgauge.llm.whitening import whiten
from shipgauge.session import tune

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
# Shares of tokens by label: q quality, t toxic. All domains that labels can name are here.
DOMAIN_TARGETS = {"q0t0": 0.05, "q0t1": 0.0, "q1t0": 0.92, "q1t1": 0.03}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an empty cache, so that every run does all the work."""
    cache = TokenCache(spark, new_path(spark, "token-cache"), WORD_BPE)
    return token_counts(table(spark, sf_dir, "documents"), WORD_BPE, cache)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), smoothing=LIGHT_SMOOTHING)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that has come before, and every window of 50 words."""
    return repeated_passages(table(spark, sf_dir, "documents"), run_words=1, lines=True)


def op5_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), DOMAIN_TARGETS)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), BYTE_BPE, new_path(spark, "token-shards"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as BIGINT, null where it does not fit one."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_importance_resampling, op3_exact_top_k, op4_repeated_passages, op5_mixing_rates,
    op6_near_duplicates, op7_exact_duplicates, op8_token_shards, op9_language_id, op10_packing,
    op11_phrases, op12_near_vectors, op13_whitening,
)}

SQL = {
    "op3_exact_top_k": """
        WITH sound AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v)::BIGINT END AS score
            FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
            FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op7_exact_duplicates": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
            FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM g""",
    "op11_phrases": r"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang,
                         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                  FROM documents)
        ), counts AS (
            SELECT lang, g, len(g) AS m, count(*) AS f
            FROM (SELECT lang, unnest([w[i:i + m - 1] FOR i IN range(1, len(w) - m + 2)]) AS g
                  FROM pieces, (VALUES (1), (2), (3), (4), (5)) s(m) WHERE len(w) >= m)
            GROUP BY ALL
        ), sizes AS (
            SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, g, m, f AS a FROM counts WHERE m > 1 AND f >= 100
        ), inner_ones AS (
            SELECT lang, g, max(a) AS inside FROM (SELECT lang, unnest([g[1:m - 1], g[2:m]]) AS g, a FROM candidates WHERE m > 2) GROUP BY ALL
        ), cuts AS (
            SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, s.n, (1000::HUGEINT * c.a * s.n) // (l.f::HUGEINT * r.f) AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
            JOIN counts l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[k + 1:c.m]
            JOIN sizes s ON s.lang = c.lang
            LEFT JOIN inner_ones i ON i.lang = c.lang AND i.g = c.g
            WHERE i.inside IS NULL OR i.inside < c.a
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        ), ranked AS (
            SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM lowest
        )
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op12_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings
        ), sound AS (
            SELECT * FROM v WHERE e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
        ), links AS (
            SELECT a.i, b.i AS j FROM sound a JOIN sound b ON a.i <> b.i AND len(a.e) = len(b.e)
            WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95
        ), reach AS (
            SELECT i, i AS j FROM v UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j
        ), least AS (
            SELECT r.i, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.i = r.j GROUP BY r.i
        )
        SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN least ON least.i = v.i LEFT JOIN (SELECT i, count(*) AS n_links FROM links GROUP BY i) n ON n.i = v.i""",
}
