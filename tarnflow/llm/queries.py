"""The training-data queries: each operator over its whole table, and SQL with the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tarnflow.llm import archives, decontamination, extraction, fingerprints, mixing, neardup, packing, privacy, quality, tokenfiles

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), end_id=2)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(_table(spark, sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), end_id=1)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_token_planes, op3_main_text, op4_quality, op5_context_mixing, op6_personal_data,
        op7_best_fit, op8_near_duplicates, op9_decontamination, op10_archives, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op8_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
            FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reached AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
        SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
        FROM sets d JOIN reached r ON r.x = d.doc_id GROUP BY d.doc_id, d.s""",
    "op10_archives": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
            CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON f.h = p.h""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
