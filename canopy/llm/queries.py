"""Queries of the operators of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from canopy.llm import licenses, lines, merkle, neardup, neighbours, packing, pages, pieces, quality, repeats, spelling, tokenfiles, toxicity, twins

PACK_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
FLAT_TOKENIZER, END_OF_DOCUMENT = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), PACK_TOKENIZER)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_deleted", "text")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repetition_rules(_table(spark, sf_dir, "documents")).drop("spans")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.count_tokens(_table(spark, sf_dir, "documents"), FLAT_TOKENIZER, public_tokenizers.PATTERN, END_OF_DOCUMENT)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words_each=3, percent=85)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(_table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("matches")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_best_fit_packing, op2_line_dedup, op3_nearest_neighbours, op4_quality_rules, op5_token_counts, op6_minhash_near_dedup, op7_sentencepiece,
        op8_html_extraction, op9_quality_classifier, op10_license_scan, op11_toxicity, op12_merkle_manifest, op13_spelling_variants,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle_manifest": twins.merkle(), "op13_spelling_variants": twins.spelling()}
