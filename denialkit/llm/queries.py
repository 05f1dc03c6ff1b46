"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import bpe_encode
from .common import read_table
from .decontaminate import leaks
from .exact_dedup import exact_dedup
from .language_gru import language_gru
from .line_dedup import line_dedup
from .lm_score import lm_score
from .near_dedup import near_dedup
from .quality_knn import quality_knn
from .ranked_search import ORACLE as RANKED_SQL
from .ranked_search import ranked_search
from .spelling_variants import ORACLE as SPELLING_SQL
from .spelling_variants import spelling_variants
from .substring_dedup import substring_dedup
from .token_count import token_count
from .toxicity_gbt import toxicity_gbt

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_gru(read_table(spark, sf_dir, "documents"))


def op5_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gbt(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, round_trip=True)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_knn, op3_line_dedup, op4_language_gru, op5_toxicity_gbt, op6_exact_dedup, op7_bpe_codec, op8_near_dedup, op9_decontaminate, op10_token_count, op11_lm_score, op12_spelling_variants, op13_ranked_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": """
            WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
            FROM t WINDOW g AS (PARTITION BY text_sha256)""",
        "op12_spelling_variants": SPELLING_SQL,
        "op13_ranked_search": RANKED_SQL,
    }
