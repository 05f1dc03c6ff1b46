"""A corpus-cleaning pipeline of five operators, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denialkit.llm.bpe_codec import bpe_encode
from denialkit.llm.common import Stored, ascii_lower, read_table, without
from denialkit.llm.decontaminate import leaks
from denialkit.llm.exact_dedup import exact_dedup
from denialkit.llm.near_dedup import near_dedup
from denialkit.llm.quality_knn import quality_scores
from denialkit.llm.queries import TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    return quality_scores(docs, read_table(spark, sf_dir, "labels")).where("score >= 0.5").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for A-Z: the one with the largest doc_id;
    of rows that repeat doc_id and text, one."""
    store = Stored(spark)
    groups = store.put("groups", exact_dedup(docs, store))
    keyed = docs.withColumn("text_sha256", F.sha2(ascii_lower(F.col("text")), 256))
    kept = without(keyed, groups.where("not kept"), "text_sha256")
    tied = store.put("tied", groups.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1"))
    if tied.limit(1).count():
        again = kept.join(tied.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s")), "left_semi")
        kept = without(kept, tied, "text_sha256").unionByName(again.dropDuplicates(["doc_id", "text_sha256"]))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    store = Stored(spark)
    return without(docs, store.put("dropped", near_dedup(docs, store=store).where("not kept").select("doc_id")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are told apart by doc_id and text together, so that a row without doc_id, or one whose
    doc_id another row repeats, goes for its own text only. Null and empty texts stay.
    """
    row, name = F.xxhash64("doc_id", "text"), "row_" + uuid.uuid4().hex  # no column of docs has such a name
    found = leaks(docs.select(row.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return without(docs.withColumn(name, row), Stored(spark).put("leaks", found.select(F.col("doc_id").alias(name)).distinct()), keys=(name,)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the token ids of each text, and the text decoded from them."""
    return bpe_encode(docs, TOKENIZER, round_trip=True)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: SQL cannot express the stages' models and tokens; tests/llm/test_pipeline.py holds the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written as Parquet and read again."""
    store, docs = Stored(spark), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
