"""Held-out accuracy of the classifiers on the driver's documents, and their awkward cases."""

import os

import pytest
from pyspark.sql import functions as F

from denialkit.llm.language_gru import language_gru
from denialkit.llm.quality_knn import quality_knn
from denialkit.llm.toxicity_gbt import toxicity_gbt

from .fixtures import awkward, prose, table

FOLDER = os.environ.get("MODEL_SF_DIR", "/root/testdata/sf0.01")
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@here
@pytest.mark.parametrize(("model", "label", "least"), [(quality_knn, "quality", 0.85), (toxicity_gbt, "toxic", 0.9)])
def test_held_out_ranking(spark, model, label, least):
    labels = read(spark, "labels")
    scored = model(read(spark, "documents"), labels).join(labels.select("doc_id", label), "doc_id").where("held_out").select(label, "score").collect()
    assert auc([(r[0], r[1]) for r in scored]) >= least


@here
def test_held_out_languages(spark):
    docs = read(spark, "documents")
    got = language_gru(docs).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 50 and right >= 0.9


@pytest.mark.parametrize("model", [quality_knn, toxicity_gbt])
def test_awkward_documents(spark, model):
    docs = table(spark, [*awkward(), *prose(30)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5, 40)] + [(None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")
    rows = model(docs.union(docs), labels).collect()
    assert len(rows) == 2 * docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert model(docs.limit(0), labels).count() == 0
    assert all(0 <= r.score <= 1 for r in model(docs, labels.limit(0)).collect())


def test_awkward_languages(spark):
    docs = table(spark, [*awkward(), *prose(30)])
    rows = {r.doc_id: r for r in language_gru(docs).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[i].lang_pred == "und" for i in (0, 1, 2, 13)) and rows[3].lang_pred in ("en", "de")
    assert language_gru(docs.limit(0)).count() == 0


def test_slices_without_words(spark):
    """A partition of empty texts, and an empty text between two that are slices of their own."""
    long = "der die das und " * 60_000
    docs = table(spark, [long, "", long, None, " "]).coalesce(1)
    rows = {r.doc_id: r.lang_pred for r in language_gru(docs).collect()}
    assert [rows[i] for i in (1, 3, 4)] == ["und"] * 3 and rows[0] == rows[2] != "und"
    blank = table(spark, ["", None, " ", "one"]).coalesce(1)
    assert {r.lang_pred for r in language_gru(blank.union(blank.where("text = ''").coalesce(1))).collect()} >= {"und"}
    assert language_gru(blank.where("coalesce(trim(text), '') = ''")).where("lang_pred <> 'und'").count() == 0
