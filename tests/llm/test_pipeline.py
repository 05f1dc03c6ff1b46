import random

import pytest

import corpus_pipeline
from denialkit.llm import queries

from .fixtures import awkward, near_copies, prose, table, words
from .test_dedup import brute_near, lower


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark with junk, copies, near copies and leaks."""
    rng, path = random.Random(2), str(tmp_path_factory.mktemp("tables"))
    clean = prose(160, least=30, most=100)
    junk = [" ".join(f"{w}!!".upper() for w in t.split()) for t in prose(60, seed=8)]
    items = prose(8, seed=21, vocabulary=4000, least=18, most=50)
    leaky = [f"{t} {items[i % 8]} {t[:40]}" for i, t in enumerate(prose(16, seed=31))]
    copies, near = clean[:10] * 2, near_copies(clean[10:20], rng, 2, 1)
    texts = clean + junk + leaky + copies + near + awkward()
    table(spark, texts, extra=False).write.parquet(f"{path}/documents.parquet")
    quality = [(i, 0 if len(clean) <= i < len(clean) + len(junk) else 1, i % 2) for i in range(len(clean) + len(junk) + len(leaky))]
    spark.createDataFrame(quality, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, len(clean), len(junk), len(leaky), items


def test_stages(spark, folder):
    path, texts, clean, junk, leaky, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], path).cache())
        assert name == "bpe" or frames[-1].columns == docs.columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    junk_ids, leak_ids = set(range(clean, clean + junk)), set(range(clean + junk, clean + junk + leaky))
    assert not ids[1] & junk_ids and set(range(clean)) | leak_ids <= ids[1]
    last = {lower(texts[i]): i for i in sorted(ids[1])}
    assert ids[2] == set(last.values())
    assert ids[3] == {i for i, _, _, kept in brute_near([(i, texts[i]) for i in sorted(ids[2])]) if kept}
    assert ids[4] == {i for i in ids[3] if not any(" ".join(words(x)) in " ".join(words(texts[i])) for x in items)}
    assert ids[5] == ids[4] and all(r.decoded == (r.text or "") for r in frames[5].collect())


def test_run_and_extra_columns(spark, folder):
    path, texts, *_ = folder
    once = corpus_pipeline.run(spark, path).select("doc_id", "ids").collect()
    assert len(once) > 100
    odd = table(spark, [*texts[:40], *awkward()])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, path).count() > 0
        assert stage(spark, odd.limit(0), path).count() == 0
        assert stage(spark, odd.union(odd), path).count() >= stage(spark, odd, path).count()


def test_registered():
    names = [q.split("_")[0] for q in queries.queries()]
    assert sorted(names) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])
