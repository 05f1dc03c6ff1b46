"""Ranked search against scores computed one document at a time."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from denialkit.llm import ranked_search as rs

from .fixtures import awkward, lower, prose, table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(lower(text)) if text else []


def brute(docs, items, most=20):
    """docs: (doc_id, text), items: (item_id, text)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    count, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:most])]
    return Counter(out)


def rows(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string").selectExpr("*", "'x' as doc_id", "'x' as score")


def corpus():
    texts = awkward() + prose(400, vocabulary=300, most=80)
    return texts + texts[20:60] + [f"{t} common" for t in texts[60:300]]


@pytest.mark.parametrize(("shard", "block"), [(rs.SHARD, rs.BLOCK_BYTES), (400, 300)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    """Also in shards of a few documents and queries in several blocks."""
    monkeypatch.setattr(rs, "SHARD", shard)
    rng, texts = random.Random(3), corpus()
    asked = [t for t in rng.sample(texts, 25) if t] + ["common common ONE", "", None, "nowhere", "common"] + prose(5, seed=9, vocabulary=50)
    got = rs.ranked_search(table(spark, texts).repartition(3), items(spark, asked), block_bytes=block)
    assert rows(got) == brute(list(enumerate(texts)), list(enumerate(asked)))


def test_non_essential_lists_are_only_probed():
    """What cannot reach the floor is not returned, all that can is, with whole scores."""
    q = rs.Queries([0], ["rare common"])
    docs = ["common " * (i % 5 + 1) + ("rare" if i % 50 == 0 else "") for i in range(400)]
    n, row, term = q.find(pa.array(docs))
    bag = [sorted(Counter(term[row == i].tolist()).items()) for i in range(len(docs))]
    lists = [pa.array([[x[k] for x in b] for b in bag], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.int64()))]
    weight = np.where(q.size == len("rare"), 5000, 10)
    shard = rs.Shard(pa.table([pa.array(range(len(docs))), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"]), weight, len(docs), int(n.sum()))
    every, score = shard.best(*q.terms[0], 0, 20)
    assert len(every) == 400
    best = sorted(score.tolist(), reverse=True)[:8]
    some, again = shard.best(*q.terms[0], best[-1], 20)
    assert sorted(again.tolist(), reverse=True) == best and (some % 50 == 0).all()


def test_awkward_tables(spark):
    docs, ask = table(spark, corpus()[:60]), items(spark, ["one two", "one two", None])
    null = docs.withColumn("doc_id", docs.doc_id * 0 + (docs.doc_id % 2)).selectExpr("if(doc_id = 0, null, 7L) as doc_id", "text")
    assert rs.ranked_search(docs.limit(0), ask).count() == 0
    assert rs.ranked_search(docs, ask.limit(0)).count() == 0
    assert rs.ranked_search(docs.selectExpr("doc_id", "cast(null as string) as text"), ask).count() == 0
    got = rows(rs.ranked_search(null, ask))
    want = brute([(r.doc_id, r.text) for r in null.collect()], list(enumerate(["one two", "one two", None])))
    assert got == want and any(k[2] is None for k in got)
    twice = rows(rs.ranked_search(docs.union(docs), ask))
    assert twice == brute([(r.doc_id, r.text) for r in docs.union(docs).collect()], list(enumerate(["one two", "one two", None])))


def test_a_text_of_megabytes_counts_whole(spark):
    long = "filler " * 300_000 + "needle"
    got = rs.ranked_search(table(spark, [long, "needle in hay", "hay", ""]), items(spark, ["needle"]))
    assert rows(got) == brute(list(enumerate([long, "needle in hay", "hay", ""])), [(0, "needle")])


def test_sql(spark):
    texts, asked = corpus()[:200], ["one TWO", *prose(4, seed=9, vocabulary=50)]
    con = duckdb.connect()
    con.register("d", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    con.register("b", pa.table({"item_id": list(range(len(asked))), "text": asked}))
    con.execute("CREATE VIEW documents AS SELECT * FROM d; CREATE VIEW benchmark AS SELECT * FROM b")
    want = Counter((r[0], r[1], r[2], r[3]) for r in con.execute(rs.ORACLE).fetchall())
    assert rows(rs.ranked_search(table(spark, texts), items(spark, asked))) == want
