"""No leak may depend on the weights of words: neither on those around it nor on its own copies."""

import random

from denialkit.llm.decontaminate import leaks

from .fixtures import prose, table


def test_item_in_a_third_of_the_documents(spark):
    items = prose(3, seed=50, vocabulary=3000, least=15, most=24)
    around = prose(240, seed=51, vocabulary=60000, least=150, most=220)
    texts = []
    for i, t in enumerate(around):
        w = t.split()
        texts.append(" ".join([*w[:70], items[0], *w[70:]]) if i % 3 == 0 else t)
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.in_order for r in leaks(table(spark, texts), bench).collect()}
    assert got == {(i, 0): 1.0 for i in range(0, 240, 3)}


def in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_scattered_copies_against_every_region(spark):
    """Parts of items between common words, held against each region by brute force; 75 % in order
    only, for the answer terms need the operator's own order of equally rare words."""
    rng = random.Random(9)
    items = [t.split() for t in prose(6, seed=52, vocabulary=300, least=15, most=30)]
    texts = []
    for k in range(120):
        item, words = items[k % 6], prose(1, seed=100 + k, vocabulary=300, least=90, most=140)[0].split()
        at = rng.randrange(60)
        for x in item:
            if rng.random() < 0.8:
                words.insert(at, x)
            at += rng.randint(1, 3)
        texts.append(words)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.in_order for r in leaks(table(spark, [" ".join(t) for t in texts]), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            want[d, i] = max(in_order(x, t[max(0, p - len(x)) : p + 48 + len(x)]) / len(x) for p in range(0, len(t), 16))
    assert sum(share >= 0.75 for share in want.values()) > 20
    assert {k for k, share in want.items() if share >= 0.75} <= set(got)
    assert all(share <= want[k] + 1e-9 and share >= 0.5 for k, share in got.items())
    assert all(got[k] == share for k, share in want.items() if share >= 0.75)


def test_capitals_of_any_script(spark):
    """Each word has a letter outside A-Z, so that none equals its capitals byte by byte."""
    rng = random.Random(10)
    items = [" ".join("".join(rng.choices("abcdefg", k=4)) + rng.choice(["\u00e9", "\u00f1\u00ed", "\u00fc", "\u00df", "\u0448\u0434", "\u03c3\u03c2"]) for _ in range(20)) for _ in range(6)]
    clean = prose(12, seed=54, vocabulary=5000, least=40)
    texts = [f"{a} {x.upper()} {b}" for a, x, b in zip(clean[:6], items, clean[6:], strict=True)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.in_order) for r in leaks(table(spark, texts), bench).collect()}
    assert got == {(i, i, 1.0) for i in range(6)}
