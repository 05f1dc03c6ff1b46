import random

from denialkit.llm.decontaminate import common_in_order, leaks

from .fixtures import awkward, prose, table


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_in_order():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert common_in_order(a, b) == longest(a, b)


def test_leaks(spark):
    rng = random.Random(6)
    items = prose(12, seed=40, vocabulary=5000, least=20, most=60)
    clean = prose(150, seed=41, vocabulary=5000)
    whole = [f"{a} {i.upper()} {b}" for a, i, b in zip(clean[:12], items, clean[20:32], strict=True)]
    changed = []
    for a, i in zip(clean[40:52], items, strict=True):  # a tenth of the words replaced
        w = i.split()
        for p in rng.sample(range(len(w)), len(w) // 10):
            w[p] = "other"
        changed.append(f"{a} {' '.join(w)}")
    docs = table(spark, [*clean, *whole, *changed, *awkward()])
    bench = spark.createDataFrame([*enumerate(items), (77, None), (78, ""), (None, "x y z")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert got == {(150 + k, k % 12) for k in range(24)}
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
