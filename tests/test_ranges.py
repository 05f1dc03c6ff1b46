"""Ranges in bins against sets of numbers."""

import random

from denialkit.plans.ranges import complement, held, merged


def test_ranges(spark):
    rng = random.Random(4)
    rows = [(k, lo, lo + rng.choice((-1, 0, 1, 5, 300, 70000))) for k in range(3) for lo in rng.choices(range(0, 66000), k=12)] + [(9, 5, 5), (9, 6, 7), (9, 3_000_000_000, 4_200_000_000)]
    df = spark.createDataFrame(rows, "key long, lo long, hi long")

    def holds(k, n):
        return any(a == k and lo <= n <= hi for a, lo, hi in rows)

    edges = sorted({x + d for _, lo, hi in rows for x in (lo, hi) for d in (-1, 0, 1) if x + d >= 0})
    numbers = [(k, n) for k in (0, 1, 2, 9, 10) for n in edges]
    got = {tuple(r) for r in held(spark.createDataFrame(numbers, "key long, n long"), df, "key").collect()}
    assert got == {(k, n) for k, n in numbers if holds(k, n)}
    parts = sorted(tuple(r) for r in merged(df, "key").collect())
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(parts, parts[1:])) and (9, 5, 7) in parts
    rest = {tuple(r) for r in held(spark.createDataFrame([x for x in numbers if x[1] <= 0xFFFF], "key long, n long"), complement(df.where("key < 3"), "key"), "key").collect()}
    assert rest == {(k, n) for k, n in numbers if k < 3 and n <= 0xFFFF and not holds(k, n)}
