"""Links at exactly nine tenths, and between short lines, by edit distance alone."""

import random

from denialkit.llm.line_dedup import line_dedup

from .fixtures import table
from .test_lines import distance


def removed(spark, lines):
    return line_dedup(table(spark, ["\n".join(lines)])).first().n_removed


def test_exactly_nine_tenths(spark):
    """One character of ten goes; the words, and so the SimHashes, are nearly all the same."""
    for n in (100, 200):
        words = ("ab" * (n // 10) + " " + "cd " * n)[: n - n // 10 - 1].strip().ljust(n - n // 10 - 1, "e")
        a, b = words + " " + "x" * (n // 10), words + " " + "y" * (n // 10)
        assert len(a) == n and distance(a, b) == n // 10
        assert removed(spark, [a, b]) == 1


def test_short_lines_against_brute_force(spark):
    rng = random.Random(12)
    pool = ["".join(rng.choices("abcd", k=rng.randint(8, 21))) for _ in range(60)]
    for x in pool[:60]:
        y = list(x)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "\u00e9"])
        pool.append("".join(y))
    pool += ["zyxwvutsr", "zyxwvutsrq", "mnopqrstuv", "mnopqrstux", "efghijklmnopqrstuv", "efghxijklmnopqrstyuv", "klmnopqrstuvwxyzefg", "klmnoapqrstuvwxyzbefg"]
    pool = list(dict.fromkeys(pool))
    comp = {x: x for x in pool}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = set()
    for i, a in enumerate(pool):
        for b in pool[:i]:
            if 10 * distance(a, b) <= max(len(a), len(b)):
                links.add((min(len(a), len(b)), max(len(a), len(b))))
                comp[root(a)] = root(b)
    assert {lo for lo, _ in links} >= {9, 10, 18, 19} and any(lo < 20 <= hi for lo, hi in links)
    texts = pool[:]
    rng.shuffle(texts)
    got = {r.doc_id for r in line_dedup(table(spark, texts)).collect() if r.n_removed}
    seen, want = set(), set()
    for i, x in enumerate(texts):
        if root(x) in seen:
            want.add(i)
        seen.add(root(x))
    assert got == want and len(want) > 20
