import random
import re
import struct
from functools import lru_cache

import xxhash

from denialkit.llm.line_dedup import line_dedup, normal_lines, with_simhash

from .fixtures import awkward, prose, table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip(" ")


USED = sum(1 << i for i in range(64) if i % 8 < 4)


def block(hashes):
    return sum(1 << i for i in range(64) if USED >> i & 1 and 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@lru_cache(None)
def signature(norm):
    """The long words' hashes by class, and those of the short words, word by word."""
    classes, short = [[] for _ in range(6)], []
    for w in norm.split(" "):
        h = xxhash.xxh64_intdigest(w, seed=42)
        again = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=42)
        (short if len(w) < 4 else classes[(again - (again >> 63 << 64)) % 6]).append(h)
    return classes, short


@lru_cache(None)
def keys(norm):
    classes, short = signature(norm)
    f, out = sum(map(len, classes)), set()
    for q, c in enumerate(classes):
        if f >= 10 and len(c) >= 2:
            out.add(("one", q, block(c)))
    for q in range(3):
        c = classes[2 * q] + classes[2 * q + 1]
        if 7 < f <= 14 and len(c) >= 2:
            out.add(("two", q, block(c)))
        if f <= 9 and c:
            out.add(("both", q, block(c), block(short)))
    if f <= 7 and len(short) >= 4:
        out.add(("short", block(short)))
    return out


@lru_cache(None)
def blocks(norm):
    classes, short = signature(norm)
    return [block(c) for c in (*classes, short)]


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(blocks(a), blocks(b), strict=True))


def linked(a, b):
    most = max(len(a), len(b))
    if min(len(a), len(b)) < 9 or 10 * abs(len(a) - len(b)) > most:
        return False
    if most > 21 and not (keys(a) & keys(b) and apart(a, b) <= 60):
        return False
    return 10 * distance(a, b) <= most


def brute(spark, texts):
    lines = [(i, p, normal(line)) for i, t in enumerate(texts) for p, line in enumerate((t or "").split("\n"))]
    norms = sorted({n for *_, n in lines if n})
    comp = {n: n for n in norms}

    def root(n):
        while comp[n] != n:
            n = comp[n]
        return n

    for i, a in enumerate(norms):
        for b in norms[:i]:
            if linked(a, b):
                comp[root(a)] = root(b)
    kept, seen = {i: [] for i in range(len(texts))}, set()
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            n = normal(line)
            if not n or root(n) not in seen:
                kept[i].append(line)
                seen.add(root(n) if n else None)
    return {(i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept[i]), "\n".join(kept[i])) for i, t in enumerate(texts)}


def test_simhash(spark):
    """Against a count of every bit, one word at a time."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(300)] + [f"word{i}" for i in range(600)]
    norms = [" ".join(rng.choices(pool, k=k)) for k in (1, 2, 3, 7, 8, 63, 64, 126, 127, 128, 129, 1000, 32767, 32768, 40000)] + ["long " * 127 + "b", "a b " * 63 + "a", "a b"]
    rows = with_simhash(spark.createDataFrame([(i, n, n.count(" ") + 1) for i, n in enumerate(norms)], "id int, norm string, n_words int"), "id").collect()
    assert len(rows) == len(norms)
    for r in rows:
        classes, short = signature(norms[r.id])
        assert [r[f"b{c}"] & (2**64 - 1) for c in range(7)] == [block(c) for c in (*classes, short)]
        assert [r[f"j{q}"] & (2**64 - 1) for q in range(3)] == [block(classes[2 * q] + classes[2 * q + 1]) for q in range(3)]
        assert [r[f"k{c}"] for c in range(7)] == [len(c) for c in (*classes, short)]


def test_recall_by_edits_alone(spark):
    """Of lines that differ by a tenth of their characters at most, whatever the edits are, nine
    tenths are found."""
    rng = random.Random(15)
    lines, pairs = prose(60, seed=16, least=8, most=70), 0
    texts = []
    for line in lines:
        w = line.split()
        for _ in range(rng.randint(1, 3)):
            at, kind = rng.randrange(len(w)), rng.randrange(4)
            w[at : at + 1] = [[w[at] + "x"], [w[at], "and"], [rng.choice(lines).split()[0]], [w[at][::-1]]][kind]
        other = " ".join(w)
        if 10 * distance(normal(line), normal(other)) <= max(len(line), len(other)):
            texts.append(f"{line}\n{other}")
            pairs += normal(line) != normal(other)
    found = sum(r.n_removed for r in line_dedup(table(spark, texts)).collect())
    assert pairs > 30 and found >= 0.9 * pairs


def test_lines(spark):
    rng = random.Random(4)
    pool = prose(30, seed=8, least=30, most=60)
    variants = [p.replace(p.split()[3], p.split()[3] + "x", 1) for p in pool]
    texts = awkward() + ["\n".join(rng.choices(pool + variants + ["short", "", "Footer - all rights reserved 2024!"], k=rng.randint(1, 6))) for _ in range(80)] + [" ".join(pool) * 3, " ".join(pool[:4]), "Same word again " * 15000]
    got = {tuple(r) for r in line_dedup(table(spark, texts)).collect()}
    want = brute(spark, texts)
    assert got == want
    assert any(v != w for v, w in zip(variants, pool)) and sum(r[2] for r in want) > 100


def test_empty_and_repeated(spark):
    one = table(spark, ["a line of more than twenty characters\nb", None])
    assert line_dedup(one.limit(0)).count() == 0
    assert sorted(r.n_removed for r in line_dedup(one.union(one)).collect()) == [0, 0, 0, 0]


def test_normal_forms_make_no_array_of_words(spark):
    """Every line goes through this step."""
    lines = ["", " ", "Ab,c  D", "..x--Y9..", "na\u00efve \u6771\u4eac!", "\ttab\u00a0nbsp\r", "___", "a"]
    found = normal_lines(table(spark, ["\n".join(lines)]))
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.place: r.norm for r in found.collect()} == {i: n for i, x in enumerate(lines) if (n := normal(x))}
