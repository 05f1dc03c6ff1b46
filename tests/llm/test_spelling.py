"""Spelling variants against distances computed between all words, and against its SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from denialkit.llm import spelling_variants as sv

from .fixtures import awkward, lower, table

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(a, b):
    """Whether one insertion, deletion or replacement makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def brute(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            p = h % len(run)
            n[run[:p] + run[p + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(a, key=lambda x: (-n[x], x)) for w, a in around.items() if a}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n}


def texts(seed=7):
    """Words with chains of variants, doubled letters, letters above ASCII and ties."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("aabcdéßÿ×", k=rng.randint(4, 8))) for _ in range(60)] + ["lllll", "llllll", "lllllll", "Élan" * 3, "ÀÀÀÀÀ"]
    pool = []
    for s in stems:
        w, many = s, 40
        for _ in range(4):
            pool += [w] * many
            p, many = rng.randrange(len(w)), max(3, many // rng.choice((1, 2, 3)))
            w = rng.choice((w[:p] + w[p + 1 :], w[:p] + rng.choice("abcdé") + w[p:], w[:p] + rng.choice("abcdé") + w[p + 1 :])) or w
    rng.shuffle(pool)
    return [rng.choice((" ", "-", "7", "œ")).join(pool[i : i + 30]) for i in range(0, len(pool), 30)]


def rows(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    every = awkward() + texts()
    got = rows(sv.spelling_variants(table(spark, every).repartition(5)))
    assert got == brute(enumerate(every))
    assert any(r[1] and r[2] != r[1] for r in got) and any(r[4] > 3 for r in got)  # chains, and words with several neighbours


def test_very_long_words_and_small_blocks(spark, monkeypatch):
    """Runs longer than what is checked together, and neighbourhoods in several blocks."""
    monkeypatch.setattr(sv, "CANDIDATES", 700)
    rng = random.Random(2)
    one = "".join(rng.choices("abcdef", k=300))
    every = [f"{one} {one}", f"{one} {one[:100]}x{one[100:]}", f"{one[:250]}{one[251:]} " * 3, f"{one[:100]}x{one[100:]} " * 2 + one[:100] + "x" + one[100:], *texts()[:3]]
    assert rows(sv.spelling_variants(table(spark, every))) == brute(enumerate(every))


def test_awkward_tables(spark):
    docs = table(spark, texts()[:6] + awkward())
    assert sv.spelling_variants(docs.limit(0)).count() == 0
    assert sv.spelling_variants(table(spark, [None, "", "one two", "œĀ" * 9])).count() == 0
    null = docs.selectExpr("cast(null as bigint) as doc_id", "text", "text as word", "1 as n")
    assert rows(sv.spelling_variants(null)) == brute((None, r.text) for r in null.collect())
    assert rows(sv.spelling_variants(docs.union(docs))) == brute((r.doc_id, r.text) for r in docs.union(docs).collect())


def test_checksums_continue():
    rng = random.Random(5)
    words = [bytes(rng.choices(range(97, 123), k=k)) for k in [1, 5, 63, 64, 65, 200, 1000]]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    state = np.array([zlib.crc32(b"12:")] * len(words), np.uint32)
    got = sv.checksums(data, end - [len(w) for w in words], end, state)
    assert got.tolist() == [zlib.crc32(b"12:" + w) for w in words]


def test_sql(spark):
    every = texts(8) + awkward()
    con = duckdb.connect()
    con.register("d", pa.table({"doc_id": list(range(len(every))), "text": every}))
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    want = {tuple(r) for r in con.execute(sv.ORACLE).fetchall()}
    assert rows(sv.spelling_variants(table(spark, every))) == want
