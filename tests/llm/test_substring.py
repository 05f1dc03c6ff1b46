import random
from collections import Counter

from denialkit.llm.substring_dedup import FingerprintIndex, occurrences, substring_dedup

from .fixtures import awkward, prose, table, words


def brute(texts):
    every = Counter()
    for t in texts:
        w = words(t)
        every.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = set()
    for i, t in enumerate(texts):
        w = words(t)
        gone = set()
        for k in range(len(w) - 34):
            if every[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        out.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring(spark):
    rng = random.Random(6)
    passages = prose(6, seed=2, least=34, most=90)
    texts = awkward() + prose(80, most=200)
    texts = [t if t is None or rng.random() < 0.4 else f"{t[: len(t) // 2]} {rng.choice(passages)}\n{t[len(t) // 2 :]}" for t in texts]
    for t in prose(6, seed=3, least=150, most=200):  # near copies, so that blocks differ around the edits
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "edit"
            texts.append("  ".join(w))
    texts += [texts[40]] * 3 + ["a b c d e " * 20, "x " * 34, "x " * 35, "x " * 36, "Y " * 35, "y " * 35]
    got = {tuple(r) for r in substring_dedup(table(spark, texts)).collect()}
    assert got == brute(texts)


def test_repeated_rows_and_empty(spark):
    one = table(spark, ["w%d " * 40 % tuple(range(40)), None, "short"])
    assert substring_dedup(one.limit(0)).count() == 0
    assert sorted(r.n_removed for r in substring_dedup(one).collect()) == [0, 0, 0]
    assert sorted(r.n_removed for r in substring_dedup(one.union(one)).collect()) == [0, 0, 0, 0, 40, 40]


def test_index_grows_by_batches(spark):
    texts = prose(12, least=60, most=90)
    index, hits = FingerprintIndex(spark, buckets=4), None
    for k in range(5):  # the last batch repeats the first
        batch = occurrences(table(spark, texts[3 * k : 3 * k + 3] if k < 4 else texts[:3]))
        assert (index.matches(batch).count() > 0) == (k == 4)
        own = index.append(batch)
        hits = own if hits is None else hits.union(own)
    assert len(index.runs) < 4
    assert index.repeated(hits).where("times = 2 and uniform").count() == occurrences(table(spark, texts[:3])).select("fp").distinct().count()
    index.drop()


def test_batches_do_not_matter(spark):
    """Five batches, each joined with the runs before it, give what one batch gives."""
    pool = prose(6, seed=23, least=60, most=90)
    around = prose(40, seed=24, least=20, most=60)
    texts = [f"{a} {pool[i % 6]} {a}" if i % 3 else a for i, a in enumerate(around)] + awkward()
    one, five = ({tuple(r) for r in substring_dedup(table(spark, texts), batches=k).collect()} for k in (1, 5))
    assert one == five and sum(r[2] > 0 for r in one) > 20
