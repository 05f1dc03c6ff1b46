import hashlib
import random
from collections import defaultdict

import numpy as np

from denialkit.llm.common import Stored
from denialkit.llm.exact_dedup import exact_dedup
from denialkit.llm.linking import components
from denialkit.llm.near_dedup import FINE, FINE_AGREE, fine_sketch, near_dedup

from .fixtures import awkward, lower, near_copies, prose, table, words


def brute_near(rows, k=5):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    smallest = defaultdict(lambda: 10**9)
    for i in range(len(rows)):
        smallest[root(i)] = min(smallest[root(i)], rows[i][0])
    return {(rows[i][0], len(sets[i]), smallest[root(i)], rows[i][0] == smallest[root(i)]) for i in range(len(rows))}


def test_exact(spark):
    texts = awkward() + ["Copy Me"] * 5 + ["copy me"] * 3 + prose(200) + ["", None]
    got = {tuple(r) for r in exact_dedup(table(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    assert got == {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_repeated_rows_and_empty_table(spark):
    one = table(spark, ["t", "T", None])
    rows = exact_dedup(one.union(one)).collect()
    assert len(rows) == 6 and all(r.keep_id == (2 if r.doc_id == 2 else 1) and r.group_size == (2 if r.doc_id == 2 else 4) for r in rows)
    assert exact_dedup(one.limit(0)).count() == 0


def test_near(spark):
    rng = random.Random(3)
    base = prose(25, most=150, least=40)
    texts = awkward() + prose(60) + near_copies(base, rng, 12, 5) + [base[0]] * 40 + near_copies([prose(1, seed=9, least=140, most=150)[0]], rng, 150, 6)
    rng.shuffle(texts)
    got = {tuple(r) for r in near_dedup(table(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_near_repeated_rows_null_ids_and_empty_table(spark):
    one = table(spark, ["a b c d e f", "A b c d e f", None, "z"])
    rows = near_dedup(one.union(one).union(one.selectExpr("cast(null as bigint) as doc_id", "* except (doc_id)"))).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == sorted([(0, 0), (1, 0), (2, 2), (3, 3)] * 2)
    assert all(r.kept for r in rows if r.doc_id is None)
    assert near_dedup(one.limit(0)).count() == 0


def test_near_long_texts_with_an_empty_one_between(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = near_dedup(table(spark, [long, "", long + " end", long[: len(long) // 2]]).coalesce(1)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (2, 0, False), (3, 3, True)]


def test_fine_sketch_tells_linked_sets_from_others():
    rng, n = np.random.default_rng(8), 300
    most = int(2 * FINE * (1 - FINE_AGREE) / 2)

    def apart(common, own):
        sets = [np.sort(rng.integers(0, 1 << 63, common + 2 * own).astype(np.uint64)) for _ in range(n)]
        halves = [x for s in sets for p in [rng.permutation(s)] for x in (p[: common + own], np.concatenate([p[:common], p[common + own :]]))]
        bits = np.unpackbits(fine_sketch(np.cumsum([0] + [len(x) for x in halves]), np.concatenate(halves)), axis=1)
        return (bits[::2] != bits[1::2]).sum(1)

    assert (apart(120, 20) <= most).all()  # 0.75
    assert (apart(96, 32) > most).mean() > 0.95  # 0.6
    assert (apart(1, 0) == 0).all()


def test_components_take_few_jobs(spark):
    """Each job's exchanges hold threads and memory of the driver for a while."""
    edges = [(i, i + 1 + i % 7) for i in range(3000)]
    smallest = list(range(3007))
    for _ in range(2):  # edges lead upwards, so a second pass carries what the first left
        for a, b in [*edges, *edges[::-1]]:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    spark.sparkContext.setJobGroup("components", "components")
    try:
        got = {tuple(r) for r in components(Stored(spark), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(i, smallest[i]) for i in {x for e in edges for x in e}}
    assert jobs <= 40
