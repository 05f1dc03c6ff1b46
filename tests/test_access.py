"""What requests meet rules by: equal to trying every pair, and how much of it is written to disk."""

import os
import random

import pytest
from pyspark.sql import functions as F

from denialkit import device_queries as engine
from denialkit.plans import access, profiles
from denialkit.plans.closure import ancestors
from denialkit.sources.policy import Policy

SF = "/root/testdata/sf0.01"


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    some = sc.statusStore().executorList(False)
    return sum(some.apply(i).totalShuffleWrite() for i in range(some.size()))


@pytest.mark.parametrize("name", ["o38_access_at_scale", "o45_board_access"])
def test_few_bytes_of_a_request_are_shuffled(spark, name):
    """Requests go by their target, by their names, and nowhere else; neither do keys or token lists of theirs."""
    tables = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("customer", "supplier", "part", "orders", "lineitem", "events"))
    start = shuffled(spark)
    engine.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    assert 0 < shuffled(spark) - start < 5 * tables


NAMES = [f"n{i}" for i in range(6)] + ["q0", "q1", "q2", "p0", "p1", "loose"]
EDGES = [("n0", "q0"), ("n1", "q0"), ("n2", "q1"), ("n3", "q1"), ("n3", "q2"), ("q0", "p0"), ("q1", "p0"), ("q2", "p1"), ("p1", "q2"), ("n0", "q0")]


def up(name):
    found, todo = {name}, [name]
    while todo:
        at = todo.pop()
        for parent in {p for c, p in EDGES if c == at} - found:
            found.add(parent)
            todo.append(parent)
    return found


def drawn(seed):
    """Rules (id, src, src_neg, src_star, tgt, tgt_neg, tgt_star, cls) and requests (req, src, tgt, cls)."""
    dice = random.Random(seed)
    # names come in any order, once each
    some = lambda most: dice.sample(NAMES, dice.choice([0, 1, 1, 1, most]))
    side = lambda: (some(3), some(2) if dice.random() < 0.3 else [], dice.random() < 0.15)
    rules = [(i, *side(), *side(), dice.choice("cde")) for i in range(90)]
    rules += [(90 + i, *r[1:]) for i, r in enumerate(rules[:15])]  # the same once more, with ids of their own
    name = lambda: dice.choice([*NAMES, "unknown", None])
    return rules, [(f"r{i}", name(), name(), dice.choice(["c", "d", "e", "x", None])) for i in range(150)]


def holds(names, neg, star, name):
    tokens = up(name) if name is not None else set()
    return (star or bool(tokens & set(names))) and not tokens & set(neg)


@pytest.mark.parametrize("most", [profiles.SMALL, 3, -1])
def test_hits_are_those_of_every_pair(spark, monkeypatch, most):
    """Whatever is few enough for a broadcast: stars, exclusions, several names, names that are ancestors, null and unknown names, equal rules."""
    monkeypatch.setattr(profiles, "SMALL", most)
    rules, requests = drawn(most)
    want = sorted((q, r[0]) for q, src, tgt, cls in requests for r in rules if cls == r[7] and holds(*r[1:4], src) and holds(*r[4:7], tgt))
    made = spark.createDataFrame(rules, "id int, src array<string>, src_neg array<string>, src_star boolean, tgt array<string>, tgt_neg array<string>, tgt_star boolean, cls string")
    none = F.array().cast("array<string>")
    made = made.select(F.struct(F.array(F.lit("f")).alias("path"), F.col("id").alias("line"), F.lit(0).cast("bigint").alias("sub")).alias("rule_id"), F.lit("allow").alias("kind"), *made.columns[1:],
                       none.alias("perms"), F.lit(None).cast("string").alias("xperm_perm"), none.alias("xperms"), F.lit("x").alias("raw"))
    policy = Policy(made, None, None, None, None)
    asked = spark.createDataFrame(requests, "req string, src string, tgt string, cls string")
    hits = access.rule_hits(asked, policy, ancestors(spark.createDataFrame(EDGES, "child string, parent string")))
    assert len(want) > 150 and sorted((h.req, h.rule_id.line) for h in hits.collect()) == want
