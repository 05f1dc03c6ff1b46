"""Connected groups from shared buckets, without listing all pairs of a bucket.

Members of a bucket are first compared with its smallest member. Only where a bucket still holds
several connected groups are the members outside its largest group compared with the members of
other groups; members already connected need no comparison, so no connection is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored


#: Rows (pairs of longs) up to which a table of nodes is broadcast, so that its joins need no shuffle:
#: each exchange holds a thread of the driver for a minute. Pointers followed at a time there.
FEW, HOPS = 1 << 17, 3


def components(store: Stored, edges: DataFrame, level: int = 0) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): comp is the smallest node reachable.

    Each node hooks to its smallest neighbour, pointers are followed until they end at roots, and
    the graph of roots is solved the same way; it has at most half the nodes.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    at = store.put(f"parent{level}", both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")))
    few = at.count() <= FEW
    small = F.broadcast if few else (lambda x: x)
    while True:
        up, jumped = small(at.select(F.col("node").alias("comp"), F.col("comp").alias("top"))), at
        for _ in range(HOPS if few else 1):
            jumped = jumped.join(up, "comp").select("node", F.col("top").alias("comp"), (F.col("top") < F.col("comp")).alias("moved"))
        jumped = store.put(f"jump{level}", jumped)
        at = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    a, b = small(at.select(F.col("node").alias("a"), F.col("comp").alias("x"))), small(at.select(F.col("node").alias("b"), F.col("comp").alias("y")))
    rest = store.put(f"roots{level}", edges.select("a", "b").join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if rest.isEmpty():
        return at
    top = components(store, rest, level + 1).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return store.put(f"comp{level}", at.join(small(top), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))


#: Members of a bucket for each part into which its comparisons are split, and how many of a bucket's
#: largest group the members outside of it first meet, round by round.
PART, TURNS = 512, (1, 3)


def bucket_links(
    store: Stored, members: DataFrame, sigs: DataFrame, near: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame], DataFrame] | None = None, possible: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """(node, comp) of all nodes that a verified link connects to another node.

    members: (key, node). sigs: (node, sig), a short signature of each node. near: a cheap test of
    two signatures. verify: keeps those of the pairs (a, b) that are links. refine: gives the
    remaining nodes (node) bounds (node, bound); possible: whether the bounds of two nodes of a
    bucket allow a link, which must hold in one of their common buckets for every link.
    """
    left, right = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    close = lambda pairs: pairs.join(left, "a").join(right, "b").where(near(F.col("sa"), F.col("sb"))).select("a", "b")

    def joined(edges: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """The components, and how their table is joined with others."""
        comp = components(store, edges)
        return comp, F.broadcast if comp.count() <= FEW else (lambda x: x)

    centers = members.groupBy("key").agg(F.min("node").alias("c"), F.max("node").alias("x")).where("c < x").select("key", "c")
    shared = store.put("shared", members.join(centers, "key"))
    # most nodes connect through the smallest of their centers, and need no other comparison then
    stars = shared.where("node > c").groupBy(F.col("node").alias("b")).agg(F.min("c").alias("a")).select("a", "b")
    stars = store.put("stars", close(stars))
    edges = store.put("edges", verify(stars).select("a", "b").distinct())
    comp, small = joined(edges)
    others = shared.where("node > c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
    for c in ("a", "b"):
        others = others.join(small(comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}c"))), c, "left").withColumn(f"{c}c", F.coalesce(f"{c}c", c))
    others = store.put("others", close(others.where("ac <> bc").select("a", "b").join(stars, ["a", "b"], "left_anti")))
    if not others.isEmpty():
        second = store.put("edges2", verify(others).select("a", "b").distinct())
        edges, stars = edges.union(second), stars.union(others)
        comp, small = joined(edges)

    def by_group() -> tuple[DataFrame, DataFrame]:
        """Members with their groups, and the largest group of each bucket that holds several."""
        labelled = store.put("labelled", shared.join(small(comp), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")))
        mains = labelled.groupBy("key", "comp").count().groupBy("key").agg(
            F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("n"), F.ceil(F.sum("count") / PART).alias("parts")).where("n > 1").drop("n")
        return labelled, store.put("mains", mains)

    # members outside the largest group meet a few of its members, which connects most of them; only
    # what is left then is compared with all
    labelled, mains = by_group()
    met = 0
    for many in TURNS:
        if mains.isEmpty():
            return comp
        mixed = labelled.join(mains.select("key", "main"), "key")
        turns = [F.struct(F.lit(t).alias("turn"), F.xxhash64("node", F.lit(t)).alias("h")) for t in range(met, met + many)]
        met += many
        inside = mixed.where("comp = main").select("key", "node", F.inline(F.array(*turns)))
        centers = inside.groupBy("key", "turn").agg(F.min(F.struct("h", "node")).alias("c"))
        found = mixed.where("comp <> main").select("key", F.col("node").alias("r")).join(centers, "key").groupBy("r", "turn").agg(F.min("c").alias("c"))
        pairs = found.select(F.least("r", "c.node").alias("a"), F.greatest("r", "c.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
        pairs = store.put(f"turn{met}", close(pairs))
        more = store.put(f"met{met}", verify(pairs).select("a", "b").distinct())
        edges, stars = edges.union(more), stars.union(pairs)
        if more.isEmpty():
            break
        comp, small = joined(edges)
        labelled, mains = by_group()
    if mains.isEmpty():
        return comp
    mixed = store.put("mixed", labelled.join(mains, "key").join(sigs, "node"))
    if refine is not None:
        mixed = mixed.join(refine(store.put("nodes", mixed.select("node").distinct())), "node")
    else:
        mixed = mixed.withColumn("bound", F.lit(0))
    # the members outside the largest group are dealt to the parts of their bucket, all others to each
    rest = mixed.where("comp <> main").select("key", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.col("node").alias("r"), F.col("comp").alias("rc"), F.col("sig").alias("rs"), F.col("bound").alias("rb"))
    every = mixed.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "node", "comp", "main", "sig", "bound")
    apart = (F.col("rc") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("r") < F.col("node")))
    apart = apart & (near(F.col("rs"), F.col("sig")) if possible is None else possible(F.col("rb"), F.col("bound"), F.col("key")))
    more = rest.join(every, ["key", "part"]).where(apart).select(F.least("r", "node").alias("a"), F.greatest("r", "node").alias("b")).distinct()
    more = store.put("more", more.join(stars, ["a", "b"], "left_anti"))
    late = store.put("late", verify(more).select("a", "b").distinct())
    if not late.isEmpty():
        comp = components(store, edges.union(late))
    return comp
