"""Transitive closure of type memberships as a fixed point of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Computes a frame that a plan reads several times, once: by a checkpoint in the session's
    shared folder, or in memory where no folder is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where:
            sc.setCheckpointDir(where)
    return df.checkpoint() if sc.getCheckpointDir() is not None else df.cache()


def ancestors(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(name, token): every attribute reachable from a name along (child, parent) edges, the name
    itself left out; cycles are safe.

    Path lengths double each round, so that a chain of depth d takes log2(d) rounds; every round
    is checkpointed, which bounds the lineage.
    """
    reach = edges.select(F.col("child").alias("name"), F.col("parent").alias("token")).distinct()
    size = -1
    for _ in range(most_rounds):
        reach = settle(reach)
        now = reach.count()
        if now == size:
            break
        size = now
        further = reach.join(reach.select(F.col("name").alias("token"), F.col("token").alias("next")), "token").select("name", F.col("next").alias("token"))
        reach = reach.union(further).distinct()
    return reach.where("name <> token")


def member_counts(edges: DataFrame) -> DataFrame:
    """(token, members): how many names hold an attribute directly."""
    return edges.groupBy(F.col("parent").alias("token")).agg(F.count_distinct("child").alias("members"))
