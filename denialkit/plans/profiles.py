"""Names by what rules can tell apart: all names that rules' tokens treat alike share one number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import settle

#: The most rows that are broadcast; beyond that they shuffle.
SMALL = 500_000
#: The profile of names that have none of the tokens.
NONE = -1


def kept(df: DataFrame) -> DataFrame:
    """A frame that is computed once."""
    return settle(df)


def few(df: DataFrame, rows: int) -> DataFrame:
    """A frame of at most so many rows, broadcast if these are few."""
    return F.broadcast(df) if rows <= SMALL else df


def small(df: DataFrame) -> DataFrame:
    """A frame that is computed once, and broadcast if it has few rows."""
    df = kept(df)
    return few(df, df.count())


def profiles(closure: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ident, profile) of the names that have some of the tokens ``used`` (token; each once),
    themselves or by membership, and (profile, tokens) with those tokens in order. Other names are
    of ``NONE``."""
    own = used.select(F.col("token").alias("ident"), "token")
    every = closure.select(F.col("name").alias("ident"), "token").join(used, "token").select("ident", "token").unionByName(own)
    names = kept(every.groupBy("ident").agg(F.sort_array(F.collect_set("token")).alias("tokens")))
    rows = names.count()
    lists = kept(names.select("tokens").distinct().withColumn("profile", F.monotonically_increasing_id()))
    lists = few(lists, rows if rows <= SMALL else lists.count())
    return few(names.join(lists, "tokens").select("ident", "profile"), rows), lists
