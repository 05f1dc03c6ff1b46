"""What a compiled policy grants: met as rules are, by names and by profiles, over access keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.cil import Board
from .access import STAR, attach
from .closure import ancestors, settle
from .ranges import held


def _with_keys_hit(requests: DataFrame, keys: DataFrame, board: Board, hit: Column) -> DataFrame:
    """Adds to requests (src, tgt, cls, ...) the list ``hits`` of the keys (src, tgt, cls, ...; each
    once) that answer each."""
    none, known = F.array().cast("array<string>"), keys.where((F.col("src") != STAR) & (F.col("tgt") != STAR))  # no name in a compiled policy
    rules = known.select("cls", F.array("src").alias("r_src"), F.array("tgt").alias("r_tgt"), none.alias("r_src_neg"), none.alias("r_tgt_neg"), hit.alias("hit"))
    return attach(requests, rules, ancestors(board.edges), single=True)


def board_hits(requests: DataFrame, keys: DataFrame, board: Board) -> DataFrame:
    """Rows of ``keys`` (src, tgt, cls, ...; each once) that answer each request (req, src, tgt,
    cls), through memberships on both sides."""
    told = F.struct(*[c for c in keys.columns if c not in ("src", "tgt", "cls")])
    return _with_keys_hit(requests.select("req", "src", "tgt", "cls"), keys, board, told).select("req", F.explode("hits").alias("hit")).select("req", "hit.*")


def board_answers(requests: DataFrame, board: Board) -> DataFrame:
    """Adds to (src, tgt, cls, perms, ...): board_granted, the union over all keys that answer, and
    satisfied, whether one key alone grants everything. An empty request is satisfied."""
    rows = _with_keys_hit(requests, settle(board.allows), board, F.col("perms"))
    one = F.coalesce(F.exists("hits", lambda given: F.size(F.array_except("perms", given)) == 0), F.lit(False))
    return rows.withColumns({"board_granted": F.sort_array(F.array_distinct(F.flatten("hits"))), "satisfied": one | (F.size("perms") == 0)}).drop("hits")


def board_commands(requests: DataFrame, board: Board) -> DataFrame:
    """Adds to (req, src, tgt, cls, commands) xperm_satisfied: one key's intervals hold every command
    (hex strings)."""
    rows = settle(board.xperms.withColumn("own", F.monotonically_increasing_id()))
    asked = requests.select("req", F.array_distinct(F.transform("commands", lambda c: F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("bigint"))).alias("all"))
    hits = settle(board_hits(requests, rows.drop("intervals"), board).select("req", "own").join(asked, "req"))
    ranges = rows.select("own", F.explode("intervals").alias("i")).select("own", F.col("i.lo").cast("bigint").alias("lo"), F.col("i.hi").cast("bigint").alias("hi"))
    found = held(hits.select("req", "own", F.explode("all").alias("n")), ranges, "own").groupBy("req", "own").agg(F.count_distinct("n").alias("found"))
    told = hits.join(found, ["req", "own"], "left").groupBy("req").agg(F.bool_or(F.coalesce("found", F.lit(0)) == F.size("all")).alias("xperm_satisfied"))
    return requests.join(told, "req", "left").withColumn("xperm_satisfied", F.coalesce("xperm_satisfied", F.lit(False)))
