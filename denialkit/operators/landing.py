"""Whether patch lines can land on a device: gates against its compiled policy, and CIL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.board import board_answers, board_commands
from ..plans.closure import settle
from ..sources.cil import Board
from ..sources.policy import with_form


def gates(lines: DataFrame, board: Board) -> DataFrame:
    """Adds to (line): kind, src, tgt, cls, op, perms, gate and verdict.

    A line that is no allow rule stops at gate ``parse``, unknown names at ``symbols``, permissions
    that the class lacks at ``perms`` (all rejected), and what the device grants already at
    ``idempotent`` (already_satisfied); the rest is to emit. Equal lines are judged alike.
    """
    df = with_form(lines.withColumn("statement", F.trim("line")))
    at = lambda i: F.get("_t", F.lit(i))
    last = F.try_element_at("_t", F.lit(-1))
    shaped = F.col("form").isNotNull() & at(0).isin("allow", "allowxperm") & last.startswith("{") & F.col("statement").endswith(";") & ~at(1).startswith("{") & ~at(2).startswith("{")
    shaped = shaped & F.contains("statement", F.concat(at(2), F.lit(":"), at(4)))  # target and class are one word
    given = lambda c: F.when(shaped, c)
    names = F.filter(F.split(F.trim(last, F.lit("{}")), r"\s+"), lambda w: w != "")
    df = df.withColumns({"kind": given(at(0)), "src": given(at(1)), "tgt": given(at(2)), "cls": given(at(4)), "op": given(F.when(F.col("form") == "command", at(5)).otherwise("ioctl")), "perms": given(F.array_sort(F.array_distinct(names)))})
    df = df.drop("statement", "_t", "form")
    df = settle(df)
    for side in ("src", "tgt"):
        names = board.names("type", "attribute").select(F.col("name").alias(f"_{side}"))
        df = df.join(names, F.col(side) == F.col(f"_{side}"), "left")
    df = df.join(board.names("class").select(F.col("name").alias("_cls")), F.col("cls") == F.col("_cls"), "left")
    df = df.join(board.class_perms.select(F.col("cls").alias("_of"), F.col("perms").alias("_own")), F.col("cls") == F.col("_of"), "left")
    asked = df.where("kind is not null").select(F.col("line").alias("req"), "src", "tgt", "cls", "kind", "perms").distinct()
    plain = board_answers(asked.where("kind = 'allow'").drop("kind"), board).where("satisfied").select("req")
    cmds = board_commands(asked.where("kind = 'allowxperm'").select("req", "src", "tgt", "cls", F.col("perms").alias("commands")), board).where("xperm_satisfied").select("req")
    df = df.join(plain.union(cmds).select(F.col("req").alias("_held")), F.col("line") == F.col("_held"), "left")
    unknown = F.col("_src").isNull() | F.col("_tgt").isNull() | F.col("_cls").isNull()
    foreign = (F.col("kind") == "allow") & (F.size(F.array_except("perms", F.coalesce("_own", F.array().cast("array<string>")))) > 0)
    gate = F.when(F.col("kind").isNull(), "parse").when(unknown, "symbols").when(foreign, "perms").when(F.col("_held").isNotNull(), "idempotent")
    df = df.withColumn("gate", gate)
    verdict = F.when(F.col("gate").isNull(), "emit").when(F.col("gate") == "idempotent", "already_satisfied").otherwise("rejected")
    return df.withColumn("verdict", verdict).drop("_src", "_tgt", "_cls", "_of", "_own", "_held")


def render_cil(kind: Column, src: Column, tgt: Column, cls: Column, op: Column, perms: Column) -> Column:
    """A rule as a CIL statement; extended permissions name their class inside the operation."""
    names = F.array_join(F.array_sort(F.array_distinct(perms)), " ")
    xperm = F.concat(F.lit("(allowx "), src, F.lit(" "), tgt, F.lit(" ("), op, F.lit(" "), cls, F.lit(" ("), names, F.lit(")))"))
    return F.when(kind == "allowxperm", xperm).otherwise(F.concat(F.lit("(allow "), src, F.lit(" "), tgt, F.lit(" ("), cls, F.lit(" ("), names, F.lit(")))")))


def lost(before: Board, after: Board) -> DataFrame:
    """(src, tgt, cls, perms, intervals): access of one compiled policy that another no longer
    holds under the same key. A target that equals its source may be written ``self``."""

    def keyed(df: DataFrame) -> DataFrame:
        same = df.where("tgt = 'self'").withColumn("tgt", F.col("src"))
        return df.unionByName(same)

    none = F.array().cast("array<string>")
    held = keyed(after.allows).groupBy("src", "tgt", "cls").agg(F.array_distinct(F.flatten(F.collect_set("perms"))).alias("kept"))
    gone = before.allows.join(held, ["src", "tgt", "cls"], "left").withColumn("perms", F.array_sort(F.array_except("perms", F.coalesce("kept", none)))).where("size(perms) > 0")
    held_x = keyed(after.xperms).groupBy("src", "tgt", "cls").agg(F.flatten(F.collect_set("intervals")).alias("kept"))
    both = before.xperms.join(held_x, ["src", "tgt", "cls"], "left").withColumn("kept", F.coalesce("kept", F.slice("intervals", 1, 0)))
    # the kept intervals in order, so that one pass tells how far they reach without a hole
    order = F.array_sort(F.filter("kept", lambda k: k["lo"] <= k["hi"]))

    def covered(i: Column) -> Column:
        reach = F.aggregate(order, i["lo"], lambda at, k: F.when((k["lo"] <= at) & (k["hi"] >= at), k["hi"] + 1).otherwise(at))
        return reach > i["hi"]

    gone_x = both.withColumn("intervals", F.filter("intervals", lambda i: ~covered(i))).where("size(intervals) > 0")
    return gone.select("src", "tgt", "cls", "perms", F.lit(None).cast(before.xperms.schema["intervals"].dataType).alias("intervals")).unionByName(
        gone_x.select("src", "tgt", "cls", none.alias("perms"), "intervals"))
