"""Macros of rule trees that stand for a list of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How deep definitions may nest.
DEEPEST = 8


def definitions(texts: DataFrame) -> DataFrame:
    """(name, tokens) of symbol lists in macro files (file, text); statement templates are left
    out, of a name defined twice the first counts."""
    parts = F.split("text", r"(?m)^define\(`")  # what stands before the first is no definition
    each = texts.select("file", F.posexplode(F.slice(parts, F.lit(2), F.size(parts) - 1)).alias("at", "part"))
    quoted = F.split(F.regexp_replace("part", r"^[^']*',\s*`", "\0"), "\0")  # empty, and from the body on
    each = each.where((F.size(quoted) == 2) & F.get(quoted, F.lit(1)).rlike(r"(?m)'\)\s*$") & ~F.col("part").startswith("'"))
    each = each.select("file", "at", F.substring_index("part", "'", 1).alias("name"), F.trim(F.get(F.split(F.get(quoted, F.lit(1)), r"(?m)'\)\s*$", 2), F.lit(0))).alias("body"))
    lists = each.where((F.col("body") != "") & ~F.contains("body", F.lit("$")) & ~F.contains("body", F.lit("(")))
    tokens = F.filter(F.split(F.regexp_replace("body", r"^[{}]+|[{}]+$", ""), r"\s+"), lambda t: t != "")
    return lists.groupBy("name").agg(F.min_by(tokens, F.struct("file", "at")).alias("tokens")).where("size(tokens) > 0")


def expand(defined: DataFrame) -> DataFrame:
    """(name, tokens) with nested lists put in place, in order. A list inside itself adds nothing."""
    inner = defined.select(F.col("name").alias("token"), F.col("tokens").alias("inside"))
    flat = defined.select("name", F.array("name").alias("seen"), F.posexplode("tokens").alias("at", "token")).withColumn("at", F.array("at"))
    for _ in range(DEEPEST):
        within = flat.where(~F.array_contains("seen", F.col("token"))).join(inner, "token", "left")
        parts = F.coalesce(F.transform("inside", lambda t, i: F.struct(F.concat("at", F.array(i)).alias("at"), t.alias("token"), F.concat("seen", F.array("token")).alias("seen"))),
                           F.array(F.struct(F.col("at"), F.col("token"), F.col("seen"))))
        flat = within.select("name", F.explode(parts).alias("p")).select("name", "p.seen", "p.at", "p.token")
    out = flat.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens"))
    return defined.select("name").join(out, "name", "left").select("name", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def put_in(tokens: DataFrame, expanded: DataFrame, column: str) -> DataFrame:
    """Rows (.., column: list of symbols, each perhaps with a minus) with macro names replaced."""
    keyed = tokens.withColumn("_row", F.monotonically_increasing_id())
    each = keyed.select("_row", F.posexplode(column).alias("at", "t")).withColumn("minus", F.when(F.col("t").startswith("-"), "-").otherwise(""))
    each = each.withColumn("name", F.regexp_replace("t", "^-", "")).join(expanded.withColumnRenamed("tokens", "inside"), "name", "left")
    each = each.withColumn("parts", F.transform(F.coalesce("inside", F.array("name")), lambda p: F.concat("minus", p)))
    lists = each.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "parts"))), lambda x: x["parts"])).alias("_new"))
    return keyed.join(lists, "_row", "left").withColumn(column, F.coalesce("_new", F.slice(column, 1, 0))).drop("_row", "_new")
