"""Compiled policies (CIL text): symbols, class permissions, memberships and granted access."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line is read as parentheses and words; words that name one symbol each, and the kind it has.
TOKEN = r"[()]|[^()\s]+"
SYMBOLS = {"class": "class", "type": "type", "typeattribute": "attribute", "typepermissive": "permissive"}


@dataclass
class Board:
    """What a device enforces. symbols (kind, name) of kinds class, type, attribute, permissive;
    class_perms (cls, perms) with inherited ones; edges (child, parent) memberships; allows (src,
    tgt, cls, perms) and xperms (src, tgt, cls, intervals), one row a key."""

    symbols: DataFrame
    class_perms: DataFrame
    edges: DataFrame
    allows: DataFrame
    xperms: DataFrame

    def names(self, *kinds: str) -> DataFrame:
        return self.symbols.where(F.col("kind").isin(*kinds)).select("name").distinct()


def read_cil(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def intervals(expression: Column) -> Column:
    """Command intervals (lo, hi) of an extended permission: ranges, single values, all."""
    return _intervals(_tokens(expression))


def _intervals(found: Column) -> Column:
    """The same from tokens: ``range`` takes the two numbers behind it, others stand for themselves."""
    hexadecimal = lambda t: t.rlike("^0x[0-9a-fA-F]+$")
    number = lambda t: F.conv(F.substring(t, 3, 16), 16, 10).cast("bigint")
    before = lambda i, n: F.coalesce(F.get(found, i - n) == "range", F.lit(False))
    lo = lambda t, i: F.when(t == "all", F.lit(0).cast("bigint")).when(hexadecimal(t) & ~before(i, 2), number(t))
    hi = lambda t, i: F.when(t == "all", F.lit(0xFFFFFFFF).cast("bigint")).when(before(i, 1), number(F.get(found, i + 1))).otherwise(number(t))
    each = F.transform(found, lambda t, i: F.struct(lo(t, i).alias("lo"), hi(t, i).alias("hi")))
    return F.filter(each, lambda x: x["lo"].isNotNull())


def parse_cil(lines: DataFrame) -> Board:
    """The board of CIL lines (line), one statement each. Rows of one access key are united. Set
    expressions (nested lists) name no members of their own."""
    # generators' outputs: filters on them are not moved below, where each mention would find the tokens again
    cut = lambda some: some.select(F.explode(F.array(_tokens(F.col("line")))).alias("t")).where("size(t) > 3 and t[0] = '('").select(
        "t", F.explode(F.array(F.array_remove(F.array_remove("t", "("), ")"))).alias("w"))
    token, word = lambda i: F.get("t", F.lit(i)), lambda i: F.get("w", F.lit(i))
    rest = lambda i: F.slice("w", F.lit(i + 1), F.greatest(F.size("w") - i, F.lit(0)))
    of = lambda kind: cut(lines.where(F.col("line").contains(kind))).where(word(0) == kind)
    united = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))
    kind = F.coalesce(*[F.when(word(0) == k, F.lit(v)) for k, v in SYMBOLS.items()])
    symbols = cut(lines).where(word(0).isin("class", "typepermissive") | (word(0).isin("type", "typeattribute") & (F.size("w") == 2))).select(kind.alias("kind"), word(1).alias("name")).distinct()
    listed = lambda k: of(k).where(token(3) == "(").select(word(1).alias("key"), rest(2).alias("names"))
    own = listed("class").groupBy(F.col("key").alias("cls")).agg(united("names").alias("own"))
    common = listed("common").groupBy(F.col("key").alias("common")).agg(united("names").alias("inherited"))
    binding = of("classcommon").select(word(1).alias("cls"), word(2).alias("common"))
    perms = own.join(binding, "cls", "left").join(common, "common", "left")
    none = F.array().cast("array<string>")
    perms = perms.groupBy("cls").agg(united(F.concat("own", F.coalesce("inherited", none))).alias("perms"))
    flat = (token(3) == "(") & (F.size(F.filter("t", lambda x: x == "(")) == 2)
    edges = of("typeattributeset").where(flat).select(F.explode(rest(2)).alias("child"), word(1).alias("parent")).distinct()
    allows = of("allow").where((token(4) == "(") & (token(6) == "(")).select(word(1).alias("src"), word(2).alias("tgt"), word(3).alias("cls"), rest(4).alias("names"))
    allows = allows.groupBy("src", "tgt", "cls").agg(united("names").alias("perms"))
    commands = of("allowx").where((token(4) == "(") & (token(5) == "ioctl") & (token(7) == "(")).select(word(1).alias("src"), word(2).alias("tgt"), word(4).alias("cls"), _intervals(F.col("t")).alias("some"))
    return Board(symbols, perms, edges, allows, commands.groupBy("src", "tgt", "cls").agg(F.flatten(F.collect_set("some")).alias("intervals")))
