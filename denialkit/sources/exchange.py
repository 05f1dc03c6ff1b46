"""The line format in which a policy index moves to a device: writing, reading, checking, comparing.

Fixed values are the line marks, the kind letters and the revision. The rules keep policy order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .policy import Policy

HEAD, REVISION = "PLI1", 2
LETTERS = {"a": "allow", "n": "neverallow", "x": "allowxperm", "z": "neverallowxperm"}
HAP = ("apl", "domain", "type", "debuggable", "name", "extension", "extra")
HAP_ORDER = ("domain", "apl", "debuggable", "name", "extension", "extra", "type")


def _join(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, "-").otherwise(F.array_join(parts, ","))


def _subject(side: str) -> Column:
    star = F.when(F.col(f"{side}_star"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    negative = F.array_sort(F.transform(f"{side}_neg", lambda n: F.concat(F.lit("-"), n)))
    return _join(F.concat(star, negative, F.array_sort(side)))


def rule_lines(rules: DataFrame) -> DataFrame:
    """(rule_id, line) of rules."""
    letter = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c)) for c, k in LETTERS.items()])
    xperm = F.concat(F.when(F.col("xperm_invert"), "~").otherwise(""), F.coalesce("xperm_perm", F.lit("")), F.lit(":"), F.array_join(F.array_sort("xperms"), ","))
    plain = F.when(F.size("perms") == 0, "*").otherwise(F.array_join(F.array_sort("perms"), ","))
    return rules.select("rule_id", F.concat_ws(" ", letter, "cls", _subject("src"), _subject("tgt"), F.when(F.col("kind").endswith("xperm"), xperm).otherwise(plain)).alias("line"))


def known_names(policy: Policy) -> DataFrame:
    """(name): declared types and what rules name on either side."""
    return policy.types.select("name").union(policy.rules.select(F.explode("src"))).union(policy.rules.select(F.explode("tgt"))).distinct()


def permission_names(rules: DataFrame) -> DataFrame:
    return rules.where("kind in ('allow', 'neverallow')").select(F.explode("perms").alias("name")).distinct()


def counters(policy: Policy, haps: DataFrame | None = None, hap_skipped: int = 0) -> DataFrame:
    """(at, item, n): what a file says about itself, in the order in which it says it."""
    rules = policy.rules
    kind = lambda k: rules.where(F.col("kind") == k)
    counted = [("rules", rules), *[(k, kind(k)) for k in ("allow", "neverallow", "allowxperm", "neverallowxperm")], ("types", policy.types.distinct()), ("attrs", policy.attributes.distinct()),
               ("classes", rules.select("cls").distinct()), ("perms", permission_names(rules)), ("known", known_names(policy)), ("skipped", policy.skipped)]
    if haps is not None:
        counted += [("hap_entries", haps), ("hap_domains", haps.select("domain").distinct()), ("hap_names", haps.where("name <> ''").select("name").distinct()), ("hap_apls", haps.select("apl").distinct()), ("hap_debuggable", haps.where("debuggable"))]
    else:
        counted += [(k, rules.limit(0)) for k in ("hap_entries", "hap_domains", "hap_names", "hap_apls", "hap_debuggable")]
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("at"), F.lit(k).alias("item"), "n") for i, (k, df) in enumerate(counted)]
    return reduce(DataFrame.union, rows).union(rules.sparkSession.range(1).select(F.lit(len(rows)), F.lit("hap_skipped"), F.lit(hap_skipped).cast("bigint")))


def export_lines(policy: Policy, label: str = "index", made: str = "", haps: DataFrame | None = None, hap_skipped: int = 0, note: str = "") -> DataFrame:
    """(section, key, line): the file's lines; ordered by section and key they are the file.

    ``key`` holds strings in byte order for names and the rule order for rules.
    """
    spark, own = policy.rules.sparkSession, "array<string>"

    def part(section: int, df: DataFrame, key: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast(own).alias("key"), line.alias("line"))

    one, none = spark.range(1), F.array().cast(own)
    meta = counters(policy, haps, hap_skipped).agg(F.array_sort(F.collect_list(F.struct("at", F.concat("item", F.lit("="), "n").alias("text")))).alias("items"))
    out = [part(0, one, none, F.lit(HEAD)), part(1, one, none, F.lit(f"@rev {REVISION}")), part(2, one, none, F.lit(f"@src {label} gen={made} exporter=denialkit")),
           part(3, meta, none, F.concat(F.lit("@meta "), F.array_join(F.col("items.text"), " ")))]
    if note:
        out.append(part(4, one, none, F.lit(f"@note {note}")))
    named = lambda section, mark, df: part(section, df, F.array("name"), F.concat(F.lit(mark + " "), "name"))
    classes = policy.rules.groupBy("cls").count()
    up = policy.types.select("name").distinct().join(policy.closure(), "name", "left").groupBy("name").agg(F.array_sort(F.collect_set("token")).alias("up"))
    out += [part(5, classes, F.array("cls"), F.concat_ws(" ", F.lit("@class"), "cls", "count")), part(6, up, F.array("name"), F.concat_ws(" ", F.lit("@type"), "name", F.array_join("up", " "))),
            named(7, "@attr", policy.attributes.distinct()), named(8, "@known", known_names(policy)), named(9, "@perm", permission_names(policy.rules))]
    out[-4] = out[-4].withColumn("line", F.rtrim("line"))
    if haps is not None:
        text = lambda c: F.when(F.col(c), "1").otherwise("0") if c == "debuggable" else F.when(F.col(c) == "", "-").otherwise(F.col(c))
        order = F.array(*[F.when(F.col(c), "1").otherwise("0") if c == "debuggable" else F.col(c) for c in HAP_ORDER])
        out.append(part(10, haps, order, F.concat_ws(" ", F.lit("@hap"), *map(text, HAP))))
    out.append(part(11, policy.rules.agg(F.count("*").alias("n")), none, F.concat(F.lit("@rules "), "n")))
    place = F.concat(F.col("rule_id.path"), F.array(F.lpad(F.col("rule_id.line").cast("string"), 12, "0"), F.lpad(F.col("rule_id.sub").cast("string"), 19, "0")))
    out.append(part(12, rule_lines(policy.rules), place, F.col("line")))
    return reduce(DataFrame.union, out)


def write_index(lines: DataFrame, path: str, compression: str = "none") -> None:
    """One text file: the index of a policy tree is some megabytes, and its reader wants one file."""
    lines.orderBy("section", "key").select("line").coalesce(1).write.option("compression", compression).text(path)


def numbered(texts: DataFrame) -> DataFrame:
    """(pos, line) of a whole file (text)."""
    return texts.select(F.posexplode(F.split("text", "\r\n|\n")).alias("pos", "line"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def import_policy(lines: DataFrame) -> Policy:
    """The policy of lines (pos, line). Its memberships are the written closure, so that closing
    them again changes nothing."""
    start = lines.where(F.col("line").startswith("@rules ")).agg(F.min("pos").alias("from"))
    body = lines.crossJoin(F.broadcast(start)).where((F.col("pos") > F.col("from")) & (F.col("line") != ""))  # start is one row
    f = F.split("line", " ")
    at = lambda i: F.get(f, F.lit(i))
    items = lambda i: F.filter(F.split(at(i), ","), lambda t: t != "")

    def side(i: int, name: str) -> list[Column]:
        t = F.when(at(i) == "-", F.array().cast("array<string>")).otherwise(items(i))
        plain, negative = F.filter(t, lambda x: (x != "*") & ~x.startswith("-")), F.transform(F.filter(t, lambda x: x.startswith("-")), lambda x: F.substring(x, F.lit(2), F.length(x)))
        return [plain.alias(name), negative.alias(f"{name}_neg"), F.array_contains(t, "*").alias(f"{name}_star")]

    kind = F.coalesce(*[F.when(at(0) == c, F.lit(k)) for c, k in LETTERS.items()])
    xperm, none = kind.endswith("xperm"), F.array().cast("array<string>")
    tail = F.regexp_replace(at(4), "^~", "")
    place = F.struct(F.array(F.lit("")).alias("path"), F.col("pos").cast("int").alias("line"), F.lit(0).cast("bigint").alias("sub"))
    perms = F.when(xperm | (at(4) == "*"), none).otherwise(items(4))
    commands = F.when(xperm, F.filter(F.split(F.regexp_replace(tail, "^[^:]*:", ""), ","), lambda t: t != "")).otherwise(none)
    rules = body.select(kind.alias("kind"), *side(2, "src"), *side(3, "tgt"), at(1).alias("cls"), perms.alias("perms"), F.when(xperm, F.regexp_extract(tail, "^([^:]*):", 1)).alias("xperm_perm"), commands.alias("xperms"),
                        (xperm & at(4).startswith("~")).alias("xperm_invert"), F.col("line").alias("raw"), place.alias("rule_id"))
    types = lines.where(F.col("line").startswith("@type ")).select(at(1).alias("name"), F.slice(f, 3, 1 << 20).alias("up"))
    edges = types.select(F.col("name").alias("child"), F.explode(F.filter("up", lambda t: t != "")).alias("parent"))
    attributes = lines.where(F.col("line").startswith("@attr ")).select(at(1).alias("name")).union(edges.select("parent")).distinct()
    return Policy(rules, edges, types.select("name"), attributes, lines.limit(0).select("line"))


def self_check(lines: DataFrame) -> DataFrame:
    """(item, said, found) of everything a file says about itself that its content does not bear
    out; empty for a sound file. A damaged head, revision or rule line is reported too."""
    policy = import_policy(lines)
    told = lines.where(F.col("line").startswith("@meta ")).select(F.explode(F.filter(F.split(F.substring("line", 7, 1 << 20), " "), lambda t: t != "")).alias("t"))
    told = told.select(F.split("t", "=")[0].alias("item"), F.split("t", "=")[1].cast("bigint").alias("said"))
    haps = lines.where(F.col("line").startswith("@hap ")).select(F.split("line", " ").alias("h")).select(*[F.col("h")[i + 1].alias(c) for i, c in enumerate(HAP)])
    haps = haps.withColumn("debuggable", F.col("debuggable") == "1").withColumn("name", F.when(F.col("name") == "-", "").otherwise(F.col("name")))
    real = counters(policy, haps).where("item not in ('skipped', 'hap_skipped')").select("item", F.col("n").alias("found"))
    out = [told.join(real, "item").where("said <> found").select("item", F.col("said").cast("string").alias("said"), F.col("found").cast("string").alias("found"))]
    word = lambda mark, df: lines.where(F.col("line").startswith(mark + " ")).select(F.substring("line", len(mark) + 2, 1 << 20).alias("v")).join(df.withColumnRenamed(df.columns[0], "w"), F.col("v") == F.col("w"), "full_outer").where("v is null or w is null").select(F.lit(mark).alias("item"), F.col("v").alias("said"), F.col("w").alias("found"))
    classes = policy.rules.groupBy("cls").count().select(F.concat_ws(" ", "cls", "count").alias("t"))
    out += [word("@known", known_names(policy)), word("@perm", permission_names(policy.rules)), word("@class", classes), word("@rules", policy.rules.agg(F.count("*").cast("string").alias("n")))]
    heads = F.when((F.col("pos") == 0) & (F.col("line") != HEAD), "head").when((F.col("pos") == 1) & (F.col("line") != f"@rev {REVISION}"), "revision")
    out.append(lines.select(heads.alias("item"), F.col("line").alias("said"), F.lit(None).cast("string").alias("found")).where("item is not null"))
    bad = policy.rules.where(F.col("kind").isNull() | (F.size(F.split("raw", " ")) != 5)).select(F.lit("rule").alias("item"), F.col("raw").alias("said"), F.lit(None).cast("string").alias("found"))
    return reduce(DataFrame.union, out).union(bad)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pos, old, new) of the lines in which two files (pos, line) differ, apart from the time of
    writing."""
    still = lambda df: df.select("pos", F.regexp_replace("line", r" gen=\S*", "").alias("line"))
    a, b = still(old).withColumnRenamed("line", "old"), still(new).withColumnRenamed("line", "new")
    return a.join(b, "pos", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def in_order(lines: DataFrame) -> DataFrame:
    """(pos, line) of exported lines. The window is one partition: an index is one file."""
    return lines.select((F.row_number().over(Window.orderBy("section", "key")) - 1).alias("pos"), "line")
