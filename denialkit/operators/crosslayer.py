"""The application-layer view of a denial: which other domains have the access, and whose fix it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import apl_rank
from ..plans.access import answers, declared
from ..plans.closure import settle
from ..plans.verdict import AUTO
from ..sources.policy import Policy


def domains(entries: DataFrame) -> DataFrame:
    """(domain, levels, rank, debuggable): one row a domain; rank is its highest known level."""
    return entries.groupBy("domain").agg(F.array_sort(F.collect_set("apl")).alias("levels"), F.max(apl_rank(F.col("apl"))).alias("rank"), F.bool_or("debuggable").alias("debuggable"))


def debug_pairs(entries: DataFrame) -> DataFrame:
    """(domain, kind, other): the debug or release counterpart of each domain. Counterparts differ
    in the flag and agree on the sets of every other field; the first by name is taken."""
    sets = entries.groupBy("domain").agg(F.array_sort(F.collect_set("debuggable")).alias("flags"), *[F.array_sort(F.collect_set(c)).alias(c) for c in ("apl", "extra", "name", "extension")])
    single = sets.where(F.size("flags") == 1)
    other = single.select(F.col("domain").alias("other"), F.col("flags").alias("other_flags"), "apl", "extra", "name", "extension")
    found = single.join(other, ["apl", "extra", "name", "extension"]).where("domain <> other and flags <> other_flags").groupBy("domain").agg(F.min("other").alias("other"))
    out = sets.select("domain", (F.size("flags") > 1).alias("both")).join(found, "domain", "left")
    kind = F.when(F.col("both"), "same_domain").when(F.col("other").isNotNull(), "sibling").otherwise("none")
    return out.select("domain", kind.alias("kind"), F.when(F.col("both"), F.col("domain")).otherwise(F.coalesce("other", F.lit(""))).alias("other"))


def cross_layer(cases: DataFrame, policy: Policy, entries: DataFrame) -> DataFrame:
    """For cases (fp, src, query_tgt, cls, perms, allowed) of application domains: fix_layer (none,
    app, system), the domains that have the access, and the higher levels among them.

    A boundary between levels needs one known level of the subject's own and a higher level that
    is allowed. Domains that the policy does not declare cannot be asked.
    """
    table = settle(domains(entries))
    own = cases.join(table.withColumnRenamed("domain", "src"), "src")
    known = declared(policy).withColumnRenamed("name", "other")
    others = table.select(F.col("domain").alias("other"), F.col("levels").alias("other_levels"))
    # a platform declares a few dozen application domains at most
    each = own.select("fp", "src", F.col("query_tgt").alias("tgt"), "cls", "perms", "rank").crossJoin(F.broadcast(others)).where("other <> src").join(known, "other")
    asked = settle(each.withColumn("req", F.concat_ws("|", "fp", "other")))
    told = answers(asked.select("req", F.col("other").alias("src"), "tgt", "cls", "perms", F.lit(None).cast("string").alias("ioctl_cmd")), policy, policy.closure())
    yes = told.where("allowed").select("req").join(asked.select("req", "fp", "other", "other_levels", "rank"), "req")
    higher = F.filter("other_levels", lambda a: apl_rank(a) > F.col("rank"))
    found = yes.groupBy("fp").agg(F.array_sort(F.collect_set("other")).alias("allowing"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(higher)))).alias("higher"))
    out = own.join(found, "fp", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"allowing": F.coalesce("allowing", none), "higher": F.coalesce("higher", none)})
    boundary = (F.size("levels") == 1) & (F.col("rank") >= 0) & (F.size("higher") > 0)
    return out.withColumn("fix_layer", F.when(F.col("allowed"), "none").when(boundary, "app").otherwise("system"))


def summary(viewed: DataFrame) -> DataFrame:
    """(fix_layer, apl, cases)."""
    return viewed.select("fix_layer", F.explode("levels").alias("apl")).groupBy("fix_layer", "apl").agg(F.count("*").alias("cases"))


def app_clusters(decided: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: how many cases have an application domain as subject, and how many there are."""
    apps = entries.select(F.col("domain").alias("src")).where("src is not null").distinct().withColumn("app", F.lit(1))
    return decided.select("src").join(apps, "src", "left").agg(F.count("app").alias("app_cases"), F.count("*").alias("cases"))


def shared_patches(viewed: DataFrame) -> DataFrame:
    """(patch, src, tgt, cls, n, fix_layer): patches that may land unattended on a domain that all
    applications of a level share, those of the most denials first."""
    auto = viewed.where((F.col("category") == AUTO) & (F.col("patch") != ""))
    return auto.select("patch", "src", "tgt", "cls", "n", "fix_layer").orderBy(F.desc("n"), "patch")


def boundary_cases(viewed: DataFrame) -> DataFrame:
    """The cases that a higher level already has, and which so belong to the application's level."""
    return viewed.where("fix_layer = 'app'").select("src", "tgt", "cls", F.array_sort("perms").alias("perms"), "n", "patch", "category", "higher").orderBy(F.desc("n"), "src", "tgt", "cls")
