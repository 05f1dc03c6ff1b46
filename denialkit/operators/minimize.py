"""Patch minimisation: one rule per subject, target and class, its reach, and a closing check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.access import answers, rule_hits, with_rules
from ..plans.closure import member_counts, settle
from ..sources.policy import Policy, parse_rules


def parse_patches(lines: DataFrame) -> DataFrame:
    """Adds kind, src, tgt, cls, perms to (patch, ...); kind is null for lines of another shape."""
    w = F.split(F.trim("patch"), " ")
    word, brace = lambda i: F.get(w, F.lit(i)), F.array_position(w, "{")
    kind = F.when((word(0) == "allow") & (brace == 4), "allow").when((word(0) == "allowxperm") & (brace == 5), "allowxperm")
    object_ = F.split(word(2), ":")
    shaped = (F.element_at(w, -1) == "};") & (word(1) != "") & (F.size(object_) == 2) & ~F.array_contains(object_, "")
    inside = F.slice(w, (brace + 1).cast("int"), F.greatest(F.size(w) - brace.cast("int") - 1, F.lit(0)))
    kind = F.when(shaped & ~F.exists(inside, lambda x: F.contains(x, F.lit("}"))), kind)
    perms = F.when(kind.isNotNull(), F.array_sort(F.array_distinct(F.filter(inside, lambda x: x != ""))))
    given = lambda c: F.when(kind.isNotNull(), c)
    return lines.withColumns({"kind": kind, "src": given(word(1)), "tgt": given(F.get(object_, F.lit(0))), "cls": given(F.get(object_, F.lit(1))), "perms": perms})


def render_rule(kind: Column, src: Column, tgt: Column, cls: Column, perms: Column) -> Column:
    head = F.concat(src, F.lit(" "), tgt, F.lit(":"), cls)
    return F.when(kind == "allowxperm", F.concat(F.lit("allowxperm "), head, F.lit(" ioctl { "), F.array_join(perms, " "), F.lit(" };"))).otherwise(F.concat(F.lit("allow "), head, F.lit(" { "), F.array_join(perms, " "), F.lit(" };")))


def level(pairs: Column) -> Column:
    return F.when(pairs == 1, "low").when(pairs <= 16, "medium").otherwise("high")


def fanout(df: DataFrame, policy: Policy, *names: str) -> DataFrame:
    """Adds <name>_reach: members that hold the attribute directly, or 1 for a type."""
    reach = policy.attributes.withColumnRenamed("name", "token").join(member_counts(policy.edges), "token", "left").select("token", F.coalesce("members", F.lit(0)).alias("members"))
    for n in names:
        own = reach.select(F.col("token").alias("_t"), F.col("members").alias(f"{n}_reach"))
        df = df.join(own, df[n] == own["_t"], "left").drop("_t").withColumn(f"{n}_reach", F.coalesce(f"{n}_reach", F.lit(1)))
    return df


def collapse(patches: DataFrame) -> DataFrame:
    """One rule per (kind, src, tgt, cls) of patch lines (patch, cases, denials): permissions are
    united, counts added, ``lines`` says how many lines met."""
    grouped = parse_patches(patches).where("kind is not null").groupBy("kind", "src", "tgt", "cls").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("perms")))).alias("perms"), F.sum("cases").alias("cases"), F.sum("denials").alias("denials"), F.count("*").alias("lines"))
    return grouped.withColumn("text", render_rule(*map(F.col, ("kind", "src", "tgt", "cls", "perms"))))


def unparsed(patches: DataFrame) -> DataFrame:
    """The patch lines of a shape that ``collapse`` cannot read, so that none goes unseen."""
    return parse_patches(patches).where("kind is null").select(patches.columns)


def blast(rules: DataFrame, policy: Policy) -> DataFrame:
    """Adds pairs, grants and level: how many concrete accesses a rule creates."""
    out = fanout(rules, policy, "src", "tgt").withColumn("pairs", F.col("src_reach") * F.col("tgt_reach"))
    return out.withColumn("grants", F.col("pairs") * F.greatest(F.size("perms"), F.lit(1))).withColumn("level", level(F.col("pairs")))


def rule_reach(policy: Policy) -> DataFrame:
    """(rule_id, reach): concrete pairs that a rule reaches through its named subjects and targets."""
    sides = []
    for side in ("src", "tgt"):
        each = fanout(policy.rules.select("rule_id", F.explode(side).alias("token")), policy, "token")
        sides.append(each.groupBy("rule_id").agg(F.sum("token_reach").alias(f"{side}_sum")))
    both = policy.rules.select("rule_id").join(sides[0], "rule_id", "left").join(sides[1], "rule_id", "left")
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(F.col(c))
    return both.select("rule_id", (one("src_sum") * one("tgt_sum")).alias("reach"))


def fold(rules: DataFrame, policy: Policy) -> DataFrame:
    """Adds fold_into, fold_adds and fold_level: the narrowest allow rule that already answers a
    new allow rule's subject and target, and what extending it would add and reach."""
    asked = rules.where("kind = 'allow'").withColumn("req", F.col("text"))
    hits = rule_hits(asked, policy, policy.closure()).where("kind = 'allow'").join(rule_reach(policy), "rule_id")
    best = hits.groupBy("req").agg(F.min_by(F.struct("raw", "perms", "reach"), F.struct("reach", "raw")).alias("best"))
    out = rules.join(best, rules["text"] == best["req"], "left").drop("req")
    return out.withColumns({"fold_into": F.col("best.raw"), "fold_adds": F.array_sort(F.array_except("perms", F.col("best.perms"))), "fold_level": F.when(F.col("best").isNotNull(), level(F.col("best.reach")))}).drop("best")


def closed_loop(cases: DataFrame, rules: DataFrame, policy: Policy) -> DataFrame:
    """Per case (fp, src, tgt, cls, perms, ioctl_cmd): solved before and after the rules apply.
    Cases that only ask for ioctl with a command count by the command, others by permissions.
    residual_missing are permissions that the rules still do not grant (a patch for a command says
    nothing of the others), residual_command a command that they still do not allow."""
    closure, asked = policy.closure(), cases.withColumn("req", F.col("fp")).select("req", "src", "tgt", "cls", "perms", "ioctl_cmd")
    added = settle(parse_rules(settle(rules.select(F.col("text").alias("statement")))))  # joined several times
    only = (F.size("perms") == 1) & F.array_contains("perms", "ioctl") & F.col("ioctl_allowed").isNotNull()
    ok = F.when(only, F.col("ioctl_allowed")).otherwise(F.col("allowed"))
    before = answers(asked, policy, closure).select("req", ok.alias("before"))
    rest = F.array_sort(F.array_except("perms", "granted")).alias("residual_missing")
    after = answers(asked, with_rules(policy, added), closure).select("req", ok.alias("after"), rest, F.when(~F.col("ioctl_allowed"), F.col("ioctl_cmd")).alias("residual_command"))
    return before.join(after, "req").withColumnRenamed("req", "fp")
