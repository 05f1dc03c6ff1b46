"""From answers to decisions: classification, patch, review, verification, guards and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import IDENTIFIER, is_mls_level, is_placeholder, is_vacuous
from ..sources.denials import clusters, with_fingerprint
from ..sources.policy import Policy
from .access import answers, resolve_targets, rule_hits
from .closure import settle

AUTO, HUMAN, NOISE = "auto_repairable", "needs_human", "noise_or_already_allowed"

#: What reports say of each classification (src, tgt, cls and a list), of each guard (the name
#: that fired it), and as the reason of a bucket.
EXPLAIN = {
    "MISSING_RULE": "No rule lets %s use %s:%s with {%s}. If the access is wanted, grant these permissions and no others.",
    "XPERM_GAP": "%s may use ioctl on %s:%s, but command %s is missing from the list of allowed commands.",
    "POTENTIAL_ESCALATION": "A neverallow rule forbids what %s asks of %s:%s {%s}. No patch is offered; the design needs a second look.",
    "NOISE_OR_ALREADY_FIXED": "The rules already allow this access and the domain is permissive: an old or harmless record.",
    "DOMAIN_OR_LABEL_MISMATCH": "The rules allow this access, yet it was denied while enforcing: check the process domain and the object's label first.",
}
GUARDS = {
    "mls": "the target is a security level, not a type",
    "placeholder": "the target is a stand-in for a service whose own type is not known here",
    "unknown": "the policy does not know the name %s",
    "class": "no rule has the object class %s",
    "perm": "no rule has ever granted %s, which may be no permission at all",
    "vacuous": "the patch grants nothing",
}
WHY = {
    "POTENTIAL_ESCALATION": "forbidden by a neverallow rule", "NOISE_OR_ALREADY_FIXED": "already allowed",
    "DOMAIN_OR_LABEL_MISMATCH": "allowed by the rules but denied: domain or label", "MISSING_RULE": "smallest sufficient grant", "XPERM_GAP": "smallest sufficient grant",
}


def shown(c: Column | str) -> Column:
    """A name as texts show it; an absent one reads None."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("None"))


def classify(df: DataFrame) -> DataFrame:
    """Adds classification and missing (requested permissions that no rule grants, sorted)."""
    allowed, denied_cmd = F.col("allowed"), F.col("ioctl_allowed") == F.lit(False)
    label = F.when(F.col("n_neverallow") > 0, "POTENTIAL_ESCALATION").when(denied_cmd & (F.col("ioctl_reason") == "allowxperm"), "XPERM_GAP").when(denied_cmd, "MISSING_RULE")
    label = label.when(allowed & F.coalesce("permissive", F.lit(False)), "NOISE_OR_ALREADY_FIXED").when(allowed, "DOMAIN_OR_LABEL_MISMATCH").otherwise("MISSING_RULE")
    return df.withColumn("classification", label).withColumn("missing", F.array_sort(F.array_except("perms", "granted")))


def quick(answered: DataFrame) -> DataFrame:
    """Adds quick_category and quick_class to answered cases that need no patch: a neverallow hit,
    or an access that the rules allow whole. Both are null where a patch has to be considered."""
    stopped, denied = F.col("n_neverallow") > 0, F.col("ioctl_allowed") == F.lit(False)
    clear = F.col("allowed") & ~F.coalesce(denied, F.lit(False))
    calm = F.coalesce("permissive", F.lit(False))
    label = F.when(stopped, "POTENTIAL_ESCALATION").when(clear & calm, "NOISE_OR_ALREADY_FIXED").when(clear, "DOMAIN_OR_LABEL_MISMATCH")
    return answered.withColumns({"quick_class": label, "quick_category": F.when(label == "NOISE_OR_ALREADY_FIXED", NOISE).when(label.isNotNull(), HUMAN)})


def repair(df: DataFrame) -> DataFrame:
    """Adds patch: the smallest rule that closes the gap, empty where none is due."""
    head = F.concat(shown("src"), F.lit(" "), shown("tgt"), F.lit(":"), shown("cls"))
    allow = F.concat(F.lit("allow "), head, F.lit(" { "), F.array_join("missing", " "), F.lit(" };"))
    xperm = F.concat(F.lit("allowxperm "), head, F.lit(" ioctl { "), shown("ioctl_cmd"), F.lit(" };"))
    return df.withColumn("patch", F.when(F.col("classification") == "MISSING_RULE", allow).when(F.col("classification") == "XPERM_GAP", xperm).otherwise(""))


def candidates(df: DataFrame) -> DataFrame:
    """Adds candidates: (id, title, risk, draft) of each way to go, the recommended one in ``recommended``."""
    head = F.concat(shown("src"), F.lit(" "), shown("tgt"), F.lit(":"), shown("cls"))
    broad = F.concat(F.lit("allow "), head, F.lit(" { "), F.array_join(F.array_sort(F.array_union("perms", F.array(*map(F.lit, ("read", "write", "open"))))), " "), F.lit(" };"))
    option = lambda i, title, risk, draft: F.struct(F.lit(i).alias("id"), F.lit(title).alias("title"), F.lit(risk).alias("risk"), draft.alias("draft"))
    c = option("C", "change the domain, label or call path", "LOW-MEDIUM", F.lit(None).cast("string"))
    missing = F.array(option("A", "grant broadly", "HIGH", broad), option("B", "grant what is missing", "LOW", F.col("patch")), c)
    gap = F.array(option("B", "allow this ioctl command", "LOW", F.col("patch")), option("A", "allow every ioctl command", "MEDIUM-HIGH", F.concat(F.lit("allow "), head, F.lit(" { ioctl };"))), c)
    label = F.col("classification")
    best = F.when(label.isin("MISSING_RULE", "XPERM_GAP"), "B").when(label == "NOISE_OR_ALREADY_FIXED", "-").otherwise("C")
    return df.withColumn("candidates", F.when(label == "MISSING_RULE", missing).when(label == "XPERM_GAP", gap).otherwise(F.array(c))).withColumn("recommended", best)


def review_and_verify(df: DataFrame) -> DataFrame:
    """Adds review_status and verify_status of the patch.

    A generated patch grants exactly what is missing, so review can fail only on a star or on a
    neverallow of the raw target, and verification only where a name is no identifier; 
    ``tests/test_closed_form.py`` holds this against querying the patched policy.
    """
    none = F.col("patch") == ""
    starred = F.contains(F.col("patch"), F.lit("*")) & ~F.col("patch").startswith("allowxperm")
    review = F.when(none, "SKIP").when(starred | (F.col("raw_neverallow") > 0), "REJECT").otherwise("APPROVE")
    named = [F.coalesce(F.col(c).rlike(f"^{IDENTIFIER}$"), F.lit(False)) for c in ("src", "tgt", "cls")]
    df = df.withColumn("review_status", review)
    human = F.col("classification").isin("POTENTIAL_ESCALATION", "DOMAIN_OR_LABEL_MISMATCH")
    verify = F.when(none & human, "HUMAN_REVIEW_REQUIRED").when(none, "VERIFIED_AS_NOISE").when(F.col("review_status") != "APPROVE", "BLOCKED_BY_REVIEW")
    return df.withColumn("verify_status", verify.when(named[0] & named[1] & named[2], "SUCCESS").otherwise("FAILED"))


def guards(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds guard and guard_reason: why a patch must not land unattended; the first that fires."""
    rules = policy.rules
    known = policy.types.select("name").union(rules.select(F.explode("src"))).union(rules.select(F.explode("tgt"))).distinct()
    for side in ("src", "tgt"):
        names = known.select(F.col("name").alias(f"_{side}"))
        df = df.join(names, df[side] == names[f"_{side}"], "left")
    classes = rules.select(F.col("cls").alias("_cls")).distinct()
    df = df.join(classes, df["cls"] == classes["_cls"], "left")
    # permission names are a policy's vocabulary: one row of them
    perms = rules.where("kind in ('allow', 'neverallow')").select(F.explode("perms").alias("p")).agg(F.collect_set("p").alias("_perms"))
    df = df.crossJoin(F.broadcast(perms)).withColumn("_bogus", F.filter("logged", lambda p: ~F.array_contains("_perms", p)))
    guard = F.when(is_mls_level(F.col("tgt")), "mls").when(is_placeholder(F.col("tgt")), "placeholder").when(F.col("_src").isNull() | F.col("_tgt").isNull(), "unknown")
    guard = guard.when(F.col("_cls").isNull(), "class").when(F.size("_bogus") > 0, "perm").when(is_vacuous(F.col("patch")), "vacuous")
    df = df.withColumn("guard", guard)
    detail = F.when(F.col("guard") == "unknown", shown(F.when(F.col("_src").isNull(), F.col("src")).otherwise(F.col("tgt")))).when(F.col("guard") == "class", shown("cls")).otherwise(F.array_join("_bogus", ", "))
    reason = F.lit(None).cast("string")
    for name, text in GUARDS.items():
        reason = F.when(F.col("guard") == name, F.format_string(text, detail) if "%s" in text else F.lit(text)).otherwise(reason)
    return df.withColumn("guard_reason", reason).drop("_src", "_tgt", "_cls", "_perms", "_bogus")


def decide(cases: DataFrame, policy: Policy) -> DataFrame:
    """The whole decision for each distinct access: one row per ``cases`` row (fp, src, tgt, cls,
    perms, permissive, ioctl_cmd, service)."""
    closure = policy.closure()
    asked = settle(resolve_targets(cases.withColumn("logged", F.col("perms")), policy).withColumn("raw_tgt", F.col("tgt")))
    found = answers(asked.withColumn("tgt", F.col("query_tgt")).withColumn("req", F.col("fp")), policy, closure)
    # review looks at the target as logged, which differs for resolved placeholders only
    moved = asked.where(~F.col("query_tgt").eqNullSafe(F.col("raw_tgt"))).select(F.col("fp").alias("req"), "src", F.col("raw_tgt").alias("tgt"), "cls", F.array_distinct("perms").alias("asked"))
    hits = rule_hits(moved, policy, closure).where("kind = 'neverallow'").join(moved.select("req", "asked"), "req")
    again = hits.where((F.size("perms") == 0) | F.arrays_overlap("perms", "asked")).groupBy("req").agg(F.count("*").alias("moved_stops"))
    same = F.col("query_tgt").eqNullSafe(F.col("raw_tgt"))
    df = found.join(again, "req", "left").withColumn("raw_neverallow", F.when(same, F.col("n_neverallow")).otherwise(F.coalesce("moved_stops", F.lit(0)))).withColumn("tgt", F.col("raw_tgt")).drop("moved_stops", "raw_tgt", "req")
    df = guards(review_and_verify(repair(classify(df))), policy)
    patched = F.col("patch") != ""
    bucket = F.when(F.col("classification").isin("POTENTIAL_ESCALATION", "DOMAIN_OR_LABEL_MISMATCH"), HUMAN).when(F.col("classification") == "NOISE_OR_ALREADY_FIXED", NOISE)
    bucket = bucket.when(patched & (F.col("verify_status") == "SUCCESS"), AUTO).otherwise(HUMAN)
    df = df.withColumn("bucket", bucket)
    stopped = (F.col("bucket") == AUTO) & F.col("guard").isNotNull()
    why = F.coalesce(*[F.when(F.col("classification") == k, F.lit(v)) for k, v in WHY.items()])
    return df.withColumn("category", F.when(stopped, HUMAN).otherwise(F.col("bucket"))).withColumn("why", F.when(stopped, F.col("guard_reason")).otherwise(why))


def explain(decided: DataFrame) -> DataFrame:
    """Adds explanation: the decision in plain words."""
    lists = {"MISSING_RULE": F.when(F.size("missing") > 0, F.array_join("missing", ", ")).otherwise(shown("cls")), "XPERM_GAP": shown("ioctl_cmd"), "POTENTIAL_ESCALATION": F.array_join(F.array_sort("perms"), ", ")}
    text = F.lit("")
    for label, template in EXPLAIN.items():
        text = F.when(F.col("classification") == label, F.format_string(template, shown("src"), shown("tgt"), shown("cls"), lists[label]) if label in lists else F.lit(template)).otherwise(text)
    return decided.withColumn("explanation", text)


def converge(denials: DataFrame, policy: Policy) -> DataFrame:
    """Distinct accesses of parsed denials (with ``seq``), each decided once."""
    return settle(decide(clusters(with_fingerprint(denials)), policy))


def counts(decided: DataFrame) -> DataFrame:
    """(category, classification, cases, denials)."""
    return decided.groupBy("category", "classification").agg(F.count("*").alias("cases"), F.sum("n").alias("denials"))


def patch_lines(decided: DataFrame) -> DataFrame:
    """(patch, cases, denials) of the patches that may land unattended."""
    return decided.where(F.col("category") == AUTO).groupBy("patch").agg(F.count("*").alias("cases"), F.sum("n").alias("denials"))


def human_items(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("category") == HUMAN).select("fp", "n", "src", "tgt", "cls", F.array_sort("perms").alias("perms"), "classification", "review_status", "verify_status", "why", F.substring("raw", 1, 200).alias("sample"))
