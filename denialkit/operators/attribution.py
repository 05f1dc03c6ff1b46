"""Why an access is left to people: fifteen root causes, five owners, in a fixed order of proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_mls_level, is_placeholder
from ..plans.access import rule_hits
from ..plans.board import board_answers
from ..plans.closure import settle
from ..sources.cil import Board
from ..sources.policy import Policy

#: Root causes and who has to act on them.
OWNER = {
    "NEVERALLOW_REDLINE": "HUMAN", "LOG_MISSING_FIELD": "LOG", "LOG_FIELD_SHIFT": "LOG", "MALFORMED_LOG": "LOG", "UNKNOWN_OBJECT_CLASS": "LOG",
    "UNKNOWN_PERMISSION": "LOG", "UNRESOLVED_SERVICE_PLACEHOLDER": "TOOL", "BOARD_SYMBOL_ABSENT": "TOOL", "PERMISSIVE_DOMAIN": "NONE",
    "ALREADY_GRANTED_DIRECT": "NONE", "ALREADY_GRANTED_VIA_ATTR": "NONE", "DEVICE_LAGS_TREE": "TOOL", "BOARD_PARTIAL_GAP": "DEVICE",
    "PERMISSIVE_UNKNOWN": "LOG", "UNATTRIBUTED": "TOOL",
}


def owner(cause: Column) -> Column:
    return F.coalesce(*[F.when(cause == k, F.lit(v)) for k, v in OWNER.items()], F.lit("TOOL"))


def covering(cases: DataFrame, policy: Policy) -> DataFrame:
    """(req, cover_kind, cover_raw): the first allow rule, in policy order, that names every
    permission of a case; direct if both its sides name types only. Wildcards do not count."""
    hits = rule_hits(cases, policy, policy.closure()).where("kind = 'allow'").join(cases.select("req", "perms").withColumnRenamed("perms", "asked"), "req")
    first = hits.where(F.size(F.array_except("asked", "perms")) == 0).groupBy("req").agg(F.min(F.struct("rule_id", "raw")).alias("first"))
    sides = policy.rules.select("rule_id", F.explode(F.concat("src", "tgt")).alias("name"))
    wide = sides.join(policy.attributes, "name", "left_semi").select("rule_id").distinct().withColumn("wide", F.lit(True))
    out = first.select("req", "first.rule_id", F.col("first.raw").alias("cover_raw")).join(wide, "rule_id", "left")
    return out.select("req", F.when(F.col("wide"), "attr").otherwise("direct").alias("cover_kind"), "cover_raw")


def attribute(cases: DataFrame, policy: Policy, board: Board | None = None) -> DataFrame:
    """Adds root_cause, owner and board_missing to decided cases (fp, src, tgt, cls, perms,
    classification, why, n, n_unknown).

    Without a board only the shape of the log can be judged. Checks of a record's own sense come
    before any policy question: a record that names what the device does not have proves nothing
    about its policy.
    """
    cases = cases.withColumn("req", F.col("fp"))
    redline = F.col("classification") == "POTENTIAL_ESCALATION"
    if board is None:
        cause = F.when(redline, "NEVERALLOW_REDLINE").when(F.col("guard_reason").isNotNull() & (F.col("why") == F.col("guard_reason")), "MALFORMED_LOG")
        cause = cause.when((F.col("n") > 0) & (F.col("n_unknown") == F.col("n")), "PERMISSIVE_UNKNOWN").otherwise("UNATTRIBUTED")
        out = cases.withColumn("root_cause", cause)
        return out.withColumn("owner", owner(F.col("root_cause"))).withColumn("board_missing", F.array().cast("array<string>")).drop("req")
    cases = settle(cases)
    asked = cases.select("req", "src", "tgt", "cls", "perms")
    df = cases.join(board_answers(asked, board).select("req", "board_granted", "satisfied"), "req").join(covering(asked, policy), "req", "left")
    # the vocabulary of a device: some hundred classes and permission names, types by join
    sets = board.names("class").agg(F.collect_set("name").alias("_classes")).crossJoin(board.class_perms.agg(F.array_distinct(F.flatten(F.collect_list("perms"))).alias("_all")))
    df = df.crossJoin(F.broadcast(sets))
    df = df.join(board.class_perms.select(F.col("cls").alias("_cls"), F.col("perms").alias("_own")), F.col("cls") == F.col("_cls"), "left")
    for side in ("src", "tgt"):
        names = board.names("type", "attribute").select(F.col("name").alias(f"_{side}"))
        df = df.join(names, F.col(side) == F.col(f"_{side}"), "left")
    loose = board.names("permissive").select(F.col("name").alias("_loose"))
    df = df.join(loose, F.col("src") == F.col("_loose"), "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    either = lambda f: f(F.col("src")) | f(F.col("tgt"))
    vocabulary = F.array_union("_classes", "_all")
    steps = [
        (redline, "NEVERALLOW_REDLINE"), (blank("src") | blank("tgt") | blank("cls") | (F.size("perms") == 0), "LOG_MISSING_FIELD"),
        (either(lambda c: F.array_contains(vocabulary, c)), "LOG_FIELD_SHIFT"), (~F.array_contains("_classes", F.col("cls")), "UNKNOWN_OBJECT_CLASS"),
        (F.size(F.array_except("perms", F.coalesce("_own", F.array().cast("array<string>")))) > 0, "UNKNOWN_PERMISSION"), (either(is_mls_level), "MALFORMED_LOG"),
        (either(is_placeholder), "UNRESOLVED_SERVICE_PLACEHOLDER"), (F.col("_loose").isNotNull(), "PERMISSIVE_DOMAIN"), (F.col("_src").isNull() | F.col("_tgt").isNull(), "BOARD_SYMBOL_ABSENT"),
        (F.col("satisfied") & (F.col("cover_kind") == "direct"), "ALREADY_GRANTED_DIRECT"), (F.col("satisfied"), "ALREADY_GRANTED_VIA_ATTR"), (F.col("cover_kind").isNotNull(), "DEVICE_LAGS_TREE"),
    ]
    cause = F.when(*_step(steps[0]))
    for step in steps[1:]:
        cause = cause.when(*_step(step))
    df = df.withColumn("root_cause", cause.otherwise("BOARD_PARTIAL_GAP"))
    out = df.withColumn("owner", owner(F.col("root_cause"))).withColumn("board_missing", F.array_sort(F.array_except("perms", "board_granted")))
    return out.drop("req", "_classes", "_all", "_cls", "_own", "_src", "_tgt", "_loose")


def _step(step: tuple) -> tuple[Column, str]:
    return F.coalesce(step[0], F.lit(False)), step[1]


def report(attributed: DataFrame) -> DataFrame:
    """(root_cause, owner, cases, denials)."""
    return attributed.groupBy("root_cause", "owner").agg(F.count("*").alias("cases"), F.sum("n").alias("denials"))


def device_findings(attributed: DataFrame) -> DataFrame:
    """(src, cls, cases, denials, perms, targets) of what has to change on the device, largest first."""
    own = attributed.where("owner = 'DEVICE'").groupBy("src", "cls").agg(
        F.count("*").alias("cases"), F.sum("n").alias("denials"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("perms")))).alias("perms"), F.array_sort(F.collect_set("tgt")).alias("targets"))
    return own.orderBy(F.desc("denials"), "src", "cls")


def policy_axes(lines: DataFrame) -> DataFrame:
    """One row (booleans, constrains, mlsconstrains): statements of a compiled policy (line) that
    could deny an access which its rules allow."""
    at = lambda word: F.count_if(F.col("line").rlike(rf"^\({word} ")).alias(word + "s")
    return lines.agg(at("boolean"), at("constrain"), at("mlsconstrain"))
