"""Reports of decisions, as small frames of lines that any text sink can take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.verdict import AUTO, HUMAN, NOISE, candidates, counts, explain, human_items, patch_lines, shown


def totals(decided: DataFrame) -> DataFrame:
    """One row: clusters, denials, dedup_ratio, cases of each category, readiness."""
    of = lambda c, name: F.count_if(F.col("category") == c).alias(name)
    out = decided.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("denials"), of(AUTO, "auto_repairable"), of(HUMAN, "needs_human"), of(NOISE, "noise"))
    ratio = F.when(F.col("clusters") == 0, 0.0).otherwise(F.bround(F.col("denials") / F.col("clusters"), 4))
    ready = F.when(F.col("clusters") == 0, "no denials").otherwise(F.format_string("%d of %d cases can land unattended, %d need a human, %d need nothing", "auto_repairable", "clusters", "needs_human", "noise"))
    return out.withColumn("dedup_ratio", ratio).withColumn("readiness", ready)


def device_block(facts: dict[str, str]) -> Column:
    """Facts about the device as a struct for the head of a report."""
    return F.struct(*[F.lit(v).alias(k) for k, v in sorted(facts.items())])


def markdown(decided: DataFrame) -> DataFrame:
    """(section, key, line): the report's lines; ordered by section and key they are the text."""
    part = lambda name, df, key, line: df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), line.alias("line"))
    spark = decided.sparkSession
    title = lambda name, text: part(name, spark.range(1), F.lit(""), F.lit(f"## {text}"))
    t = totals(decided)
    out = part("0", t, F.lit(""), F.concat(F.lit("# Denials: "), "readiness"))
    rows = counts(decided)
    out = out.union(part("1", rows, F.concat_ws(" ", "category", "classification"), F.format_string("| %s | %s | %d | %d |", "category", "classification", "cases", "denials")))
    out = out.union(title("auto", "Patches")).union(part("auto", patch_lines(decided), F.col("patch"), F.format_string("- `%s` (%d cases, %d denials)", "patch", "cases", "denials")))
    items = human_items(decided)
    said = F.format_string("- %s → %s:%s {%s} ×%d: %s", F.coalesce("src", F.lit("None")), F.coalesce("tgt", F.lit("None")), F.coalesce("cls", F.lit("None")), F.array_join("perms", " "), "n", F.coalesce("why", F.lit("")))
    return out.union(title("human", "For people")).union(part("human", items, F.col("fp"), said))


def _told(decided: DataFrame) -> DataFrame:
    """Decisions with what both kinds of answers say of them."""
    d = explain(candidates(decided))
    names = {c: shown(c) for c in ("src", "tgt", "cls")}
    human = F.col("classification").isin("POTENTIAL_ESCALATION", "DOMAIN_OR_LABEL_MISMATCH")
    return d.withColumns({**names, "requested": F.array_sort(F.array_distinct("perms")), "granted": F.array_sort("granted"), "has_ioctl": F.col("ioctl_reason").isNotNull(), "human": human,
                          "quick": ~F.col("classification").isin("MISSING_RULE", "XPERM_GAP")})


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def explain_lines(decided: DataFrame) -> DataFrame:
    """(fp, line): the full answer to each denial as one JSON object of 15 keys, in their order.
    The guards speak on every record; where one fires its sentence stands for the title."""
    d = _told(decided)
    advisory = F.coalesce("guard_reason", F.lit(""))
    titles = F.filter("candidates", lambda c: c["id"] == F.col("recommended"))
    title = F.when(advisory != "", advisory).otherwise(F.coalesce(F.get(titles, F.lit(0))["title"], F.lit("")))
    fields = [advisory.alias("advisory"), F.col("classification"), F.col("cls"), F.col("explanation"), F.col("granted"), F.when(F.col("has_ioctl"), F.col("ioctl_cmd")).alias("ioctl"), F.col("missing"), F.col("human").alias("needs_human"), F.col("patch"),
              F.struct(F.col("recommended").alias("id"), title.alias("title")).alias("recommended"), F.col("requested"), F.col("review_status").alias("review"), F.col("src"), F.col("tgt"), F.col("verify_status").alias("verify")]
    return d.select("fp", _json(*fields).alias("line"))


def case_lines(decided: DataFrame) -> DataFrame:
    """(fp, line): the short answer to each case as one JSON object of 24 keys, in their order. A
    case that needs no patch is settled by its answers alone and has no review."""
    d = _told(decided)
    quick = F.col("quick")
    status = lambda c: F.when(quick, "").otherwise(F.col(c)).alias(c)
    stopped = (F.col("bucket") == AUTO) & F.col("guard").isNotNull()
    fields = [F.when(stopped, F.col("guard_reason")).otherwise("").alias("advisory"), F.col("allowed").alias("all_allowed"), (F.col("category") == AUTO).alias("auto_safe"), F.col("category"), F.col("classification"), F.col("cls"), F.col("granted"),
              (F.col("bucket") == AUTO).alias("guards_applied"), F.col("has_ioctl"), F.coalesce("ioctl_allowed", F.lit(False)).alias("ioctl_allowed"), F.when(F.col("has_ioctl"), F.col("ioctl_cmd")).alias("ioctl_cmd"), F.coalesce("ioctl_reason", F.lit("")).alias("ioctl_reason"),
              F.col("missing"), (F.col("human") | (F.col("category") == HUMAN)).alias("needs_human"), F.col("n_neverallow").alias("neverallow_hits"), F.col("patch"), (F.col("patch") != "").alias("produced_patch"), quick.alias("quick_settled"), F.col("requested"),
              status("review_status"), F.col("src"), F.col("tgt"), status("verify_status"), F.col("why")]
    return d.select("fp", _json(*fields).alias("line"))
