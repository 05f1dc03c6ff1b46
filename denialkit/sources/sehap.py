"""Application domain tables (``sehap_contexts``): entries, and why other lines were left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line lengths that count, and the known values of ``extra``.
SHORTEST, LONGEST = 20, 1024
EXTRAS = ("dlp_sandbox_read_only", "dlp_sandbox", "input_isolate", "input_isolate_full", "custom_sandbox", "isolated_gpu", "isolated_render")


def parse_sehap(lines: DataFrame) -> DataFrame:
    """Adds to (file, line_no, line): skip (null for an entry, empty for lines that say nothing,
    else the reason), apl, domain, type, debuggable, name, extension, extra. The last of repeated
    keys counts."""
    s = F.trim("line")
    tokens = F.filter(F.split(s, r"\s+"), lambda t: t != "")

    def value(key: str) -> Column:
        own = F.filter(tokens, lambda t: t.startswith(f"{key}="))
        return F.when(F.size(own) > 0, F.substring(F.element_at(own, -1), F.lit(len(key) + 2), F.length("line")))

    size = F.length("line")
    reason = F.when((size <= SHORTEST) | (size > LONGEST), F.when((s == "") | s.startswith("#"), "").otherwise("length")).when(s.startswith("#"), "")
    reason = reason.when(~F.contains("line", F.lit("apl=")), "no apl=").when(F.exists(tokens, lambda t: ~t.rlike("^[^=]+=")) | value("apl").isNull(), "malformed").when(value("domain").isNull(), "no domain=")
    extra = F.coalesce(value("extra"), F.lit(""))
    reason = reason.when((extra != "") & ~extra.isin(*EXTRAS), F.concat(F.lit("unknown extra="), extra))
    return lines.withColumns({"skip": reason, "apl": value("apl"), "domain": value("domain"), "type": F.coalesce(value("type"), F.lit("")), "debuggable": F.coalesce(value("debuggable") == "true", F.lit(False)),
                              "name": F.coalesce(value("name"), F.lit("")), "extension": F.coalesce(value("extension"), F.lit("")), "extra": extra})


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.where("skip is null").select("apl", "domain", "type", "debuggable", "name", "extension", "extra")


def sehap_summary(parsed: DataFrame) -> DataFrame:
    """(entries, domains, apls, debuggable, with_extra, skipped), one row."""
    own = F.col("skip").isNull()
    return parsed.agg(F.count_if(own).alias("entries"), F.count_distinct(F.when(own, F.col("domain"))).alias("domains"), F.count_distinct(F.when(own, F.col("apl"))).alias("apls"),
                      F.count_if(own & F.col("debuggable")).alias("debuggable"), F.count_if(own & (F.col("extra") != "")).alias("with_extra"), F.count_if(F.col("skip") != "").alias("skipped"))
