"""Denial logs: event assembly from whole files, field extraction, and the way back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, MARKER, context_type, denied_permissions, fingerprint, strip, unquote, with_assignments
from .splits import read_lines, records

#: Stands before each marker while a text is cut into lines; a Unicode noncharacter.
FLAG = "﷐"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, line) of log files, by Spark's own splits."""
    return read_lines(spark, path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of small log files, each whole; ``read_log_lines`` is for any size."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def assemble(logs: DataFrame) -> DataFrame:
    """(file, event, block): one row per event of ``logs`` (file, text).

    An event begins at the line on which a marker starts and ends before the next one; lines
    continued by a backslash are joined, comment lines without a marker are dropped.
    """
    flagged = F.regexp_replace(F.replace("text", F.lit("\\\n"), F.lit(" ")), f"({MARKER})", f"{FLAG}$1")
    lines = logs.select("file", F.posexplode(F.split(flagged, "\n")).alias("pos", "line"))
    order = Window.partitionBy("file").orderBy("pos")
    numbered = lines.withColumn("event", F.sum(F.contains("line", F.lit(FLAG)).cast("int")).over(order)).where("event > 0")
    blocks = numbered.groupBy("file", "event").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    text = F.replace(F.array_join(F.col("lines.line"), "\n"), F.lit(FLAG), F.lit(""))
    return blocks.select("file", "event", _kept(text).alias("block")).where("block <> ''")


def assemble_lines(lines: DataFrame) -> DataFrame:
    """The same as ``assemble`` for lines (file, block, pos, line) of files that Spark may split
    anywhere: (file, event, block), where events are ordered by (split, line) instead of numbered."""
    found = records(lines)
    return found.select("file", F.struct(F.col("block").alias("split"), "line").alias("event"), _kept(F.replace("text", F.lit("\\\n"), F.lit(" "))).alias("block")).where("block <> ''")


def _kept(text: Column) -> Column:
    """The lines of an event but blank ones and comments without a marker."""
    kept = F.filter(F.split(text, LINE_BREAK), lambda x: (strip(x) != "") & (~strip(x).startswith("#") | x.rlike(MARKER)))
    return F.array_join(kept, "\n")


def tail_from_marker(text: Column) -> Column:
    """A single event: from the first marker to the end of the text, comments included."""
    found = F.regexp_extract(text, rf"(?s)({MARKER}.*)", 1)
    return F.when(found != "", found)


def parse_events(df: DataFrame, block: str = "block") -> DataFrame:
    """Adds the fields of a denial, read in one pass over its key=value pairs (first of a key wins)."""
    df = with_assignments(df, block, "_pairs")

    def first(key: str) -> Column:
        # a field names this several times; without a lambda Spark computes it once
        return unquote(F.get(F.col("_pairs.value"), (F.array_position(F.col("_pairs.key"), key) - 1).cast("int")))

    pid, permissive = first("pid"), first("permissive")
    out = {
        "raw": strip(F.col(block)), "src": context_type(first("scontext")), "tgt": context_type(first("tcontext")), "cls": first("tclass"),
        "perms": denied_permissions(F.col(block)), "permissive": F.when(permissive == "1", True).when(permissive == "0", False),
        "comm": first("comm"), "pid": F.when(pid.rlike(r"^\d+$"), F.try_to_number(pid, F.lit("999999999999999999")).cast("bigint")),
        "path": first("path"), "name": first("name"), "ioctl_cmd": first("ioctlcmd"), "parameter": first("parameter"), "service": first("service"),
    }
    return df.withColumns(out).drop("_pairs")


def with_fingerprint(denials: DataFrame) -> DataFrame:
    return denials.withColumn("fp", fingerprint(F.col("src"), F.col("tgt"), F.col("cls"), F.col("perms"), F.col("ioctl_cmd")))


def render_line(src: Column, tgt: Column, cls: Column, perms: Column, permissive: Column, ioctl: Column, service: Column) -> Column:
    """A log line with these fields; absent ones are left out."""
    field = lambda name, c: F.coalesce(F.concat(F.lit(f" {name}="), c), F.lit(""))
    return F.concat(
        F.lit("audit: type=1400 audit(0.0:1): avc:  denied  { "), F.array_join(perms, " "), F.lit(' } for  pid=1 comm="probe"'), field("service", service), field("ioctlcmd", ioctl),
        F.coalesce(F.concat(F.lit(" scontext=u:r:"), src, F.lit(":s0")), F.lit("")), F.coalesce(F.concat(F.lit(" tcontext=u:object_r:"), tgt, F.lit(":s0")), F.lit("")),
        field("tclass", cls), F.coalesce(F.concat(F.lit(" permissive="), permissive.cast("int").cast("string")), F.lit("")))


def suppressed(text: Column) -> Column:
    """Messages that the kernel says it dropped, summed over a text."""
    counts = F.regexp_extract_all(text, F.lit(r"\bkauditd_printk_skb: (\d+) callbacks suppressed\b"), F.lit(1))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: F.least(acc + F.coalesce(n.try_cast("bigint"), F.lit(2**31)), F.lit(2**53)))


def clusters(denials: DataFrame) -> DataFrame:
    """One row per logical access: counts by mode, the first record, up to five commands in order
    of arrival. ``seq`` orders arrival."""
    first = F.struct("raw", "src", "tgt", "cls", "perms", "permissive", "ioctl_cmd", "service")
    # by command first, so that the log is read once and a list is as long as its distinct commands
    each = denials.groupBy("fp", "comm").agg(
        F.count("*").alias("n"), F.count_if(F.col("permissive")).alias("n_permissive"), F.count_if(~F.col("permissive")).alias("n_enforcing"),
        F.count_if(F.col("permissive").isNull()).alias("n_unknown"), F.min("seq").alias("first_seq"), F.min_by(first, "seq").alias("first"))
    comms = F.array_sort(F.collect_list(F.when(F.col("comm") != "", F.struct("first_seq", "comm"))))
    groups = each.groupBy("fp").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_permissive", "n_enforcing", "n_unknown")], F.min_by("first", "first_seq").alias("first"), F.min("first_seq").alias("first_seq"),
        F.slice(F.transform(comms, lambda x: x["comm"]), 1, 5).alias("comms"))
    return groups.select("fp", "n", "n_permissive", "n_enforcing", "n_unknown", "first_seq", "comms", "first.*")
