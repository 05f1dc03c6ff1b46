"""Sessions of watched devices in logs at rest: a scan by segments, so that one busy device is many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of one segment of a device's log.
SEGMENT = 100_000


def sessions(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Adds to (device, seq, what, ...) the session that a row falls in, and whether it is open.

    ``what`` on opens a session, off ends it, and says nothing where it is so already; the rows
    after an end belong to no open session. A segment's summary is its first and last switch and
    the openings between its own switches; summaries of a device join from left to right.
    """
    switch = F.when(F.col("what") == "on", True).when(F.col("what") == "off", False)
    part = rows.withColumns({"_on": switch, "_segment": F.floor(F.col("seq") / segment)})
    inner = Window.partitionBy("device", "_segment").orderBy("seq")
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)

    def opens(entry: Column) -> Column:
        """Whether a row opens a session, given what stands before its segment."""
        return (F.col("_on") & ~F.coalesce(F.last("_on", ignorenulls=True).over(earlier), entry)).cast("bigint")

    told = part.where("_on is not null").withColumn("_opens", F.coalesce(opens(F.lit(None).cast("boolean")), F.lit(0)))
    summary = told.groupBy("device", "_segment").agg(F.min_by("_on", "seq").alias("first"), F.max_by("_on", "seq").alias("last"), F.sum("_opens").alias("inside"))
    before = Window.partitionBy("device").orderBy("_segment")
    entry = F.coalesce(F.lag("last").over(before), F.lit(False))
    total = summary.withColumn("opened", F.col("inside") + (F.col("first") & ~entry).cast("bigint"))
    at = total.select("device", "_segment", entry.alias("_entry"), (F.sum("opened").over(before) - F.col("opened")).alias("_count"), "last", F.sum("opened").over(before).alias("_after"))
    # a segment without a switch takes what the last one with a switch left
    every = part.select("device", "_segment").distinct().join(at, ["device", "_segment"], "left")
    since = before.rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(
        "device", "_segment", F.coalesce("_entry", F.last("last", ignorenulls=True).over(since), F.lit(False)).alias("_entry"),
        F.coalesce("_count", F.last("_after", ignorenulls=True).over(since), F.lit(0)).alias("_count"))
    known = part.join(every, ["device", "_segment"])
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumn("_opens", F.coalesce(opens(F.col("_entry")), F.lit(0)))
    out = known.withColumns({"session": F.col("_count") + F.sum("_opens").over(upto), "open": F.coalesce(F.last("_on", ignorenulls=True).over(upto), F.col("_entry"))})
    return out.drop("_on", "_segment", "_entry", "_count", "_opens")


def session_report(rows: DataFrame) -> DataFrame:
    """(device, session, records, accesses, repeats) of the records of each open session; ``fp`` names an access."""
    held = rows.where("open and what = 'record'").groupBy("device", "session", "fp").agg(F.count("*").alias("n"))
    return held.groupBy("device", "session").agg(F.sum("n").alias("records"), F.count("*").alias("accesses"), (F.sum("n") - F.count("*")).alias("repeats"))


def newest(rows: DataFrame, most: int = 3000) -> DataFrame:
    """The newest ``most`` records of each session; a row number that Spark limits before it shuffles."""
    order = Window.partitionBy("device", "session").orderBy(F.desc("seq"))
    held = rows.where("open and what = 'record'").withColumn("_k", F.row_number().over(order))
    return held.where(F.col("_k") <= most).drop("_k")
