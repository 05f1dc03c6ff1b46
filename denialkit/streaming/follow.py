"""Live mode: denials from a stream of log lines, each logical access once if asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import MARKER
from ..sources.denials import parse_events, with_fingerprint
from .accounting import observed
from .tail import tail


def denials(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parsed denials of a (streaming) frame of log lines; a line is an event of its own here."""
    return with_fingerprint(parse_events(lines.where(F.col(line).rlike(MARKER)), line))


def once(parsed: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each logical access once. Without a time column for ever, with state that grows with the
    number of distinct accesses; with one, once within ``delay``, with bounded state."""
    if time is None:
        return parsed.dropDuplicates(["fp"])
    return parsed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fp"])


def follow(parsed: DataFrame, path: str, checkpoint: str, interval: str | None = "500 milliseconds") -> StreamingQuery:
    """Writes a stream of denials as JSON lines; without an interval it takes what is there and ends."""
    out = parsed.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("text").option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start(path)


def snapshot(parsed: DataFrame, most: int = 3000) -> DataFrame:
    """The newest records (``seq``), as many as a snapshot holds."""
    return parsed.orderBy(F.desc("seq")).limit(most)


def follow_new(spark: SparkSession, folder: str, path: str, checkpoint: str, interval: str = "500 milliseconds", **limits: int) -> StreamingQuery:
    """Follows the files below a folder from now on: what they hold when the query first starts is a
    backlog, which is read, counted and dropped, and the first new record is the first that is
    written. It stays so when the query starts again. ``limits`` are those of ``tail``."""
    rows = observed(tail(spark, folder, checkpoint, start="latest", **limits))
    parsed = denials(rows.where("kind = 'line' and fresh").select("file", "at", "line"))
    return follow(parsed, path, checkpoint, interval)


def session(start: Callable[[], StreamingQuery], switch: Callable[[], bool], poll: float = 0.5) -> StreamingQuery:
    """Runs a followed stream while ``switch`` says so, then stops it; its files hold the session."""
    query = start()
    while switch() and query.isActive:
        query.awaitTermination(poll)
    query.stop()
    return query
