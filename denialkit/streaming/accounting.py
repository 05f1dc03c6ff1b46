"""What streams read, dropped and lost: exact totals from a listener, for as many batches as there are."""

from __future__ import annotations

from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Name of the observation that streams carry; its fields add up over batches.
NAME = "told"


def observed(rows: DataFrame, known: bool = True) -> DataFrame:
    """A stream of tailed rows (kind, bytes, fresh) that tells, batch by batch, of its lines, those that
    are a backlog, and bytes that were skipped or lost with a file that shrank."""
    line = F.col("kind") == "line"
    lost = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("bytes"))), F.lit(0))
    return rows.observe(
        NAME, F.count(F.when(line, 1)).alias("lines"), F.count(F.when(line & ~F.col("fresh"), 1)).alias("backlog"), lost("skipped").alias("skipped_bytes"),
        lost("truncated").alias("truncated_bytes"), F.count(F.when(~line, 1)).alias("overruns"))


@dataclass
class Account:
    """Totals of one query."""

    name: str | None
    batches: int = 0
    rows: int = 0
    late: int = 0
    longest_ms: int = 0
    told: dict[str, int] = field(default_factory=dict)
    ended: bool = False
    error: str | None = None


class Accounting(StreamingQueryListener):
    """Adds up what every query of a session reports; memory is one row a query.

    A batch is late if it took longer than ``trigger_ms``. Spark keeps the last 100 reports of a
    query only, a listener hears all.
    """

    def __init__(self, spark: SparkSession, trigger_ms: int = 500):
        self.spark, self.trigger, self.accounts, self.lock = spark, trigger_ms, {}, Lock()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.accounts[str(event.runId)] = Account(event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            a = self.accounts.setdefault(str(p.runId), Account(p.name))
            took = int(p.durationMs.get("triggerExecution", 0))
            a.batches, a.rows, a.late, a.longest_ms = a.batches + 1, a.rows + int(p.numInputRows), a.late + (took > self.trigger), max(a.longest_ms, took)
            row = p.observedMetrics.get(NAME)
            for key, n in (row.asDict() if row is not None else {}).items():
                a.told[key] = a.told.get(key, 0) + int(n or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            a = self.accounts.setdefault(str(event.runId), Account(None))
            a.ended, a.error = True, event.exception

    def frame(self) -> DataFrame:
        """A row for each query: name, run, batches, rows, late, longest_ms, lines, backlog, skipped_bytes,
        truncated_bytes, overruns, ended, error."""
        told = ("lines", "backlog", "skipped_bytes", "truncated_bytes", "overruns")
        with self.lock:
            rows = [(a.name, run, a.batches, a.rows, a.late, a.longest_ms, *(a.told.get(k, 0) for k in told), a.ended, a.error) for run, a in self.accounts.items()]
        return self.spark.createDataFrame(rows, "name string, run string, batches bigint, rows bigint, late bigint, longest_ms bigint, " + ", ".join(f"{k} bigint" for k in told) + ", ended boolean, error string")

    def close(self) -> None:
        self.spark.streams.removeListener(self)
