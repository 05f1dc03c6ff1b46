"""Stateful steps of live mode: repeats counted by access, and sessions switched on and off."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession) -> None:
    """State of any size lives beside memory, in the store that these steps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class CountRepeats(StatefulProcessor):
    """The first record of a key goes on, later ones are counted; a key that is quiet for ``quiet``
    milliseconds is forgotten and its repeats are summed up."""

    def __init__(self, quiet: int = 0):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "record string, repeats bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        record, repeats = self.seen.get() if known else (None, 0)
        first, n = None, 0
        for pdf in rows:  # a piece at a time, whatever a batch holds of one access
            n += len(pdf)
            i = int(pdf["seq"].to_numpy().argmin())
            if not known and (first is None or pdf["seq"].iat[i] < first):
                first, record = pdf["seq"].iat[i], pdf["record"].iat[i]
        more = n - (not known)
        self.seen.update((record, int(repeats) + more))
        if self.quiet:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        out = [(key[0], "first", record, 1)] * (not known) + [(key[0], "repeats", None, more)] * (more > 0)
        yield pd.DataFrame(out, columns=["fp", "kind", "record", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        record, repeats = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame([(key[0], "ended", record, int(repeats))], columns=["fp", "kind", "record", "n"])

    def close(self) -> None:
        pass


def once_counted(parsed: DataFrame, quiet: int = 0) -> DataFrame:
    """A stream of denials (with fp and seq) as (fp, kind, record, n): each access's record once (kind
    first), how many repeats a batch held (repeats), and with ``quiet`` the end of an access that
    was not seen for so many milliseconds, with all its repeats (ended); it is new when it comes again."""
    with_rocks(parsed.sparkSession)
    rows = parsed.select("fp", F.col("seq").cast("bigint").alias("seq"), F.to_json(F.struct("*")).alias("record"))
    return rows.groupBy("fp").transformWithStateInPandas(CountRepeats(quiet), "fp string, kind string, record string, n bigint", "Append", "ProcessingTime" if quiet else "None")


class Guard(StatefulProcessor):
    """Sessions of one watched device: a switch opens and closes them, each sees an access once, and
    holds its newest records for a snapshot."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.on = handle.getValueState("on", "session bigint, open boolean, emitted bigint, repeats bigint")
        self.seen = handle.getMapState("seen", "fp string", "n bigint")
        self.newest = handle.getListState("newest", "seq bigint, record string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        session, open_, emitted, repeats = self.on.get() if self.on.exists() else (0, False, 0, 0)
        held, out, fresh, ended = list(map(tuple, self.newest.get())) if open_ else [], [], {}, False
        for seq, what, fp, record in pdf[["seq", "what", "fp", "record"]].itertuples(index=False, name=None):
            if what == "on" and not open_:
                session, open_, emitted, repeats, held, fresh, ended = session + 1, True, 0, 0, [], {}, True
            elif what == "off" and open_:
                out.append((key[0], session, "closed", seq, None, emitted, repeats))
                open_, held = False, []
            elif what == "snapshot" and open_:
                held = held[-self.most :]
                out += [(key[0], session, "snapshot", s, r, emitted, repeats) for s, r in held]
            elif what == "record" and open_:
                held.append((seq, record))
                held = held[-self.most :] if len(held) > 2 * self.most else held
                old = fp in fresh or (not ended and self.seen.containsKey((fp,)))
                repeats, emitted = repeats + old, emitted + (not old)
                if not old:
                    fresh[fp] = 1
                    out.append((key[0], session, "record", seq, record, emitted, repeats))
        self.on.update((int(session), bool(open_), int(emitted), int(repeats)))
        if ended or not open_:
            self.seen.clear()
        for fp in fresh if open_ else ():
            self.seen.updateValue((fp,), (1,))
        self.newest.clear()
        if held:
            self.newest.put([(int(s), r) for s, r in held[-self.most :]])
        yield pd.DataFrame(out, columns=["device", "session", "kind", "seq", "record", "emitted", "repeats"])

    def close(self) -> None:
        pass


def guard(rows: DataFrame, most: int = 3000) -> DataFrame:
    """A stream (device, seq, what, fp, record) as what its sessions say: (device, session, kind, seq,
    record, emitted, repeats).

    ``what`` is on or off for the switch, record, or snapshot for a request of the newest ``most``
    records of the session. Records count while a session is open; an access goes on once a session
    (kind record), a session that ends says how many went on and how many repeated (closed). A new
    session knows nothing of the last. Rows of a batch count in the order of ``seq``; those of one device are
    held together, so the source's budget bounds them (``sessions`` splits a device's rows at rest).
    """
    with_rocks(rows.sparkSession)
    asked = rows.select(F.col("device").cast("string").alias("device"), F.col("seq").cast("bigint").alias("seq"), "what", "fp", "record")
    return asked.groupBy("device").transformWithStateInPandas(Guard(most), "device string, session bigint, kind string, seq bigint, record string, emitted bigint, repeats bigint", "Append", "None")
