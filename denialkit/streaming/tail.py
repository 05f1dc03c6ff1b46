"""A streaming source that tails growing log files by byte position.

Offsets hold how far each file was read, always behind a line break, so that a half line waits for
its rest. What is new is cut into ranges that tasks read by themselves.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: A row is a line (kind ``line``), or tells of bytes that were never read: ``skipped`` because the
#: reader fell too far behind, ``truncated`` because the file shrank below what was read or went before it was.
SCHEMA = "file string, at bigint, line string, kind string, bytes bigint, fresh boolean"
#: Bytes that a task reads, and that are read at once to find a line break.
RANGE, STEP = 16 << 20, 1 << 16


class Range(InputPartition):
    """Lines that start in [a, b) of a file whose read part begins at ``begin``; or the tale of bytes [a, b)."""

    def __init__(self, file: str, begin: int, a: int, b: int, fresh: int, kind: str = "line"):
        self.file, self.begin, self.a, self.b, self.fresh, self.kind = file, begin, a, b, fresh, kind


def break_before(f, low: int, high: int) -> int:
    """The place behind the last line break in [low, high), or ``low`` if there is none."""
    while high > low:
        start = max(low, high - STEP)
        f.seek(start)
        at = f.read(high - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


def break_after(f, low: int, high: int) -> int:
    """The place behind the first line break in [low, high), or -1."""
    while low < high:
        f.seek(low)
        part = f.read(min(STEP, high - low))
        at = part.find(b"\n")
        if at >= 0:
            return low + at + 1
        if not part:
            break
        low += len(part)
    return -1


def positions(checkpoint: str) -> dict:
    """The newest offset of a query's checkpoint, empty if it has none yet."""
    files, root = fs.FileSystem.from_uri(checkpoint)
    folder = f"{root}/offsets"
    if files.get_file_info(folder).type != fs.FileType.Directory:
        return {}
    numbers = [int(i.base_name) for i in files.get_file_info(fs.FileSelector(folder)) if re.fullmatch(r"\d+", i.base_name)]
    for n in sorted(numbers, reverse=True):
        with files.open_input_stream(f"{folder}/{n}") as f:
            last = f.read().decode().strip().split("\n")[-1]
        if last.startswith("{"):
            return json.loads(last)
    return {}


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.files, self.root = fs.FileSystem.from_uri(options["path"])
        self.pattern, self.checkpoint = options.get("pattern", "*"), options["checkpoint"]
        self.bytes, self.millis, self.behind = (int(options.get(k, 0)) for k in ("maxbytes", "maxmillis", "maxbehind"))
        self.now = options.get("start", "earliest") == "latest"
        self.known, self.asked, self.planned, self.rate = None, None, 0, 0.0

    def _sizes(self) -> dict[str, int]:
        if self.files.get_file_info(self.root).type == fs.FileType.NotFound:
            return {}
        found = self.files.get_file_info(fs.FileSelector(self.root, recursive=True))
        seen = [i for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, self.pattern)]
        return {i.path: i.size for i in seen if not re.search(r"/[._]", i.path[len(self.root.rstrip("/")) :])}  # hidden, or being written

    def initialOffset(self) -> dict:
        """From the start of all files. What they hold now is a backlog if the query starts at the latest."""
        fresh = {}
        if self.now:
            for file, size in self._sizes().items():
                with self.files.open_input_file(file) as f:
                    fresh[file] = break_before(f, 0, size)
        return {"at": {}, "fresh": fresh, "lost": {}}

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = positions(self.checkpoint) or self.initialOffset()
        at, lost, sizes = dict(self.known["at"]), {}, self._sizes()
        left, started = self._budget(), time.monotonic()
        waiting = sorted(f for f, n in sizes.items() if n != at.get(f, 0))
        for i, file in enumerate(waiting):
            size, a = sizes[file], at.get(file, 0)
            if size < a:
                lost[file], a = f"truncated:0:{a}", 0
            with self.files.open_input_file(file) as f:
                if self.behind and size - a > self.behind:
                    b = break_after(f, size - self.behind, size)
                    if b > 0:
                        lost[file], a = f"skipped:{a}:{b}", b
                share = left // (len(waiting) - i) if left else size  # files share the budget
                end = break_before(f, a, min(size, a + share)) if left != 0 or not self._limited() else a
                if end == a and share < size - a and (left or not self._limited()):
                    end = max(a, break_after(f, a, size))  # a line longer than its share is read whole
            if left:
                left = max(0, left - (end - a))
            at[file] = end
        self.planned, self.asked = sum(at[f] - self.known["at"].get(f, 0) for f in waiting), started
        self.known = {"at": at, "fresh": self.known["fresh"], "lost": lost}
        return self.known

    def _limited(self) -> bool:
        return bool(self.bytes or self.millis)

    def _budget(self) -> int:
        """Bytes that the next batch may read: no more than asked, and than the last batches' speed reads in time."""
        if self.asked is not None and self.planned > 0:
            self.rate = max(self.planned / max(time.monotonic() - self.asked, 1e-3), self.rate / 2)
        timed = max(int(self.rate * self.millis / 1000), STEP) if self.millis and self.rate else 0
        return min(x for x in (self.bytes, timed) if x) if self.bytes or timed else 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = self.known or end
        out = []
        for file, b in sorted(end["at"].items()):
            a, fresh, told = start["at"].get(file, 0), start["fresh"].get(file, 0), end["lost"].get(file)
            if told and (a, b) != (b, a):
                kind, low, high = told.split(":")
                out.append(Range(file, 0, int(low), int(high), 0, kind))
                a, fresh = (0, 0) if kind == "truncated" else (int(high), fresh)
            out += [Range(file, a, x, min(b, x + RANGE), fresh) for x in range(a, b, RANGE)]
        return out

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        if p.kind != "line":
            yield _rows(p, [p.a], [None], [p.b - p.a])
            return
        if self.files.get_file_info(p.file).type == fs.FileType.NotFound:  # it went before it could be read
            yield _rows(p, [p.a], [None], [p.b - p.a], "truncated")
            return
        with self.files.open_input_file(p.file) as f:
            a = p.a if p.a == p.begin else break_after(f, p.a - 1, p.b)  # a line belongs where it starts
            if a < 0:
                return
            f.seek(a)
            rest = b""
            while a + len(rest) < p.b or rest:
                part = f.read(STEP if a + len(rest) >= p.b else min(1 << 20, p.b - a - len(rest)))
                if not part:
                    break
                *lines, rest = (rest + part).split(b"\n")
                ats, kept = [], []
                for line in lines:
                    if a < p.b:
                        ats.append(a)
                        kept.append(line.decode("utf-8", "replace"))
                    a += len(line) + 1
                if kept:
                    yield _rows(p, ats, kept, [0] * len(kept))
                if a >= p.b:
                    break


def _rows(p: Range, at: list, lines: list, sizes: list, kind: str | None = None) -> pa.RecordBatch:
    n = len(at)
    columns = [pa.array([p.file] * n), pa.array(at, pa.int64()), pa.array(lines, pa.string()), pa.array([kind or p.kind] * n), pa.array(sizes, pa.int64()), pa.array([x >= p.fresh for x in at])]
    return pa.RecordBatch.from_arrays(columns, names=["file", "at", "line", "kind", "bytes", "fresh"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, folder: str, checkpoint: str, start: str = "earliest", pattern: str = "*", max_bytes: int = 0, max_millis: int = 0, max_behind: int = 0) -> DataFrame:
    """A stream (file, at, line, kind, bytes, fresh) of the lines of all files below a folder, as they grow.

    ``checkpoint`` is that of the query that reads the stream. With ``start`` latest, what the files
    held when the query first started is marked as not fresh; a half line at their end is fresh once
    it is whole. A batch reads at most ``max_bytes``, and about what ``max_millis`` allow at the
    speed so far (one line is always read whole). Of a file that is more than ``max_behind`` bytes
    ahead the older part is skipped, and a row tells how many bytes. 0 is no limit. The folder is a
    place that driver and executors open by the same URI.
    """
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("path", folder).option("checkpoint", checkpoint).option("start", start).option("pattern", pattern)
    return reader.option("maxbytes", max_bytes).option("maxmillis", max_millis).option("maxbehind", max_behind).load()


def unfinished(spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """(file, bytes): what a query's files hold behind what it has read, which is no record yet."""
    files, root = fs.FileSystem.from_uri(folder)
    at = positions(checkpoint).get("at", {})
    rest = [(i.path, i.size - at[i.path]) for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path in at]
    return spark.createDataFrame([r for r in rest if r[1] > 0], "file string, bytes bigint")
