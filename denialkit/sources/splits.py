"""Lines of files of any size, read by Spark's own splits, and records that reach over split ends.

A task reads the lines of its splits in order and hands on what lies whole within one; only the
first and last pieces of each split meet again, by file. A file of any size is so read by all
cores, and what shuffles is a few lines a split.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, WS, strip

#: Stands for a line break that a backslash takes away, while marks are looked for; a Unicode noncharacter.
GLUE = "﷐"
#: Marks open a record, whatever white space, line breaks too, stands inside them.
_WS = rf"[\s\x1c-\x1f{GLUE}]*"
_MARK = re.compile(rf"\bavc{_WS}:{_WS}denied", re.IGNORECASE)
#: What may stand between the words of a mark.
_BETWEEN = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + GLUE + ":"


def read_lines(spark: SparkSession, path: str, recursive: str | None = None) -> DataFrame:
    """(file, block, pos, line) of text files: block is where a split starts, pos grows within it.
    ``recursive`` is the name pattern of the files to take below a folder."""
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", recursive)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def text_lines(texts: DataFrame) -> DataFrame:
    """The same of a frame (file, text), where each text is a split of its own, whatever its file."""
    rows = texts.select("file", F.monotonically_increasing_id().alias("block"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return rows.select("file", "block", F.posexplode("lines").alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows of one split, as they stream by."""
    for b in batches:
        if b.num_rows:
            file, block = b.column("file").dictionary_encode(), b.column("block").to_numpy()
            code = file.indices.to_numpy()
            edge = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip(edge, edge[1:]):
                yield (file.dictionary[int(code[i])].as_py(), int(block[i])), b.slice(i, j - i)


def _bounds(text: str, start: int) -> list[int]:
    """Where the lines begin on which marks start; joined lines are one."""
    view = text.replace("\\\n", f" {GLUE}")
    return sorted({view.rfind("\n", 0, m.start()) + 1 for m in _MARK.finditer(view, start)})


class _Records:
    """Cuts the text of a split into records. The first and the last piece stay open."""

    def __init__(self):
        self.text, self.line, self.inside, self.seen = "", 0, False, 0
        self.whole: list[tuple[int, str]] = []

    def add(self, more: str) -> None:
        """more: further lines, each with its line break."""
        self.text += more
        found = [b for b in _bounds(self.text, self.seen) if b > 0]  # a mark in the first line may belong to a line before
        at = 0
        for b in found:
            if self.inside or at:
                self.whole.append((self.line, self.text[at:b]))
            else:
                self.whole.append((-1, self.text[:b]))
            self.line += self.text.count("\n", at, b)
            at, self.inside = b, True
        self.text = self.text[at:]
        begun = self.text.replace("\\\n", f" {GLUE}").rstrip(_BETWEEN)
        self.seen = len(begun) - 3 if begun[-3:].lower() == "avc" else len(self.text)


def records(lines: DataFrame) -> DataFrame:
    """(file, block, line, text): a row for each record of lines (file, block, pos, line), which is
    the text from the line on which a mark starts to before the next such line. What stands before a
    file's first mark is no record. ``line`` counts from the start of the split (0 is its first).

    A record reaches as far as the file if no mark follows, and is one value then.
    """
    schema = "file string, block bigint, line bigint, text string, edge boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, _Records(), []

        def take(last: bool) -> None:
            out.extend((*key, max(n, 0), t, n < 0) for n, t in held.whole)
            held.whole = []
            if last:
                out.append((*key, held.line, held.text, True))

        def rows() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["file", "block", "line", "text", "edge"])

        for now, part in stretches(batches):
            if key is not None and now != key:
                take(True)
                held = _Records()
            key = now
            held.add("\n".join(part.column("line").to_pylist()) + "\n")
            take(False)
            if sum(len(r[3]) for r in out[-64:]) > 1 << 20 or len(out) >= 1024:
                yield rows()
                out.clear()
        if key is not None:
            take(True)
            yield rows()

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "line"], kind="stable")
        text, starts = "".join(pdf["text"]).removesuffix("\n"), (pdf["text"].str.len().cumsum() - pdf["text"].str.len()).tolist()
        bounds = _bounds(text, 0)
        out = []
        for a, b in zip(bounds, [*bounds[1:], len(text)]):
            i = bisect_right(starts, a) - 1
            out.append((pdf["file"].iat[0], pdf["block"].iat[i], pdf["line"].iat[i] + text.count("\n", starts[i], a), text[a:b], False))
        return pd.DataFrame(out, columns=["file", "block", "line", "text", "edge"])

    cuts = lines.select("file", "block", "line").mapInArrow(cut, schema)  # read twice, so that whole records need no shuffle
    # where no piece of a file holds a mark's first word there is nothing to put together
    some = F.max(F.contains(F.lower("text"), F.lit("avc"))).over(Window.partitionBy("file"))
    ends = cuts.where("edge").withColumn("_some", some).where("_some").drop("_some").groupBy("file").applyInPandas(stitch, schema)
    return cuts.where("not edge").unionByName(ends).select("file", "block", "line", "text")


def line_states(lines: DataFrame, opening: str, closing: tuple[str, ...]) -> list[Row]:
    """(file, hash, block, inside, lines) of each split of lines (file, block, pos, line): whether it begins
    inside a wrapper, and the lines of its file that stand before it.

    A line tells whether the next ones are inside, whatever stood before: an opening one says yes, a
    closing one no. So a split's summary is its last such line and its count of lines, summaries
    join from left to right, and there is one for each split, which the driver has planned itself.
    """
    opens = "(?U)^(" + opening.replace(r"\s", WS) + r")\z"
    mark = lambda x: F.when(strip(x).isin(*closing), 0).when(F.contains(x, F.lit("(")) & strip(x).rlike(opens), 1)
    many, pieces = F.col("line").rlike(LINE_BREAK), F.split("line", LINE_BREAK)
    ended = F.element_at(pieces, -1) == ""  # a break at the end begins no line
    n = F.when(many, F.greatest(F.size(pieces) - ended.cast("int"), F.lit(1))).otherwise(1)
    last = F.when(many, F.try_element_at(F.filter(F.transform(pieces, mark), lambda m: m.isNotNull()), F.lit(-1))).otherwise(mark(F.col("line")))
    each = lines.select("file", "block", "pos", n.alias("n"), last.alias("last"))
    split = each.groupBy("file", "block").agg(F.sum("n").alias("n"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("pos"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = split.select("file", "block", F.coalesce(F.last("last", ignorenulls=True).over(before) > 0, F.lit(False)).alias("inside"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
    return told.withColumn("hash", F.xxhash64("file")).collect()


_BREAK = re.compile(r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def physical(lines: list[str]) -> list[str]:
    """The lines as all line breaks of Unicode cut them, without the white space around them."""
    if _BREAK.search("\n".join(lines)):
        lines = [x for line in lines for x in line.splitlines() or [""]]
    return [x.strip() for x in lines]


def wrapper_mark(opening: str, closing: tuple[str, ...]) -> Callable[[str], float | None]:
    """Tells 1 of a line that opens a wrapper, 0 of one that closes it, nothing of others."""
    opens, closes = re.compile(opening).fullmatch, frozenset(closing)
    return lambda line: 0.0 if line in closes else 1.0 if opens(line) else None
