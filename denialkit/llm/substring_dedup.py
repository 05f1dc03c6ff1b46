"""Substring deduplication over a log-structured fingerprint index.

Every 35-word window has one *anchor*: of its 12-word grams the one with the smallest hash (the
leftmost of equal ones). Equal windows have equal anchors at equal offsets, and runs of windows
share an anchor, so the index keeps a twelfth of all positions and loses no repetition. Windows of
repeated anchors are verified by independent hashes of all their words.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, attach
from .exact_dedup import bloom_filter, may_contain
from .ragged import U64, Words, grams, mix, pieces, powers, take, words

#: Words of a window and of an anchor gram; runs that meet in a compaction; batches of a full run;
#: rows that a task combines before they shuffle; the most span and id rows that are broadcast.
WINDOW, GRAM, FAN, BATCHES, COMBINED, SMALL = 35, 12, 4, 2, 400_000, 500_000
_BASE, _BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
OCCURRENCE = "fp bigint, block bigint, doc_id bigint, row bigint, start int, n int"


def sequence_hash(h: np.ndarray):
    """A function that hashes h[s:e] for arrays of s and e, independent of ``grams``."""
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum((h ^ U64(0x5851F42D4C957F2D)) * powers(_BASE, len(h)), out=sums[1:])
    back = powers(_BACK, len(h) + 1)
    return lambda s, e: mix((sums[e] - sums[s]) * back[s] + (e - s).astype(U64))


def anchors(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(fp, first window, windows) of each run of windows of a row that share their anchor."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, none
    v = grams(h, GRAM)
    best, width, span = np.arange(len(v)), 1, WINDOW - GRAM + 1
    while width < span:  # best[s]: the place of the smallest gram among v[s:s + width]
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best, width = np.where(v[a] <= v[b], a, b), width + step
    start = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    at = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return v[at[first]], start[first], np.diff(first, append=len(start))


def occurrences(docs: DataFrame) -> DataFrame:
    """The anchors of all documents: fingerprint, hash of the words of all its windows, place."""

    def run(batches):
        for b in pieces(batches):
            w = words(b.column("text"))
            h = w.hashes()
            fp, start, n = anchors(h, w.doc)
            block, doc = sequence_hash(h)(start, start + n + WINDOW - 1), w.doc[start]
            take_ = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(block.view(np.int64)), b.column("doc_id").take(take_), b.column("row").take(take_), pa.array(start - w.at[doc], pa.int32()), pa.array(n, pa.int32())], names=["fp", "block", "doc_id", "row", "start", "n"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, OCCURRENCE)


def combined(found: DataFrame) -> DataFrame:
    """Counts of fingerprints before any shuffle: (fp, n, lo, hi), once for many rows of a task;
    lo and hi are the smallest and largest block hash. A passage in very many documents so moves
    as a few rows of each task."""

    def run(batches):
        held, rows = [], 0

        def flush():
            fp, block = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((block, fp))
            fp, block = fp[order], block[order]
            first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            last = np.append(first[1:], len(fp)) - 1
            return pa.RecordBatch.from_pydict({"fp": fp[first], "n": (last - first + 1).astype(np.int64), "lo": block[first], "hi": block[last]})

        for b in batches:
            if b.num_rows:
                held.append((b.column("fp").to_numpy(), b.column("block").to_numpy()))
                rows += b.num_rows
            if rows > COMBINED:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return found.select("fp", "block").mapInArrow(run, "fp bigint, n bigint, lo bigint, hi bigint")


class FingerprintIndex:
    """Immutable runs (fp, n, lo, hi), each a table bucketed and sorted by fingerprint.

    ``append`` adds a batch as a new run and merge-joins it with the runs before it, bucket by
    bucket, which tells what the batch repeats; runs of one index share their buckets, so that
    they join without a shuffle. ``compact`` merges runs into one.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.runs, self.made = spark, name or f"fingerprints_{uuid.uuid4().hex}", [], 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        df.write.option("compression", "zstd").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(table)
        return table

    def append(self, found: DataFrame, store: Stored | None = None) -> DataFrame:
        """(fp): what a batch of anchors repeats, of itself or of older batches. The batch becomes
        a new run; FAN runs are compacted."""
        sums = combined(found).repartition(self.buckets, "fp").groupBy("fp").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        new = self._write(sums)
        inside = self.spark.table(new).where("n > 1").select("fp")
        hits = (store or Stored(self.spark)).put("repeats", inside.union(self.matches(self.spark.table(new))))
        self.runs.append(new)
        if len(self.runs) >= FAN:
            self.compact()
        return hits

    def matches(self, found: DataFrame) -> DataFrame:
        """Those of some different fingerprints (fp) that the index already has, once for each run."""
        own = found.select("fp")
        out = own.limit(0)
        for t in self.runs:
            out = out.union(own.join(self.spark.table(t).select("fp"), "fp"))
        return out

    def compact(self) -> None:
        while len(self.runs) > 1:
            a, b = self.runs.pop(0), self.runs.pop(0)
            x, y = self.spark.table(a).toDF("fp", "n1", "lo1", "hi1"), self.spark.table(b).toDF("fp", "n2", "lo2", "hi2")
            both = x.join(y, "fp", "full_outer")
            n = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
            self.runs.append(self._write(both.select("fp", n.alias("n"), F.least("lo1", "lo2").alias("lo"), F.greatest("hi1", "hi2").alias("hi"))))
            for t in (a, b):
                self.spark.sql(f"DROP TABLE {t}")

    def repeated(self, hits: DataFrame) -> DataFrame:
        """(fp, times, uniform) of the fingerprints in ``hits``; uniform: in equal blocks only."""
        self.compact()
        return self.spark.table(self.runs[0]).join(hits, "fp", "left_semi").select("fp", F.col("n").alias("times"), (F.col("lo") == F.col("hi")).alias("uniform"))

    def drop(self) -> None:
        for t in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.runs = []


def window_hashes(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(fp, w, sole, doc_id, row, start) of each window of the given blocks. blocks: doc_id, row,
    and parts, a list of (start, n, fp, sole)."""

    def run(batches):
        for b in pieces(batches):
            w = words(b.column("text"))
            parts = b.column("parts")
            at, flat = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            start, n, fp, sole = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            s = np.repeat(start + w.at[doc], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = sequence_hash(w.hashes())(s, s + WINDOW)
            each = np.repeat(doc, n)
            rows = pa.array(each)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, n)), pa.array(h.view(np.int64)), pa.array(np.repeat(sole, n)), b.column("doc_id").take(rows), b.column("row").take(rows), pa.array(s - w.at[each], pa.int32())], names=["fp", "w", "sole", "doc_id", "row", "start"])

    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    there = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))
    joined = docs.join(blocks.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "parts"), there)
    return joined.select("doc_id", "row", "text", "parts").mapInArrow(run, "fp bigint, w bigint, sole boolean, doc_id bigint, row bigint, start int")


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, given (d, r, spans) with lists of (start, end)."""

    def run(batches):
        for b in pieces(batches):
            w: Words = words(b.column("text"))
            parts = b.column("spans")
            at, flat = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            change = np.zeros(len(w.doc) + 1, np.int64)
            for i, sign in ((0, 1), (1, -1)):
                np.add.at(change, flat.field(i).to_numpy(zero_copy_only=False) + w.at[doc], sign)
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            count = np.bincount(w.doc[kept], minlength=b.num_rows)
            data, byte_at = take(np.append(w.data, np.uint8(32)), w.start, w.end - w.start + 1, kept)
            data[byte_at[1:] - 1] = 32
            edge = byte_at[np.concatenate([[0], np.cumsum(count)])].tolist()
            data = data.tobytes()
            text = [data[x : max(x, y - 1)] for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(w.count - count, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    joined = joined.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def repeated_spans(docs: DataFrame, store: Stored, batches: int = BATCHES) -> DataFrame:
    """(d, r, spans): for each document (id, text hash) the word spans of windows that occur twice
    or more in all texts.

    The documents come in batches: each is merge-joined with the runs of those before it, appended,
    and what any batch repeats is looked up in the compacted index."""
    spark, index, every, hits = docs.sparkSession, FingerprintIndex(docs.sparkSession), None, None
    try:
        for i in range(batches):
            part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
            found = store.put(f"batch{i}", occurrences(part))
            own = index.append(found, store)
            every, hits = (found, own) if every is None else (every.union(found), hits.union(own))
        again = store.put("again", index.repeated(hits))
    finally:  # a job that fails leaves no runs behind
        index.drop()
    # only occurrences that may have a repeated fingerprint go on
    bits, m = bloom_filter(again.select(F.col("fp").alias("h")), again.count(), repeated=False)
    shared = spark.sparkContext.broadcast(bits)

    def maybe(parts):
        for b in parts:
            yield b.filter(pa.array(may_contain(shared.value, m, b.column("fp").to_numpy())))

    hits = attach(every.mapInArrow(maybe, OCCURRENCE), again, "fp", "times", every.count()).where("times is not null")
    hits = store.put("hits", hits)
    end = (F.col("start") + F.col("n") + (WINDOW - 1)).alias("end")
    spans = [hits.where("uniform").select("doc_id", "row", "start", end)]
    # blocks that share an anchor but differ: equal blocks first, then single windows
    mixed = hits.where("not uniform")
    blocks = store.put("blocks", mixed.groupBy("fp", "block").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "row", "start", "n")).alias("first")))
    whole = attach(mixed.withColumn("both", F.struct("fp", "block")), blocks.where("size > 1").select(F.struct("fp", "block").alias("both"), "size"), "both", "size", hits.count())
    spans.append(whole.where("size is not null").select("doc_id", "row", "start", end))
    lists = blocks.groupBy("first.doc_id", "first.row").agg(F.collect_list(F.struct("first.start", "first.n", "fp", (F.col("size") == 1).alias("sole"))).alias("parts"))
    lists = store.put("lists", lists)
    ids = lists.select("doc_id").distinct()
    near = docs.join(F.broadcast(ids.withColumnRenamed("doc_id", "d")), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi") if lists.count() <= SMALL else docs
    windows = store.put("windows", window_hashes(near, lists))
    twice = store.put("twice", windows.groupBy("fp", "w").agg(F.count("*").alias("size")).where("size > 1").select(F.struct("fp", "w").alias("both"), "size"))
    single = attach(windows.where("sole").withColumn("both", F.struct("fp", "w")), twice, "both", "size", windows.count())
    spans.append(single.where("size is not null").select("doc_id", "row", "start", (F.col("start") + WINDOW).alias("end")))
    every = spans[0].union(spans[1]).union(spans[2])
    out = store.put("spans", every.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    store.drop("hits", "blocks", "lists", "windows", "twice", "again", *(f"batch{i}" for i in range(batches)))
    return out


def substring_dedup(docs: DataFrame, store: Stored | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (kept words joined by one space).

    A word goes if a 35-word window that covers it starts anywhere else, in the same document or
    another, judged on the input, whatever the number of batches. Null, empty and shorter texts
    have no windows; very long texts are read whole; an empty table gives an empty result. Repeated
    rows repeat each other's windows. Equal windows are told by two hashes of 64 bits over all
    their words. Other columns are ignored.
    """
    store, docs = store or Stored(docs.sparkSession), docs.select("doc_id", "text")
    spans = repeated_spans(docs, store, batches)
    small = (spans.agg(F.sum(F.size("spans") + 2)).first()[0] or 0) <= SMALL
    return cut_spans(docs, F.broadcast(spans) if small else spans)
