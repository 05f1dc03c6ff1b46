"""Exact deduplication: two-pass Bloom filtering, so that only possibly repeated hashes shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, ascii_lower, attach

#: Slots of a filter page, hash positions per row, slots per row, and the largest filter (2**30
#: slots are 128 MB; beyond 2**27 rows the filter only grows less selective, never wrong).
PAGE, POSITIONS, PER_ROW, MOST = 1 << 16, 3, 8, 1 << 30


def _slots(h: np.ndarray, m: int) -> np.ndarray:
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.concatenate([(h + step * np.uint64(j)) & np.uint64(m - 1) for j in range(POSITIONS)]).astype(np.int64)


def _add(pages: dict, page: int, once: np.ndarray, twice: np.ndarray) -> None:
    """Adds saturating two-valued counters: twice holds the slots that two or more rows hit."""
    if page in pages:
        o, t = pages[page]
        t |= twice | (o & once)
        o |= once
    else:
        pages[page] = (once, twice)


def _rows(pages: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"page": pa.array(list(pages), pa.int32()), "once": pa.array([o.tobytes() for o, _ in pages.values()], pa.binary()), "twice": pa.array([t.tobytes() for _, t in pages.values()], pa.binary())})


def bloom_filter(hashes: DataFrame, rows: int, repeated: bool) -> tuple[bytes, int]:
    """A Bloom filter of the column ``h`` (longs or lists of longs, ``rows`` in all), or with ``repeated`` of the hashes that at least two
    rows may share.

    Every task fills its own pages; pages meet by number and merge as they stream, so no task
    holds more than its share of the filter. Returns the filter's bits and its slots.
    """
    m = PAGE
    while m < PER_ROW * rows and m < MOST:
        m *= 2

    def fill(batches):
        pages: dict = {}
        for b in batches:
            h = b.column("h").flatten() if pa.types.is_list(b.column("h").type) else b.column("h")
            slots, counts = np.unique(_slots(h.to_numpy(zero_copy_only=False), m), return_counts=True)
            cuts = np.flatnonzero(np.diff(slots // PAGE)) + 1
            for s, c in zip(np.split(slots, cuts), np.split(counts, cuts), strict=True):
                if len(s):
                    bits = np.zeros((2, PAGE), bool)
                    bits[0, s % PAGE] = True
                    bits[1, (s % PAGE)[c > 1]] = True
                    _add(pages, int(s[0]) // PAGE, *np.packbits(bits, axis=1))
        yield _rows(pages)

    def merge(batches):
        pages: dict = {}
        for b in batches:
            for page, once, twice in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _add(pages, page, np.frombuffer(once, np.uint8).copy(), np.frombuffer(twice, np.uint8).copy())
        yield _rows(pages)

    schema = "page int, once binary, twice binary"
    merged = hashes.select("h").mapInArrow(fill, schema).repartition("page").mapInArrow(merge, schema).select("page", "twice" if repeated else "once")
    bits = bytearray(m // 8)
    for page, part in merged.collect():  # m / 8 bytes in all, 128 MB at most
        bits[page * PAGE // 8 : (page + 1) * PAGE // 8] = part
    return bytes(bits), m


def may_contain(bits: bytes, m: int, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds; it never misses one."""
    slots = _slots(h, m)
    hit = (np.frombuffer(bits, np.uint8)[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
    return hit.reshape(POSITIONS, -1).all(axis=0)


def exact_dedup(docs: DataFrame, store: Stored | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. The largest
    doc_id of equal texts stays (a null doc_id is smaller than any; rows that repeat the largest
    doc_id are all marked kept). Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = store or Stored(spark)
    slim = docs.select("doc_id", F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"))
    slim = store.put("hashes", slim.withColumn("h", F.xxhash64("text_sha256")))
    total = slim.count()
    bits, m = bloom_filter(slim, total, repeated=True)
    shared = spark.sparkContext.broadcast(bits)

    def mark(batches):
        for b in batches:
            again = may_contain(shared.value, m, b.column("h").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(again)], names=[*b.schema.names, "again"])

    marked = slim.mapInArrow(mark, f"{', '.join(f'{n} {t}' for n, t in slim.dtypes)}, again boolean").drop("h")
    maybe = marked.where("again").drop("again")
    once = marked.where("not again").drop("again").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint")})
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    grouped = attach(maybe, store.put("groups", groups), "text_sha256", "group_size", total)
    grouped = grouped.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("bigint"))})
    return once.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
