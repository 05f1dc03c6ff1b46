"""MinHash near-deduplication with min-max hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, Stored, attach
from .exact_dedup import bloom_filter, may_contain
from .linking import bucket_links
from .ragged import U64, mix, pieces, shingles, words

#: Permutations (each gives two values), values a band joins, bits of a value kept in the sketch.
PERMUTATIONS, BAND, SKETCH = 64, 4, 8
#: A pair goes on to the exact check if its sketches agree in this share of the values; at a true
#: similarity of 0.75 that is 4.4 standard deviations below the mean. FINE: permutations of the
#: sketch of single bits that nodes of buckets with several groups get, and the share there, as
#: many deviations below: a bit a value tells similarities better than as many bits of fewer values.
AGREE, FINE, FINE_AGREE = 0.565, 1536, 0.697
#: Sets that are sketched at once, which bounds the values that are held.
AT_ONCE = 256


def minmax(rows: np.ndarray, hashes: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Signatures of the shingle sets (sorted by row): the smallest and the largest value of each
    permutation, so that one evaluation serves two signature values."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    seeds, factors = np.random.default_rng(75).integers(0, 1 << 63, (permutations, 2), dtype=np.int64).astype(U64).T
    out = np.empty((len(first), 2 * permutations), U64)
    for i in range(permutations):
        v = (hashes ^ seeds[i]) * (factors[i] * U64(2) + U64(1))
        out[:, 2 * i], out[:, 2 * i + 1] = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
    return out


def sign(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set), bands, sketch; the last three null for
    documents without words."""

    def run(batches):
        for b in pieces(batches):
            n = b.num_rows
            rows, hashes = shingles(words(b.column("text")), k)
            count = np.bincount(rows, minlength=n)
            full = np.flatnonzero(count)
            bands, sketch, keys = np.zeros((n, 2 * PERMUTATIONS // BAND), np.int64), np.zeros((n, 2 * PERMUTATIONS), np.uint8), [None] * n
            if len(full):
                values = mix(minmax(rows, hashes))
                key = np.zeros((len(full), bands.shape[1]), U64)
                for j in range(BAND):
                    key = mix(key + values[:, j::BAND] + np.arange(key.shape[1], dtype=U64))
                bands[full], sketch[full] = key.view(np.int64), (values >> U64(64 - SKETCH)).astype(np.uint8)
                for row, part in zip(full.tolist(), np.split(hashes, np.cumsum(count[full])[:-1]), strict=True):
                    keys[row] = xxhash.xxh3_128_digest(part.tobytes())
            none = count == 0
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()), mask=pa.array(none)) for x in (bands, sketch.view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(keys, pa.binary()), *lists], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch array<bigint>")


def fine_sketch(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One bit of each of the FINE smallest and largest values of the sets that start and end at
    ``at``, none of them empty; a row of bytes for each set."""
    out = np.empty((len(at) - 1, 2 * FINE // 8), np.uint8)
    for i in range(0, len(out), AT_ONCE):
        ends = at[i : i + AT_ONCE + 1]
        rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        out[i : i + AT_ONCE] = np.packbits(mix(minmax(rows, hashes[ends[0] : ends[-1]], FINE)) >> U64(63) != 0, axis=1)
    return out


def sketches_near(a: Column, b: Column, permutations: int = PERMUTATIONS, agree: float = AGREE, bits: int = SKETCH) -> Column:
    """Whether enough values of two sketches (arrays of longs) are equal: of two different values
    half the bits differ, so the differing bits tell their number."""
    differ = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, 2 * permutations * bits // 64):
        differ = differ + F.bit_count(a[i].bitwiseXOR(b[i]))
    return differ <= int(2 * permutations * (1 - agree) * bits / 2)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, items): the sorted shingle hashes of each document."""

    def run(batches):
        for b in pieces(batches):
            rows, hashes = shingles(words(b.column("text")), k)
            at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))], names=["node", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "node bigint, items array<bigint>")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 75, store: Stored | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; a document's set holds its distinct k-word shingles, or its whole
    sequence if it has fewer words. Documents link if 100 * |intersection| >= percent * |union|,
    checked on the full sets; component_id is the smallest doc_id reachable. Null texts and texts
    without words have empty sets and link with nothing. Rows that share a doc_id are one
    document; a row without doc_id links with nothing and stays. Other columns are ignored.
    Very long texts are taken whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = store or Stored(spark)
    signed = store.put("signed", sign(docs, k))
    total = signed.count()
    sets = store.put("sets", signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sig")))
    members = sets.select("node", F.explode("bands").alias("key"))

    def fetch(name: str, nodes: DataFrame) -> DataFrame:
        ids = nodes.withColumnRenamed("node", "doc_id")
        ids = F.broadcast(ids) if nodes.count() <= SMALL else ids
        return store.put(name, shingle_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), k))

    def linked(common: Column, x: Column, y: Column) -> Column:
        return 100 * common >= percent * (x + y - common)

    def verify(pairs: DataFrame) -> DataFrame:
        found = fetch("items", store.put("ids", pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        left, right = found.select(F.col("node").alias("a"), F.col("items").alias("x")), found.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
        return both.where(linked(F.col("common"), F.size("x"), F.size("y")))

    def refine(nodes: DataFrame) -> DataFrame:
        """How many shingles a node has, and how many of them another node may have too."""
        found = fetch("rest", nodes).groupBy("node").agg(F.max("items").alias("items"), F.count("*").alias("sets"))
        found = store.put("once", found.where("sets = 1").select("node", "items"))
        bits, m = bloom_filter(found.select(F.col("items").alias("h")), found.agg(F.sum(F.size("items"))).first()[0] or 0, repeated=True)
        shared = spark.sparkContext.broadcast(bits)

        def count(batches):
            for b in batches:
                at, flat = b.column("items").offsets.to_numpy(), b.column("items").flatten().to_numpy(zero_copy_only=False)
                known = np.concatenate([[0], np.cumsum(may_contain(shared.value, m, flat))])
                at = at - at[0]
                size = np.diff(at).astype(np.int64)
                sketch = fine_sketch(at, flat.view(U64))
                fine = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * (sketch.shape[1] // 8), pa.int32()), pa.array(sketch.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(size), pa.array(known[at[1:]] - known[at[:-1]]), fine], names=["node", "size", "common", "fine"])

        bound = found.mapInArrow(count, "node bigint, size bigint, common bigint, fine array<bigint>").join(sets.select("node", "bands"), "node")
        # a node with several texts may link whatever the numbers say
        return nodes.join(bound, "node", "left").select("node", F.when(F.col("size").isNotNull(), F.struct("size", "common", "fine", "bands")).alias("bound"))

    def possible(a: Column, b: Column, key: Column) -> Column:
        """Two sets have no more in common than either has with anything, an exact bound; a pair
        is looked at in the first of its common bands only."""
        fits = linked(F.least(a["common"], b["common"]), a["size"], b["size"]) & sketches_near(a["fine"], b["fine"], FINE, FINE_AGREE, bits=1)
        first = F.element_at(F.array_intersect(a["bands"], b["bands"]), 1)
        return F.coalesce(fits & (first == key), F.lit(True))

    comp = bucket_links(store, members, sets.select("node", "sig"), sketches_near, verify, refine, possible)
    groups = sets.select("set_key", "node", "size").join(comp, "node", "left").select("set_key", "size", F.coalesce("comp", "node").alias("component_id"))
    slim = signed.select("doc_id", "n_shingles", "set_key")
    linked = attach(slim.where("set_key is not null"), store.put("groups", groups), "set_key", "size", total).unionByName(
        slim.where("set_key is null"), allowMissingColumns=True)
    return linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
