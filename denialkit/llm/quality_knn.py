"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, labelled
from .ragged import U64, mix, pieces, words

#: Buckets of word terms and of style terms, latent dimensions, neighbours, and labelled documents
#: of each label (the documented bound of the fit).
WORDS, STYLES, DIMENSIONS, NEIGHBOURS, SAMPLE = 2048, 2048, 64, 15, 2000
FOLD, HELD_OUT = 3, 1


def terms(column: pa.Array) -> np.ndarray:
    """Counts of each text's terms, hashed: its words, and how each word looks (capitals, digits,
    last signs, length, whether it repeats the word before it)."""
    w, n = words(column), len(column)
    h = w.hashes(lower=True)
    out = np.zeros((n, WORDS + STYLES), np.float32)
    if not len(h):
        return out
    d, size = w.data, w.end - w.start
    first, last, second = d[w.start], d[w.end - 1], d[np.maximum(w.end - 2, w.start)]
    sums = np.concatenate([[0], np.cumsum((d >= 65) & (d <= 90))])
    upper = sums[w.end] - sums[w.start]
    sums = np.concatenate([[0], np.cumsum((d >= 48) & (d <= 57))])
    digits = sums[w.end] - sums[w.start]
    plain = lambda b: ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128) | (b >= 48) & (b <= 57)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    case = np.where(upper * 2 > size, 2, np.where((first >= 65) & (first <= 90), 1, 0))
    look = [case * 4 + 2 * (digits > 0) + (digits * 2 > size), np.where(plain(last), 0, last).astype(np.int64) * 256 + np.where(plain(second), 0, second), again * 16 + np.minimum(size // 4, 7)]
    for j, kind in enumerate([look[0], look[1], look[2], look[0] * 65536 + look[1]]):
        bucket = WORDS + (mix(kind.astype(U64) + U64(1000003 * (j + 1))) % U64(STYLES)).astype(np.int64)
        out += np.bincount(w.doc * (WORDS + STYLES) + bucket, minlength=out.size).reshape(out.shape)
    out += np.bincount(w.doc * (WORDS + STYLES) + (h % U64(WORDS)).astype(np.int64), minlength=out.size).reshape(out.shape)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with share-of-text frequencies; the two kinds of terms have unit length each."""
    x = np.sqrt(counts) * idf
    for part in (x[:, :WORDS], x[:, WORDS:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    x[:, :WORDS] *= 0.5
    return x


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many of all documents have each term; one row a task and term moves."""

    def count(batches):
        total = np.zeros(WORDS + STYLES, np.int64)
        n = 0
        for b in pieces(batches, rows=512):
            total += (terms(b.column("text")) > 0).sum(axis=0)
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"term": np.arange(-1, len(total), dtype=np.int32), "n": np.concatenate([[n], total])})

    rows = docs.select("text").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(WORDS + STYLES + 1)
    for r in rows:
        out[r.term + 1] = r.n
    return out


def latent(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors of x (terms x rank) by a randomised range finder."""
    rng = np.random.default_rng(seed)
    y = x @ rng.standard_normal((x.shape[1], rank + 10)).astype(np.float32)
    for _ in range(2):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    return np.ascontiguousarray(np.linalg.svd(np.linalg.qr(y)[0].T @ x, full_matrices=False)[2][:rank].T, np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(v: np.ndarray, neighbours: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Share of label 1 among the k nearest by cosine, each weighted by its similarity and by how
    many training rows a sampled row of its label stands for."""
    cos = v @ neighbours.T
    k = min(k, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6) ** 4 * weight[near]
    return (w * y[near]).sum(axis=1) / w.sum(axis=1)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of docs, and ``score`` (which replaces a column of that name).

    Term frequencies come from all documents; the latent space and the neighbours from at most
    ``sample`` labelled documents of each label outside the held-out fold. Null and empty texts
    have no terms and score the share of label 1 among all labelled rows of the fit; without any
    labels every score is 0.5. Neighbours that tie at the edge count in the order of the sample,
    which is sorted. An empty table gives an empty result; very long texts are read whole. Repeated rows are scored each, other columns are ignored.
    """
    spark = docs.sparkSession
    df = document_frequencies(docs)
    idf = np.log((df[0] + 1) / (df[1:] + 1)).astype(np.float32) + np.float32(0.1)
    chosen, counts = labelled(docs, labels, "quality", FOLD, HELD_OUT, sample)

    def sparse(batches):
        for b in pieces(batches, rows=512):
            x = terms(b.column("text"))
            for row, y in zip(x, b.column("label").to_pylist(), strict=True):
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_pydict({"at": pa.array([at.astype(np.int16)], pa.list_(pa.int16())), "n": pa.array([row[at]], pa.list_(pa.float32())), "label": [y]}, schema=pa.schema([("at", pa.list_(pa.int16())), ("n", pa.list_(pa.float32())), ("label", pa.int32())]))

    rows = chosen.mapInArrow(sparse, "at array<smallint>, n array<float>, label int").toArrow()  # 2 * sample rows at most
    x, y = np.zeros((rows.num_rows, WORDS + STYLES), np.float32), np.zeros(rows.num_rows, np.float32)
    given = sorted(zip(rows.column("label").to_pylist(), rows.column("at").to_pylist(), rows.column("n").to_pylist(), strict=True))
    for i, (label, at, n) in enumerate(given):
        x[i, at], y[i] = n, label
    if len(y):
        x = weigh(x, idf)
        basis = latent(x, min(DIMENSIONS, *x.shape))
        weight = np.where(y == 1, counts.get(1, 0) / max(y.sum(), 1), counts.get(0, 0) / max((1 - y).sum(), 1)).astype(np.float32)
        model = spark.sparkContext.broadcast((idf, basis, unit(x @ basis), y, weight))

    def score(batches):
        for b in pieces(batches, rows=512):
            if len(y):
                f, v, near, label, w = model.value
                x = terms(b.column("text"))
                s = vote(unit(weigh(x, f) @ v), near, label, w, NEIGHBOURS).astype(np.float64)
                s[~x.any(axis=1)] = prior
            else:
                s = np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=schema.names)

    prior = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    y = y[:1]  # the tasks need no more than whether there are labels
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def quality_knn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; see ``quality_scores``."""
    scored = quality_scores(docs.select("doc_id", "text"), labels, sample)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLD) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
