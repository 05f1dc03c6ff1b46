"""Ranked lexical search: MaxScore over the postings of one shard after another.

The documents become bags of the queries' terms once. A shard is a bounded run of bags; its postings
are inverted in memory, each list with the most it can add to a score. For each query the lists
whose bounds together stay below the 20th best score so far are non-essential: documents come from
the essential lists only, and a non-essential list is probed for those that can still qualify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored
from .ragged import pieces, tidy, words

#: Results a query gets, bytes of query texts that are broadcast at once (more queries go in further
#: blocks, each over all documents), and postings and documents of a shard.
BEST, BLOCK_BYTES, SHARD, SHARD_DOCS = 20, 4 << 20, 1_500_000, 65_536
#: Fixed values of the score: m = PIVOT - LEAN + LEAN * n / mean n, impact = GRAIN * tf / (1000 * tf + 12 * m).
PIVOT, LEAN, GRAIN = 100, 25, 1_000_000_000

_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


class Queries:
    """A block of queries: their ids, the distinct terms of all, and each one's terms with repeats counted."""

    def __init__(self, ids: list, texts: list):
        w = words(pa.array(texts, pa.string()), _OUTSIDE)
        h = w.hashes(lower=True)
        self.ids = ids
        self.hash, first, back = np.unique(h, return_index=True, return_inverse=True)
        self.size = (w.end - w.start)[first]
        self.at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        data = _SMALL[w.data]
        self.flat = np.concatenate([data[w.start[i] : w.end[i]] for i in first]) if len(first) else np.zeros(0, np.uint8)
        self.terms = [np.unique(back[w.at[i] : w.at[i + 1]], return_counts=True) for i in range(len(ids))]

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each row, row and term of each occurrence of a query's term); equal hashes
        count only if the bytes are equal too."""
        w = words(column, _OUTSIDE)
        h = w.hashes(lower=True)
        if not len(h) or not len(self.hash):
            return w.count, np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        place = np.flatnonzero((self.hash[term] == h) & (self.size[term] == w.end - w.start))
        term, start = term[place], w.start[place]
        size = self.size[term]
        ends = np.cumsum(size)
        offset = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        same = _SMALL[w.data[np.repeat(start, size) + offset]] == self.flat[np.repeat(self.at[term], size) + offset]
        wrong = np.unique(np.repeat(np.arange(len(place)), size)[~same])
        keep = np.ones(len(place), bool)
        keep[wrong] = False
        return w.count, w.doc[place[keep]], term[keep]


def blocks(items: DataFrame, most: int) -> Iterator[Queries]:
    """Queries in blocks of about ``most`` bytes of text, as they stream to the driver."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len((r.text or "").encode()) + 64
        if size >= most:
            yield Queries(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries(ids, texts)


def bags(docs: DataFrame, shared) -> DataFrame:
    """One row per document that has a term: doc_id, n (its terms), and the queries' terms in it with their counts."""

    def run(batches):
        queries = shared.value
        for b in pieces(batches):
            n, row, term = queries.find(b.column("text"))
            key, tf = np.unique(row * max(len(queries.hash), 1) + term, return_counts=True)
            row, term = np.divmod(key, max(len(queries.hash), 1))
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, t)) for x, t in ((term, pa.int32()), (tf, pa.int64()))]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Shard:
    """Postings of a run of bags by term, each with what it adds to a score."""

    def __init__(self, bags: pa.Table, weight: np.ndarray, documents: int, terms: int):
        self.doc, n = bags.column("doc_id"), bags.column("n").to_numpy()
        lists = bags.column("terms").combine_chunks()
        row = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), bags.column("tfs").combine_chunks().flatten().to_numpy()
        m = PIVOT - LEAN + LEAN * n * documents // terms
        adds = weight[term] * (GRAIN * tf // (1000 * tf + 12 * m[row]))
        order = np.argsort(term, kind="stable")
        term, self.row, self.adds = term[order], row[order], adds[order]
        self.from_ = np.searchsorted(term, np.arange(len(weight) + 1))
        self.bound = np.zeros(len(weight), np.int64)
        here = np.flatnonzero(np.diff(self.from_))
        if len(here):
            self.bound[here] = np.maximum.reduceat(self.adds, self.from_[here])
        self.score = np.zeros(len(n), np.int64)

    def best(self, terms: np.ndarray, times: np.ndarray, floor: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all documents that may be among the ``most`` best; ``floor`` is the
        score that one of them has to reach."""
        bound = self.bound[terms] * times
        order = np.argsort(bound, kind="stable")
        order = order[bound[order] > 0]
        reach = np.cumsum(bound[order])
        split = int(np.searchsorted(reach, floor))  # lists before it cannot reach the floor together
        touched = []
        for j in order[split:]:
            a, b = self.from_[terms[j]], self.from_[terms[j] + 1]
            self.score[self.row[a:b]] += times[j] * self.adds[a:b]
            touched.append(self.row[a:b])
        rows = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
        score = self.score[rows]
        self.score[rows] = 0
        for i in range(split - 1, -1, -1):
            if len(rows) > most:
                floor = max(floor, int(np.partition(score, -most)[-most]))
            stay = score + reach[i] >= floor
            rows, score = rows[stay], score[stay]
            if not len(rows):
                break
            j = order[i]
            a, b = self.from_[terms[j]], self.from_[terms[j] + 1]
            at = np.minimum(np.searchsorted(self.row[a:b], rows), b - a - 1)
            score = score + np.where(self.row[a:b][at] == rows, times[j] * self.adds[a:b][at], 0)
        stay = score >= max(floor, 1)
        return rows[stay], score[stay]


def ranked_search(docs: DataFrame, items: DataFrame, most: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``most`` highest-scoring documents of each item: item_id, rank, doc_id, score.

    Equal scores go by ascending doc_id, rows without doc_id last. Repeated rows of documents are
    documents of their own, repeated rows of items are queries of their own. Null and empty texts
    have no terms: such documents are not counted, such items find nothing, as does everything in
    an empty table. Texts of any length count as a whole; other columns are ignored. Terms are told
    apart by 64-bit hash and then by their bytes.
    """
    spark, store = docs.sparkSession, Stored(docs.sparkSession)
    schema = "item bigint, doc_id bigint, score bigint"
    out, before = None, 0
    for queries in blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(queries)  # block_bytes of text and one text at most
        bag = store.put("bags", bags(docs, shared))
        total = bag.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            break
        found = bag.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # the block's terms at most
        weight = np.zeros(len(queries.hash), np.int64)
        weight[found.column("term").to_numpy()] = np.floor(1000 * np.log((2 * total.docs + 2) / (2 * found.column("count").to_numpy() + 1)))
        ranked = bag.mapInArrow(_searcher(shared, weight, total.docs, total.terms, most), schema)
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(queries.ids)], "item bigint, item_id bigint")
        rows = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        rows = store.put(f"ranked-{before}", rows)
        out, before = rows if out is None else out.unionByName(rows), before + 1
        store.drop("bags")
        shared.unpersist()
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def _searcher(shared, weight: np.ndarray, documents: int, terms: int, most: int):
    """Searches the bags of a task shard by shard; what a query has found so far sets its floor."""

    def shards(batches):
        held, postings, rows = [], 0, 0
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                held.append(part)
                postings += len(part.column("terms").flatten())
                rows += part.num_rows
                if postings >= SHARD or rows >= SHARD_DOCS:
                    yield Shard(pa.Table.from_batches(held), weight, documents, terms)
                    held, postings, rows = [], 0, 0
        if held:
            yield Shard(pa.Table.from_batches(held), weight, documents, terms)

    def run(batches):
        queries = shared.value
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries.ids)
        for shard in shards(batches):
            none = shard.doc.is_null().to_numpy()
            ids = shard.doc.fill_null(0).to_numpy()
            for i, (t, times) in enumerate(queries.terms):
                score, doc, lost = top[i]
                rows, found = shard.best(t, times, int(score[-1]) if len(score) == most else 0, most)
                if len(rows):
                    score, doc, lost = (np.concatenate(x) for x in ((score, found), (doc, ids[rows]), (lost, none[rows])))
                    order = np.lexsort((doc, lost, -score))[:most]
                    top[i] = score[order], doc[order], lost[order]
        for i, (score, doc, lost) in enumerate(top):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), pa.array(doc, mask=lost), pa.array(score)], names=["item", "doc_id", "score"])
        tidy()

    return run


#: The same in SQL; tables documents and benchmark.
ORACLE = rf"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS small, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, big, small), term)) AS term FROM d, low),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
q AS (SELECT i, item_id, unnest(regexp_extract_all(translate(text, big, small), term)) AS term FROM b, low),
hits AS (SELECT i, item_id, r, doc_id, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * (({GRAIN} * tf) // (1000 * tf + 12 * ({PIVOT - LEAN} + ({LEAN} * n * docs) // terms))) AS adds
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (r), tot),
s AS (SELECT i, item_id, r, doc_id, sum(adds)::BIGINT AS score FROM hits GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {BEST}"""
