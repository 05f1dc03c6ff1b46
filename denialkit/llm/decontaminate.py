"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and answers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import U64, pieces, take, words
from .toxicity_gbt import _APART as APART

#: Hash buckets of term frequencies; words of a query passage at most, of a cell, and cells of a
#: document passage (any query passage lies whole inside one); queries and dimensions of a block,
#: and blocks of one pass over the documents.
BUCKETS, QUERY, CELL, CELLS, BLOCK, BLOCKS = 1 << 18, 32, 16, 3, 512, 8
#: Cosine of a candidate; share of an item's words in order that makes a leak, and the share that
#: does so if the item's rarest words (its answer terms) are there too.
COSINE, COPY, PARAPHRASE, ANSWER = 0.3, 0.75, 0.5, 0.6


def fold(text: Column) -> Column:
    """Lower case for all letters; sharp s as the ss of its capitals, the final sigma as any other."""
    return F.replace(F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss")), F.lit("\u03c2"), F.lit("\u03c3"))


def term_frequencies(docs: DataFrame) -> np.ndarray:
    """Occurrences of each hash bucket in all documents."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in pieces(batches):
            total += np.bincount((words(b.column("text"), APART).hashes(lower=True) % U64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
    out = np.zeros(BUCKETS)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


def weights(n: np.ndarray) -> np.ndarray:
    """Cubed inverse log frequencies: function words weigh little against the words that tell
    passages apart."""
    return (np.log((n.sum() + 1) / (n + 1)) ** 3).astype(np.float32)


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, hashes, item): the query passages of every item that has words; equal parts
    of at most QUERY words, and the hashes of the whole item's words."""

    def cut(batches):
        for b in pieces(batches):
            w = words(b.column("text"), APART)
            h = w.hashes(lower=True).view(np.int64)
            ids, rows = b.column("item_id").to_pylist(), []
            for i, (s, e) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
                if e > s:
                    rows += [(ids[i], k, part.tolist(), h[s:e].tolist()) for k, part in enumerate(np.array_split(h[s:e], -(-(e - s) // QUERY)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["item_id", "part", "hashes", "item"])

    return benchmark.select("item_id", "text").mapInArrow(cut, "item_id bigint, part int, hashes array<bigint>, item array<bigint>")


def latent_space(queries: DataFrame, idf: np.ndarray, terms: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF passages, by a randomised SVD.

    Each task multiplies its own passages; the products meet by term. ``queries`` holds one block,
    so the matrices on the driver are BLOCK passages wide at most.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((idf, terms))

    def product(right):
        """A'(A x), term by term."""
        given = spark.sparkContext.broadcast(right)

        def part(batches):
            f, t = shared.value
            out = np.zeros((len(t), given.value.shape[1]), np.float32)
            for b in batches:
                a = tf_idf([np.array(x, np.int64).view(U64) for x in b.column("hashes").to_pylist()], f, t)
                out += a.T @ (a @ given.value)
            yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(len(t)), pa.int32()), "row": pa.array([x.tobytes() for x in out], pa.binary())})

        def merge(batches):
            sums: dict = {}
            for b in batches:
                for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(x, np.float32)
                    sums[t] = sums[t] + x if t in sums else x
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(sums), pa.int32()), "row": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

        rows = queries.select("hashes").mapInArrow(part, "term int, row binary").repartition("term").mapInArrow(merge, "term int, row binary").toArrow()
        out = np.zeros_like(right)
        out[rows.column("term").to_numpy()] = [np.frombuffer(x, np.float32) for x in rows.column("row").to_pylist()]
        return out

    wide = min(len(terms), rank + 10)
    basis = np.linalg.qr(product(np.random.default_rng(9).standard_normal((len(terms), wide)).astype(np.float32)))[0]
    basis = np.linalg.qr(product(basis))[0].astype(np.float32)  # a power iteration
    gram = basis.T @ product(basis)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-6]
    return (basis @ vectors[:, keep]).astype(np.float32)


def tf_idf(rows: list[np.ndarray], idf: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Dense rows over the sorted term hashes, of unit length; a term counts once a passage."""
    out = np.zeros((len(rows), len(terms)), np.float32)
    for i, h in enumerate(rows):
        out[i, np.searchsorted(terms, h)] = idf[(h % U64(BUCKETS)).astype(np.int64)]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def common_in_order(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for x in region:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Block:
    """Query passages of one block in the latent space."""

    def __init__(self, rows: list, basis: np.ndarray, idf: np.ndarray, terms: np.ndarray):
        self.terms, self.basis = terms, basis
        self.scaled = basis * idf[(terms % U64(BUCKETS)).astype(np.int64)][:, None]
        self.items = np.array([r.item_id for r in rows])
        queries = tf_idf([np.array(r.hashes, np.int64).view(U64) for r in rows], idf, terms)
        self.vectors, self.most = queries @ basis, queries.max(axis=0)
        self.words = {r.item_id: np.array(r.item, np.int64).view(U64).tolist() for r in rows}
        self.answers = {}
        for item, h in self.words.items():
            rarest = sorted(set(h), key=lambda x: (-idf[x % BUCKETS], x))
            self.answers[item] = set(rarest[: max(3, len(rarest) // 4)])
        self.post(idf)

    def post(self, idf: np.ndarray) -> None:
        """Postings of each item's key terms, the rarest that make half of its words and all its
        answer terms. A leak has 60 % of the answer terms, or 75 % of all words and so all but a
        quarter of the item's words among its key terms: whatever the weights, none is passed over."""
        self.ids, rows = list(self.words), []
        self.length = np.array([len(self.words[i]) for i in self.ids], np.int64)
        self.some_answers, self.some_words = np.zeros((2, len(self.ids)))
        for k, item in enumerate(self.ids):
            times, have, h = Counter(self.words[item]), 0, self.words[item]
            for j, x in enumerate(sorted(times, key=lambda x: (-idf[x % BUCKETS], x))):
                if 2 * have >= len(h) and j >= len(self.answers[item]):
                    break
                rows.append((x, k, x in self.answers[item], times[x]))
                have += times[x]
            self.some_answers[k] = ANSWER * len(self.answers[item])
            self.some_words[k] = have - (1 - COPY) * len(h)
        rows.sort()
        self.keys, self.first = np.unique(np.array([r[0] for r in rows], U64), return_index=True)
        self.first = np.append(self.first, len(rows))
        self.post_item, self.post_answer, self.post_times = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))

    def stretches(self, w, h: np.ndarray):
        """(row, item number, first word, last word) of all stretches that can hold a leak. The
        region around a passage lies whole inside one of the stretches, which are two regions long."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        at = at[hit]
        post, ends = take(np.arange(len(self.post_item)), self.first[:-1], np.diff(self.first), at)
        hit = np.repeat(hit, np.diff(ends))
        item, row = self.post_item[post], w.doc[hit]
        part = (hit - w.at[row]) // (CELL * CELLS + 2 * self.length[item])
        parts = int(part.max(initial=0)) + 1
        both = np.concatenate([(row * parts + part) * len(post_of := self.post_item) + post, ((row * parts + part - 1) * len(post_of) + post)[part > 0]])
        place, post = np.divmod(np.unique(both), len(post_of))  # a term counts once a stretch
        key, group = np.unique(place * len(self.ids) + post_of[post], return_inverse=True)
        place, item = np.divmod(key, len(self.ids))
        answers = np.bincount(group, weights=self.post_answer[post], minlength=len(key))
        words_ = np.bincount(group, weights=self.post_times[post], minlength=len(key))
        can = np.flatnonzero((answers >= self.some_answers[item] - 1e-6) | (words_ >= self.some_words[item] - 1e-6))
        row, part = np.divmod(place[can], parts)
        size = CELL * CELLS + 2 * self.length[item[can]]
        return zip(row.tolist(), item[can].tolist(), (part * size).tolist(), ((part + 2) * size).tolist(), strict=True)

    def cosine(self, h: np.ndarray, weight: np.ndarray, item: int) -> float:
        """The largest cosine of a document passage with the item's query passages."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        x = self.scaled[np.unique(at[self.terms[at] == h])].sum(axis=0)
        return float((self.vectors[self.items == item] @ x).max() / np.sqrt(max(float((weight**2).sum()), 1e-12)))

    def search(self, w, h: np.ndarray, weight: np.ndarray):
        """(row, item, cosine, share in order, share of answer terms, first word) of each leak."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        cells = -(-w.count // CELL)
        first = np.concatenate([[0], np.cumsum(cells)])
        place = np.arange(len(h)) - w.at[w.doc]
        cell = first[w.doc] + place // CELL
        both = np.stack([np.bincount(cell, weights=weight**2, minlength=first[-1]), np.bincount(cell, weights=np.where(known, weight * self.most[at], 0), minlength=first[-1])])
        owner = np.repeat(np.arange(len(cells)), cells)
        size = both.copy()
        for j in range(1, CELLS):  # passages of CELLS cells of one document
            same = owner[j:] == owner[:-j]
            size[:, : len(owner) - j] += both[:, j:] * same
        norm = np.sqrt(np.maximum(size[0], 1e-12))
        # a passage's product with any query is at most the sum of its terms' largest products
        likely = np.flatnonzero(size[1] >= COSINE * norm) if len(owner) else []
        best: dict[tuple[int, int], tuple] = {}
        words_at = np.searchsorted(cell, np.arange(first[-1] + 1))
        for i in range(0, len(likely), 512):
            some = likely[i : i + 512]
            last = np.minimum(some + CELLS, first[owner[some] + 1])
            s, e = words_at[some], words_at[last]
            own, ends = take(np.arange(len(h)), s, e - s, np.arange(len(some)))
            which = np.repeat(np.arange(len(some)), np.diff(ends))[known[own]]
            cells_ = np.unique(which * len(self.terms) + at[own[known[own]]])  # a term counts once a passage
            which, term = np.divmod(cells_, len(self.terms))
            x = np.zeros((len(some), self.basis.shape[1]), np.float32)
            begin = np.flatnonzero(np.diff(which, prepend=-1))
            x[which[begin]] = np.add.reduceat(self.scaled[term], begin, axis=0)
            cos = x @ self.vectors.T / norm[some][:, None]
            for k, q in np.argwhere(cos >= COSINE).tolist():
                row, item = int(owner[some[k]]), int(self.items[q])
                found = self.check(w, h, row, item, int(words_at[some[k]]), int(words_at[last[k]]))
                if found and ((row, item) not in best or found[:2] > best[row, item][0][:2]):
                    best[row, item] = (found, float(cos[k, q]))
        for row, k, s, e in self.stretches(w, h):
            item, own, start, stop = self.ids[k], self.words[self.ids[k]], int(w.at[row]), int(w.at[row + 1])
            if not self.judge(item, h[start + s : min(stop, start + e)].tolist()):
                continue
            for c in range(s // CELL, -(-min(stop - start, e) // CELL)):
                a, b = start + c * CELL, min(stop, start + (c + CELLS) * CELL)
                if max(0, c * CELL - len(own)) >= s and (found := self.check(w, h, row, item, a, b)) and ((row, item) not in best or found[:2] > best[row, item][0][:2]):
                    best[row, item] = (found, self.cosine(h[a:b], weight[a:b], item))
        return [(row, item, cos, *found) for (row, item), (found, cos) in best.items()]

    def judge(self, item: int, region: list[int]):
        """The share of the item's words in order and of its answer terms, if they make a leak."""
        own = self.words[item]
        answer = len(self.answers[item].intersection(region)) / len(self.answers[item])
        share = common_in_order(own, region) / len(own)
        return (share, answer) if share >= COPY or share >= PARAPHRASE and answer >= ANSWER else None

    def check(self, w, h: np.ndarray, row: int, item: int, start: int, end: int):
        own = self.words[item]
        s, e = max(int(w.at[row]), start - len(own)), min(int(w.at[row + 1]), end + len(own))
        found = self.judge(item, h[s:e].tolist())
        return found and (*found, s - int(w.at[row]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, in_order, answer, place): documents that hold a benchmark item.

    Terms are runs of letters and digits, compared without case in any script. A document holds an item if 75 % of the
    item's words come in order around any passage (48 words from every 16th, and as many on both
    sides as the item has), or 50 % and 60 % of its answer terms. Passages whose TF-IDF cosine with a
    query passage reaches 0.3 in the latent space are compared first, then all others that the
    item's key terms allow, so that no leak depends on the weights. place is the first word of the
    compared region. Frequencies come from all documents; every item is looked
    for in every whole document, in blocks of 512 query passages. Null or empty texts and items
    match nothing; repeated rows give repeated results; other columns are ignored. Without documents
    or without items there is no result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", fold(F.col("text")).alias("text"))
    n = term_frequencies(docs)
    idf = weights(n)
    found = passages(benchmark.where(F.col("item_id").isNotNull()).select("item_id", fold(F.col("text")).alias("text")))
    total, out = found.count(), None
    groups = max(1, -(-total // BLOCK))
    parted = found.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    for first in range(0, groups, BLOCKS):
        blocks = []
        for g in range(first, min(groups, first + BLOCKS)):
            queries = parted.where(F.col("block") == g)
            rows = queries.collect()  # about BLOCK passages of QUERY words
            if rows:
                terms = np.unique(np.concatenate([np.array(r.hashes, np.int64) for r in rows]).view(U64))
                blocks.append(Block(rows, latent_space(queries, idf, terms, BLOCK), idf, terms))
        shared = spark.sparkContext.broadcast((blocks, idf))

        def search(batches, shared=shared):
            blocks, f = shared.value
            for b in pieces(batches, limit=1 << 20):
                w = words(b.column("text"), APART)
                h = w.hashes(lower=True)
                weight = f[(h % U64(BUCKETS)).astype(np.int64)]
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[r], *x) for k in blocks for r, *x in k.search(w, h, weight)]
                columns = zip(*rows, strict=True) if rows else ([],) * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "cosine", "in_order", "answer", "place"])

        part = docs.mapInArrow(search, "doc_id bigint, item_id bigint, cosine double, in_order double, answer double, place bigint")
        out = part if out is None else out.union(part)
    return out
