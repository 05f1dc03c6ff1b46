"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled
from .ragged import LOOKALIKE, Words, pieces, words

FOLD, HELD_OUT = 5, 0
#: Labelled documents of each label in the fit (its documented bound), lexicon entries, head
#: lengths in bytes, trees, their depth and learning rate, and bins of a feature.
SAMPLE, LEXICON, HEADS, TREES, DEPTH, RATE, BINS = 4000, 512, (4, 5, 6), 80, 3, 0.15, 32
#: Fixed words: second person in the languages at hand.
SECOND_PERSON = "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer usted ustedes ti tus vosotros".split()
_APART = np.ones(256, bool)
for _part in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _APART[list(_part)] = False


def hashed(terms: list[str]) -> np.ndarray:
    """Hashes of lower-case terms, as ``Words.hashes`` gives them."""
    if not terms:
        return np.zeros(0, np.uint64)
    return words(pa.array(terms)).hashes(lower=True)


def learn_lexicon(chosen: DataFrame) -> dict[str, list[tuple[str, float]]]:
    """Terms with the largest log-odds of label 1, for whole words and for word heads."""

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in pieces(batches):
            w = words(b.column("text"), _APART)
            data = w.data.tobytes().lower()
            spans, at = list(zip(w.start.tolist(), w.end.tolist(), strict=True)), w.at.tolist()
            for i, y in enumerate(b.column("label").to_pylist()):
                own = {data[s:e] for s, e in spans[at[i] : at[i + 1]]}
                seen[y].update((0, t) for t in own)
                for k in HEADS:
                    seen[y].update({(k, t[:k]) for t in own if len(t) > k})
        rows = [(k, t, y, n) for y, c in seen.items() for (k, t), n in c.items()]
        yield pa.RecordBatch.from_pydict({"head": pa.array([r[0] for r in rows], pa.int32()), "term": pa.array([r[1] for r in rows], pa.binary()), "y": pa.array([r[2] for r in rows], pa.int32()), "n": pa.array([r[3] for r in rows], pa.int64())})

    size = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    tox, non = max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    table = chosen.mapInArrow(count, "head int, term binary, y int, n bigint").groupBy("head", "term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("o"))
    odds = F.log((F.col("t") + 0.5) / tox) - F.log((F.col("o") + 0.5) / non)
    strong = table.where(F.col("t") >= max(4, tox // 400)).withColumn("odds", odds).where("odds > 1.5")
    rows = strong.orderBy(F.desc(F.col("odds") * F.log1p("t")), "term").limit(LEXICON).collect()
    return {k: sorted((r.term, r.odds) for r in rows if r["head"] == k) for k in (0, *HEADS)}


def head_hashes(entries) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of byte terms, and their odds."""
    if not entries:
        return np.zeros(1, np.uint64), np.zeros(1)
    data = b"".join(t for t, _ in entries)
    end = np.cumsum([len(t) for t, _ in entries])
    start = end - [len(t) for t, _ in entries]
    h = Words(np.frombuffer(data, np.uint8), start, end, start, start).hashes(lower=True)
    order = np.argsort(h)
    return h[order], np.array([o for _, o in entries])[order]


def features(column: pa.Array, lexicon: dict) -> np.ndarray:
    """Dense features of each text: lexicon densities, second-person proximity, capitals,
    punctuation and obfuscation rates."""
    n = len(column)
    w = words(column, _APART)
    doc, total = w.doc, np.maximum(w.count, 1).astype(float)
    per = lambda v, d=doc: np.bincount(d, weights=v, minlength=n)

    def odds_of(h, kind):
        keys, odds = lexicon[kind]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, odds[at], 0.0)

    whole, *heads = w.hashes(lower=True, heads=HEADS)
    long = [np.where(w.end - w.start > k, 1.0, 0.0) for k in HEADS]
    exact = odds_of(whole, 0)
    head = np.maximum.reduce([odds_of(h, k) * m for h, k, m in zip(heads, HEADS, long, strict=True)])
    person = np.isin(whole, lexicon["person"])
    place = np.arange(len(doc))
    hits = np.flatnonzero((exact > 0) | (head > 0))
    people = np.flatnonzero(person)
    near = np.zeros(len(doc))
    if len(people) and len(hits):
        right = np.searchsorted(people, hits)
        for side in (np.minimum(right, len(people) - 1), np.maximum(right - 1, 0)):
            other = people[side]
            near[hits] = np.maximum(near[hits], np.where(doc[other] == doc[hits], np.exp(-np.abs(other - place[hits]) / 5), 0))
    columns = []
    for v in (exact, head, np.maximum(exact, head)):
        most = np.zeros(n)
        np.maximum.at(most, doc[v > 0], v[v > 0])
        count = per(v > 0)
        columns += [count / total, np.log1p(count), per(v) / total, most]
    columns += [per(person) / total, per(near) / total, np.log1p(per(near)), np.log1p(w.count)]
    # whole words between spaces: capitals, signs inside words, look-alikes
    s = words(column)
    spaced, size = np.maximum(s.count, 1).astype(float), s.end - s.start
    cum = lambda mask: (lambda c: c[s.end] - c[s.start])(np.concatenate([[0], np.cumsum(mask)]))
    upper = cum((s.data >= 65) & (s.data <= 90))
    letters = cum((s.data | 32 >= 97) & (s.data | 32 <= 122) | (s.data >= 128))
    digits = cum((s.data >= 48) & (s.data <= 57))
    marks = size - letters - digits
    inner = marks - (size > 0) * (_APART[s.data[np.maximum(s.end - 1, 0)]] if len(size) else 0)
    mixed = (letters > 0) & ((digits > 0) | (inner > 0))
    disguised = np.where(mixed, odds_of(s.hashes(codes=LOOKALIKE), "lookalike"), 0)
    sper = lambda v: np.bincount(s.doc, weights=v, minlength=n)
    nbytes = np.maximum(sper(size), 1)
    same = np.zeros(len(s.data))
    if len(s.data) > 2:
        same[2:] = (s.data[2:] == s.data[1:-1]) & (s.data[1:-1] == s.data[:-2])
    columns += [sper(upper) / nbytes, sper((upper == letters) & (letters > 1)) / spaced, sper(marks) / nbytes, sper(digits) / nbytes, sper(mixed) / spaced, sper(disguised > 0) / spaced, sper(cum(s.data == 33)) / spaced, sper(cum(s.data == 63)) / spaced, sper(cum(same)) / nbytes]
    return np.stack(columns, axis=1).astype(np.float32)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.bias, self.trees = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
        bins, f = self._bins(x), np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._tree(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._leaf(tree, bins)
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _tree(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Splits level by level; (features, bins) of inner nodes in heap order, and leaf values."""
        node, splits = np.zeros(len(g), np.int64), []
        for depth in range(DEPTH):
            n, best = 1 << depth, None
            cells = node * BINS
            gains = []
            for j in range(bins.shape[1]):
                gs, hs = (np.bincount(cells + bins[:, j], weights=v, minlength=n * BINS).reshape(n, BINS).cumsum(axis=1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gains.append(np.where((hs < 1) | (ht - hs < 1), 0, gain))
            best = np.stack(gains).transpose(1, 0, 2).reshape(n, -1).argmax(axis=1)
            feature, at = best // BINS, best % BINS
            splits.append((feature, at))
            node = 2 * node + (bins[np.arange(len(g)), feature[node]] > at[node])
        gs, hs = (np.bincount(node, weights=v, minlength=1 << DEPTH) for v in (g, h))
        return splits, RATE * gs / (hs + 1)

    @staticmethod
    def _leaf(tree, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for feature, at in tree[0]:
            node = 2 * node + (bins[np.arange(len(bins)), feature[node]] > at[node])
        return tree[1][node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return self.bias + sum((self._leaf(t, bins) for t in self.trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (margin, probability), non-decreasing."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([t * w, w, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][3] = hi
    knots = [(m, s / w) for s, w, lo, hi in blocks for m in (lo, hi)]
    return np.array([m for m, _ in knots]), np.array([p for _, p in knots])


def toxicity_gbt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The lexicon, the trees and the calibration are fitted on at most ``sample`` labelled documents
    of each label outside the held-out fold (three quarters grow the trees, one calibrates them,
    weighted to the labels' shares among all training rows). Null and empty texts have zero
    features and get the score of such a text; without both labels every score is the share of
    label 1. Repeated rows are scored each, other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chosen, counts = labelled(docs, labels, "toxic", FOLD, HELD_OUT, sample)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    found = learn_lexicon(chosen)
    lexicon = {k: head_hashes(v) for k, v in found.items()}
    plain = [(t, o) for t, o in found[0] if t.isalpha()]
    lexicon |= {"person": np.sort(hashed(SECOND_PERSON)), "lookalike": head_hashes(plain)}
    shared = spark.sparkContext.broadcast(lexicon)

    def dense(batches):
        for b in pieces(batches):
            x = features(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    rows = chosen.mapInArrow(dense, "doc_id bigint, label int, x array<float>").toArrow()  # 2 * sample rows at most
    y, ids = rows.column("label").to_numpy().astype(float), rows.column("doc_id").to_numpy()
    model = None
    if 0 < y.sum() < len(y):
        x = np.array(rows.column("x").to_pylist(), np.float32)
        order = np.argsort(ids)
        x, y = x[order], y[order]
        held = np.arange(len(y)) % 4 == 3
        grown = Boosted().fit(x[~held], y[~held])
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        model = grown, isotonic(grown.margin(x[held]), y[held], weight[held])
    fitted = spark.sparkContext.broadcast(model)

    def score(batches):
        for b in pieces(batches):
            if fitted.value is None:
                p = np.full(b.num_rows, prior)
            else:
                grown, knots = fitted.value
                m = grown.margin(features(b.column("text"), shared.value))
                p = 0.999 * np.interp(m, *knots) + 0.001 / (1 + np.exp(-m))  # the margin orders ties
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLD) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
