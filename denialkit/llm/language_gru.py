"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .ragged import Words, pieces, words

FOLD, HELD_OUT, NONE = 4, 2, "und"
#: Training documents of each language (the documented bound of the fit), hidden units of each
#: direction, bytes after which a word without spaces is cut into sequences of its own, training
#: steps, sequences a step, and words whose result a Python worker remembers.
SAMPLE, HIDDEN, LONGEST, STEPS, BATCH, REMEMBERED = 200, 24, 40, 500, 384, 400_000
TRAINING_WORDS = 150_000  # the most frequent distinct words of those documents


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer; bytes enter through a table of gate inputs."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.table = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)

    def run(self, bytes_: np.ndarray, keep: bool = False):
        """bytes_: (T, B). States (T, B, h), and what the backward pass needs."""
        t, b, h = *bytes_.shape, self.h
        state, states, tape = np.zeros((b, h), np.float32), np.empty((t, b, h), np.float32), []
        for i in range(t):
            x, y = self.table[bytes_[i]], state @ self.u
            zr = sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
            if keep:
                tape.append((state, z, r, n, y[:, 2 * h :]))
            state = n + z * (state - n)
            states[i] = state
        return states, tape

    def back(self, bytes_: np.ndarray, grad: np.ndarray, tape: list):
        """Gradients of table and u by backpropagation through time; grad: (T, B, h)."""
        h, carry = self.h, np.zeros_like(grad[0])
        du, dx = np.zeros_like(self.u), np.empty((*bytes_.shape, 3 * h), np.float32)
        for i in reversed(range(len(bytes_))):
            state, z, r, n, un = tape[i]
            d = grad[i] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            gate = np.concatenate([dz, dr, dn * r], axis=1)
            du += state.T @ gate
            carry = d * z + gate @ self.u.T
            dx[i, :, : 2 * h], dx[i, :, 2 * h :] = gate[:, : 2 * h], dn
        dtable = np.zeros_like(self.table)
        np.add.at(dtable, bytes_.ravel(), dx.reshape(-1, 3 * h))
        return dtable, du


class BiGru:
    """Labels every byte of a sequence from both directions' states."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.ways = labels, [Direction(rng, hidden), Direction(rng, hidden)]
        self.out = (rng.standard_normal((2 * hidden, len(labels))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    @staticmethod
    def arrange(data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """(T, B) bytes read forwards, the places that read them backwards, and the mask."""
        steps = np.arange(int(size.max()))[:, None]
        mask = steps < size
        place = np.where(mask, size - 1 - steps, steps)
        return data[np.minimum(start + steps, len(data) - 1)], place, mask

    def forward(self, data, place, keep=False):
        ahead, tape = self.ways[0].run(data, keep)
        turned = np.take_along_axis(data, place, 0)
        behind, other = self.ways[1].run(turned, keep)
        both = np.concatenate([ahead, np.take_along_axis(behind, place[:, :, None], 0)], axis=2)
        logit = both @ self.out + self.bias
        logit -= logit.max(axis=2, keepdims=True)
        return logit - np.log(np.exp(logit).sum(axis=2, keepdims=True)), both, turned, tape, other

    def step(self, data, place, mask, y):
        """Gradients of the mean cross-entropy over positions."""
        logp, both, turned, tape, other = self.forward(data, place, True)
        grad = np.exp(logp)
        grad[:, np.arange(len(y)), y] -= 1
        grad *= (mask / mask.sum())[:, :, None].astype(np.float32)
        h = self.ways[0].h
        dboth = grad @ self.out.T
        dout = both.reshape(-1, 2 * h).T @ grad.reshape(-1, grad.shape[2])
        a = self.ways[0].back(data, dboth[:, :, :h], tape)
        b = self.ways[1].back(turned, np.take_along_axis(dboth[:, :, h:], place[:, :, None], 0), other)
        return [*a, *b, dout, grad.sum(axis=(0, 1))]

    def train(self, data, start, size, y, weight, steps=STEPS, batch=BATCH, seed=12):
        """Adam over batches drawn by weight."""
        rng, params = np.random.default_rng(seed), [self.ways[0].table, self.ways[0].u, self.ways[1].table, self.ways[1].u, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        chosen = rng.choice(len(y), (steps, batch), p=weight / weight.sum())
        for i, pick in enumerate(chosen, 1):
            for p, g, a, b in zip(params, self.step(*self.arrange(data, start[pick], size[pick]), y[pick]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= 0.02 * min(1, 2 - 2 * i / steps) * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)
        return self

    def totals(self, data, start, size, block=2048):
        """For each sequence the sum over its bytes of every label's log-probability."""
        out, order = np.empty((len(start), len(self.labels)), np.float32), np.argsort(size, kind="stable")
        for i in range(0, len(order), block):
            pick = order[i : i + block]
            arranged = self.arrange(data, start[pick], size[pick])
            out[pick] = (self.forward(*arranged[:2])[0] * arranged[2][:, :, None]).sum(axis=0)
        return out


def sequences(w: Words) -> Words:
    """Words, of which those over LONGEST bytes are cut into sequences of that length."""
    size = w.end - w.start
    parts = np.maximum(1, -(-size // LONGEST))
    if (parts == 1).all():
        return w
    which = np.repeat(np.arange(len(size)), parts)
    start = w.start[which] + LONGEST * (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(start + LONGEST, w.end[which])
    doc = w.doc[which]
    return Words(w.data, start, end, doc, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(w.at) - 1))]))


class Memory:
    """Totals of sequences seen before, by hash."""

    def __init__(self, model: BiGru):
        self.model, self.keys, self.values = model, np.zeros(0, np.uint64), np.zeros((0, len(model.labels)), np.float32)

    def totals(self, s: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row of each sequence, totals by row)."""
        h = s.hashes()
        fresh, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, fresh), max(len(self.keys) - 1, 0))
        known = self.keys[at] == fresh if len(self.keys) else np.zeros(len(fresh), bool)
        values = np.empty((len(fresh), len(self.model.labels)), np.float32)
        values[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            values[new] = self.model.totals(s.data, s.start[first[new]], (s.end - s.start)[first[new]])
            keys, rows = (fresh, values) if len(self.keys) > REMEMBERED else (np.concatenate([self.keys, fresh[new]]), np.concatenate([self.values, values[new]]))
            order = np.argsort(keys)
            self.keys, self.values = keys[order], rows[order]
        return back, values


def fit(docs: DataFrame, sample: int) -> BiGru | None:
    """Trains on the words of at most ``sample`` documents of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.coalesce(crc_mod(F.col("doc_id"), FOLD) != HELD_OUT, F.lit(True)))
    labels = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not labels:
        return None
    ids = [known.where(F.col("lang") == x).select("doc_id", F.lit(i).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for i, x in enumerate(labels)]
    chosen = ids[0]
    for more in ids[1:]:
        chosen = chosen.union(more)
    texts = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample rows a language

    def distinct_words(batches):
        for b in pieces(batches):
            s, y = sequences(words(b.column("text"))), np.array(b.column("y"))
            h = s.hashes()
            _, first, n = np.unique(h + y[s.doc].astype(np.uint64), return_index=True, return_counts=True)
            data = s.data.tobytes()
            yield pa.RecordBatch.from_pydict({"word": pa.array([data[s.start[i] : s.end[i]] for i in first], pa.binary()), "y": pa.array(y[s.doc[first]], pa.int32()), "n": pa.array(n, pa.int64())})

    rows = texts.mapInArrow(distinct_words, "word binary, y int, n bigint").groupBy("word", "y").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.xxhash64("word"), "word").limit(TRAINING_WORDS).toArrow()
    if not rows.num_rows:
        return BiGru(labels)
    found, y = rows.column("word").to_pylist(), rows.column("y").to_numpy()
    size = np.array([len(x) for x in found])
    weight = np.sqrt(rows.column("n").to_numpy().astype(float))
    weight /= np.bincount(y, weights=weight, minlength=len(labels))[y]  # languages count alike
    return BiGru(labels).train(np.frombuffer(b"".join(found), np.uint8), np.cumsum(size) - size, size, y, weight)


_MEMORY: dict[str, Memory] = {}


def language_gru(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The network labels every byte of every word (its state starts anew at white space, so equal
    words are computed once); a document's score is the geometric mean of its bytes' probabilities,
    normalised over the languages. ``und`` with score 0 if the text is null or has no letter, or
    if no language was learned. Null languages are not learned from. Repeated rows are predicted
    each, other columns are ignored; an empty table gives no rows. A text of any length is one row,
    scored whole. Of equally likely languages the first in order is told. The fit is bounded by
    ``sample`` documents of each language and by the TRAINING_WORDS most frequent of their words (ties
    by hash).
    """
    spark = docs.sparkSession
    model = fit(docs, sample)
    shared, name = spark.sparkContext.broadcast(model), f"{spark.sparkContext.applicationId}-{id(model)}-{np.random.default_rng().integers(1 << 62)}"

    def predict(batches):
        if name not in _MEMORY:
            _MEMORY.clear()
            _MEMORY[name] = Memory(shared.value)
        memory = _MEMORY[name]
        for b in pieces(batches):
            s, n = sequences(words(b.column("text"))), b.num_rows
            row, totals = memory.totals(s)
            total = np.stack([np.bincount(s.doc, weights=totals[row, i], minlength=n).astype(float) for i in range(totals.shape[1])], axis=1)  # counts of nothing are whole numbers
            total /= np.maximum(np.bincount(s.doc, weights=s.end - s.start, minlength=n), 1)[:, None]
            p = np.exp(total - total.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([memory.model.labels[i] for i in best], pa.string()), pa.array(p.max(axis=1)), b.column("letters")], names=["doc_id", "best", "p", "letters"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select("doc_id", "text", letters)
    if model is None:
        found = rows.select("doc_id", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        found = rows.mapInArrow(predict, "doc_id bigint, best string, p double, letters boolean").select(
            "doc_id", F.when(F.col("letters"), F.col("best")).otherwise(NONE).alias("lang_pred"), F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLD) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
