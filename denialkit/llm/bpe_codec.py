"""BPE encoding and decoding: a minimal acyclic transducer of frequent words, exact merges for the rest."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import pieces, take
from .token_merge import ByteBpe, load
from .transducer import Transducer, compile_words

#: A word enters the lexicon if it occurs once in so many bytes of text or oftener, so the lexicon
#: has no more words than that; the longest of them in bytes; bytes of the segments (each counts
#: 120 more) that a task counts before it passes them on, and whose ids it remembers.
RARE, LONGEST, GATHERED, REMEMBERED = 1 << 18, 64, 48_000_000, 48_000_000


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n): how often each pre-token occurs in all texts."""

    def count(batches):
        bpe, seen, held = load(tokenizer), Counter(), 0

        def flush():
            total: dict[str, int] = {}
            for t, n in seen.items():
                for w in () if t in bpe.special else bpe.split(t):
                    total[w] = total.get(w, 0) + n
            return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for b in pieces(batches):
            found = [x for t in b.column("text").to_pylist() for x in bpe.segments(t or "")]
            held += sum(len(x) + 120 for x in set(found) if x not in seen)
            seen.update(found)
            if held > GATHERED:
                yield flush()
                seen, held = Counter(), 0
        yield flush()

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, rare: int = RARE) -> bytes:
    """The transducer of the frequent words of all texts: those that occur at least once in
    ``rare`` bytes, RARE words at most whatever the size of the table."""
    bpe = load(tokenizer)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    frequent = word_counts(docs, tokenizer).where((F.octet_length("word") <= LONGEST) & (F.col("n") * rare >= size))
    words = sorted(r.word.encode() for r in frequent.select("word").collect() if r.word not in bpe.special)
    return compile_words(words, *bpe.merge(words))


class Encoder:
    """Ids of segments: remembered ones first; of others, the ids of their pre-tokens, by the
    transducer or, where it lacks a word, by exact merges."""

    def __init__(self, bpe: ByteBpe, blob: bytes):
        self.bpe, self.lexicon = bpe, Transducer(blob)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.at, self.used, self.n, self.held = np.zeros(1 << 18, np.int32), np.zeros(1 << 16, np.int64), 0, 0, 0

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pre-tokens."""
        data = [w.encode() for w in words]
        rank = self.lexicon.find(data)
        known, unseen = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        ids, at = take(self.lexicon.ids, self.lexicon.at[:-1], np.diff(self.lexicon.at), rank[known])
        more, more_at = self.bpe.merge([data[i] for i in unseen])
        place = np.empty(len(words), np.int64)
        place[np.concatenate([known, unseen])] = np.arange(len(words))
        return take(np.concatenate([ids, more]), np.concatenate([at[:-1], more_at[:-1] + len(ids)]), np.concatenate([np.diff(at), np.diff(more_at)]), place)

    def learn(self, fresh: list[str]) -> None:
        split = [[] if t in self.bpe.special else self.bpe.split(t) for t in fresh]
        number = {w: i for i, w in enumerate({w for s in split for w in s})}
        ids, at = self.words(list(number))
        special = np.array([self.bpe.special.get(t, -1) for t in fresh], np.int64)
        own = np.flatnonzero(special >= 0)
        # the special ones count as words behind all others
        size, start = np.concatenate([np.diff(at), np.ones(len(own), np.int64)]), np.concatenate([at[:-1], len(ids) + np.arange(len(own))])
        ids = np.concatenate([ids, special[own]]).astype(np.int32)
        of = iter(range(len(number), len(size)))
        rows = np.array([i for t, s in zip(fresh, split, strict=True) for i in ([next(of)] if t in self.bpe.special else [number[w] for w in s])], np.int64)
        ids, at = take(ids, start, size, rows)
        at = at[np.concatenate([[0], np.cumsum([1 if t in self.bpe.special else len(s) for t, s in zip(fresh, split, strict=True)])]).astype(np.int64)]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(fresh) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[self.n + 1 : self.n + 1 + len(fresh)] = self.used + at[1:]
        self.slot.update(zip(fresh, range(self.n, self.n + len(fresh)), strict=True))
        self.used, self.n = self.used + len(ids), self.n + len(fresh)
        self.held += sum(map(len, fresh)) + 120 * len(fresh)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text)."""
        if self.held > REMEMBERED:
            self.forget()
        split = [self.bpe.segments(t) for t in texts]
        flat = [t for s in split for t in s]
        self.learn([t for t in set(flat) if t not in self.slot])
        rows = np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat))
        ids, at = take(self.flat, self.at[: self.n], np.diff(self.at[: self.n + 1]), rows)
        return ids, at[np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)]


def decode(bpe: ByteBpe, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts of ids; bytes that are no UTF-8 become U+FFFD, as in the tokenizers library."""
    if not hasattr(bpe, "flat_bytes"):
        size = np.array([len(b) for b in bpe.id_bytes], np.int64)
        bpe.flat_bytes = np.frombuffer(b"".join(bpe.id_bytes), np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1], size
    data, byte_at = take(*bpe.flat_bytes, ids)
    at = byte_at[at]
    data = data.tobytes()
    return pa.array([data[a:b].decode(errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())


def bpe_encode(docs: DataFrame, tokenizer: str, lexicon: bytes | None = None, round_trip: bool = False) -> DataFrame:
    """All columns of docs, and ``ids`` array<int>: the text's token ids, exactly as the library
    gives them without added special tokens; with ``round_trip`` also ``decoded``, the text
    decoded from those ids.

    Null and empty texts have no ids and decode to an empty text. Columns named ids or decoded are
    replaced. Very long texts are encoded whole. Repeated rows are encoded each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(lexicon if lexicon is not None else build_lexicon(docs, tokenizer))
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if round_trip:
        schema = T.StructType([*schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = load(tokenizer)
        encoder = Encoder(bpe, blob.value)
        for b in pieces(batches):
            ids, at = encoder.encode([t or "" for t in b.column("text").to_pylist()])
            out = [*b.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
            yield pa.RecordBatch.from_arrays(out + [decode(bpe, ids, at)] * round_trip, names=schema.names)

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """All columns, and ``decoded``: the text of the ``ids`` column (null ids: empty)."""
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = load(tokenizer)
        for b in batches:
            rows = [x or [] for x in b.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, decode(bpe, np.array([i for x in rows for i in x], np.int64), at)], names=schema.names)

    return encoded.mapInArrow(run, schema)
