"""Token counts by rank-synchronous array merging, in Arrow batches.

A text is cut into segments whose pre-tokens don't depend on their surroundings; the pre-tokens of
segments not met before are merged as ragged arrays, and a segment's count is remembered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .ragged import pieces
from .token_merge import load

#: Bytes of the segments (each counts 120 more) whose count a task remembers.
REMEMBERED = 48_000_000


def token_count(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level BPE ``.json`` file, on every executor. Special tokens'
    strings in a text count as one token each. Null and empty texts have no tokens. Repeated rows
    and doc_ids are counted each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        bpe, known, held = load(tokenizer), {}, 0
        for b in pieces(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            split = [bpe.segments(t) for t in texts]
            if held > REMEMBERED:
                known, held = {}, 0
            fresh = list({t for s in split for t in s if t not in known})
            held += sum(map(len, fresh)) + 120 * len(fresh)
            tokens = [[] if t in bpe.special else bpe.split(t) for t in fresh]
            distinct = {w: i for i, w in enumerate({w for s in tokens for w in s})}
            _, at = bpe.merge([w.encode() for w in distinct])
            count = (at[1:] - at[:-1]).tolist()
            known.update((t, sum([count[distinct[w]] for w in s])) for t, s in zip(fresh, tokens, strict=True))
            known.update((t, 1) for t in bpe.special)
            n = [sum(map(known.__getitem__, s)) for s in split]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
