"""Spelling variant grouping by full neighbourhood generation.

Every word emits all distinct strings that one deletion, replacement or insertion over the observed
alphabet makes of it; those that are words themselves, found by a hash join with the vocabulary, are
its neighbours, and no distance is computed. A Bloom filter of the vocabulary keeps strings that
cannot be words from being shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored
from .exact_dedup import POSITIONS, bloom_filter
from .ragged import _BASE, _BASE_INV, _CODE, U64, mix, pieces, powers, raw, runs, strings, tidy

#: Fixed values of the contract: one run in ODD loses a code point; words have LEAST code points and
#: FEWEST occurrences at least; a form is TIMES as frequent as the word.
ODD, LEAST, FEWEST, TIMES = 97, 5, 3, 2
#: Bytes of text a task reads at once, candidates it holds at once, filter slots per word (times 8),
#: bytes of a run whose checksum is computed together with the other runs', and words a task makes strings of.
PIECE, CANDIDATES, SLOTS, TOGETHER, PER_TASK = 1 << 21, 1_500_000, 4, 64, 20_000

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end], continued from the checksum ``state`` of what stands before it."""
    crc, at = state ^ np.uint32(0xFFFFFFFF), np.arange(len(start))
    for j in range(TOGETHER):
        at = at[end[at] - start[at] > j]
        if not len(at):
            break
        crc[at] = _CRC[(crc[at] ^ data[start[at] + j]) & 0xFF] ^ (crc[at] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in at[end[at] - start[at] > TOGETHER]:
        crc[i] = zlib.crc32(data[start[i] + TOGETHER : end[i]], int(crc[i]))
    return crc


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of each task and piece: the runs of letters, some of them with a code point less."""

    def run(batches):
        for b in pieces(batches, limit=PIECE):
            data, offsets = raw(b.column("text"))
            lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
            inside = _LETTER[data] | lead
            inside[1:] |= lead[:-1]
            data = _SMALL[data]
            w = runs(data, offsets, inside)
            if not len(w.start):
                continue
            doc = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column("doc_id").to_pylist()], np.uint32)
            odd = checksums(data, w.start, w.end, doc[w.doc])
            cut = odd % ODD == 0
            wide = np.concatenate([[0], np.cumsum(lead)])
            size = w.end - w.start - (wide[w.end] - wide[w.start])  # code points
            _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
            n = np.bincount(back[~cut], minlength=len(first))
            keep = (n > 0) & (size[first] >= LEAST)
            first, n = first[keep], n[keep]
            yield pa.RecordBatch.from_arrays([strings(data, w.start[first], (w.end - w.start)[first]), pa.array(n, pa.int64())], names=["word", "n"])
            at = np.flatnonzero(cut & (size > LEAST))
            text = [data[w.start[i] : w.end[i]].tobytes().decode() for i in at]
            place = odd[at] % size[at]
            less = [t[:p] + t[p + 1 :] for t, p in zip(text, place.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(less, pa.string()), pa.array(np.ones(len(less), np.int64))], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")


def _latin(column: pa.Array) -> list[bytes]:
    """Words by one byte per code point; all of them are below U+0100."""
    return [t.encode("latin-1") for t in column.to_pylist()]


def word_hashes(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            one = _latin(b.column("word"))
            size = np.array([len(x) for x in one], np.int64)
            data = np.frombuffer(b"".join(one), np.uint8)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(_CODE[data] * powers(_BASE, len(data)), dtype=U64)])
            end = np.cumsum(size)
            h = mix((sums[end] - sums[end - size]) * powers(_BASE_INV, len(data) + 1)[end - size] + size.astype(U64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])
        tidy()

    return words.select("word").mapInArrow(run, "h bigint")


class Neighbourhood:
    """All distinct strings one edit away from words of one length, as hashes; ``run`` gives those that the filter holds."""

    def __init__(self, alphabet: bytes, bits: np.ndarray, slots: int):
        self.letters, self.bits, self.slots = np.frombuffer(alphabet, np.uint8), bits, slots
        self.codes = _CODE[self.letters]

    def held(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that the filter may hold, one slot after the other."""
        h = mix(h)
        step, at = h >> U64(32) | U64(1), np.arange(len(h))
        for j in range(POSITIONS):
            slot = ((h[at] + step[at] * U64(j)) & U64(self.slots - 1)).astype(np.int64)
            at = at[self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 > 0]
        return at

    def run(self, words: np.ndarray):
        """words: (k, length). Yields (row, string) of one edit each."""
        k, size = words.shape
        wide = 2 * len(self.letters) + 1
        rows = max(1, CANDIDATES // ((size + 1) * wide))
        places = max(1, CANDIDATES // wide)  # of one very long word at once
        power = powers(_BASE, size + 2)
        for r in range(0, k, rows):
            x = words[r : r + rows]
            value = _CODE[x] * power[:size]
            before = np.concatenate([np.zeros((len(x), 1), U64), np.cumsum(value, axis=1, dtype=U64)], axis=1)
            for a in range(0, size + 1, places):
                yield from ((r + i, s) for i, s in self._edits(x, value, before, power, a, min(size + 1, a + places)))

    def _edits(self, x, value, before, power, a, b):
        size, whole = x.shape[1], before[:, -1:]
        c = min(b, size)
        back = U64(_BASE_INV)
        same = np.zeros((len(x), size + 1), bool)
        same[:, 1:size] = x[:, 1:] == x[:, :-1]
        # deletions: of equal neighbours the first
        shorter = before[:, a:c] + (whole - before[:, a + 1 : c + 1]) * back + U64(size - 1)
        at = np.flatnonzero(~same[:, a:c].ravel())
        for i in at[self.held(shorter.ravel()[at])]:
            row, p = divmod(int(i), c - a)
            t = x[row].tobytes()
            yield row, t[: a + p] + t[a + p + 1 :]
        # replacements by another letter
        changed = (whole - value[:, a:c])[:, :, None] + self.codes * power[a:c, None] + U64(size)
        at = np.flatnonzero((x[:, a:c, None] != self.letters).ravel())
        for i in at[self.held(changed.ravel()[at])]:
            row, p, letter = np.unravel_index(i, changed.shape)
            t = x[row].tobytes()
            yield int(row), t[: a + p] + self.letters[letter : letter + 1].tobytes() + t[a + p + 1 :]
        # insertions: before an equal letter, never behind it
        longer = (before[:, a:b] + (whole - before[:, a:b]) * U64(_BASE))[:, :, None] + self.codes * power[a:b, None] + U64(size + 1)
        left = np.zeros((len(x), b - a), np.int64) - 1
        left[:, max(a, 1) - a :] = x[:, max(a, 1) - 1 : b - 1]
        at = np.flatnonzero((left[:, :, None] != self.letters).ravel())
        for i in at[self.held(longer.ravel()[at])]:
            row, p, letter = np.unravel_index(i, longer.shape)
            t = x[row].tobytes()
            yield int(row), t[: a + p] + self.letters[letter : letter + 1].tobytes() + t[a + p :]


def neighbours(words: DataFrame, size: int, alphabet: str, bits: bytes, slots: int) -> DataFrame:
    """(word, near): of each word's neighbourhood the strings that the filter holds, each once."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(bits)  # 128 MB at most
    letters = alphabet.encode("latin-1")

    def run(batches):
        around = Neighbourhood(letters, np.frombuffer(shared.value, np.uint8), slots)
        for b in batches:
            one = _latin(b.column("word"))
            size = np.array([len(x) for x in one])
            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                block = np.frombuffer(b"".join(one[i] for i in rows), np.uint8).reshape(len(rows), length)
                found, held = [], 0
                for row, s in around.run(block):
                    found.append((one[rows[row]].decode("latin-1"), s.decode("latin-1")))
                    held += length
                    if held > 4_000_000:
                        yield _pairs(found)
                        found, held = [], 0
                yield _pairs(found)
        tidy()

    parts = 32 + size // PER_TASK  # a word gives about a thousand strings: small files are much work
    return words.select("word").repartition(parts, "word").mapInArrow(run, "word string, near string")


def _pairs(found: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["word", "near"])


def roots(links: DataFrame, store: Stored) -> DataFrame:
    """(word, root) for each word that has a form: the last form that links lead to.

    A form is at least twice as frequent, so links have no rings and are as long as the logarithm of
    the greatest count; each turn doubles the steps taken.
    """
    at = store.put("root", links.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("last"))
        moved = at.join(onward, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved"))
        moved = store.put("root", moved)
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of LEAST code points
    and FEWEST occurrences at least; one run in ODD, told by its document, loses a code point first
    (a null doc_id counts as empty text there). The form is the near word with the most occurrences
    (ties: the smallest in code-point order), if it has TIMES the word's. Repeated rows count each;
    null and empty texts and empty tables have no words; texts and words of any length count whole;
    other columns are ignored. Words are counted together by 64-bit hash within a piece of a task.
    """
    store = Stored(docs.sparkSession)
    words = word_counts(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)
    words = store.put("words", words)
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()  # 90 at most
    alphabet = "".join(sorted(r.c for r in letters))
    size = words.count()
    bits, slots = bloom_filter(word_hashes(words), SLOTS * size, False)
    near = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = neighbours(words, size, alphabet, bits, slots).join(near, "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("formed", -F.col("best.m") >= TIMES * F.col("n"))
    found = found.select("word", F.when(F.col("formed"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("formed"), -F.col("best.m")).alias("form_n"))
    found = store.put("found", found)
    last = roots(found.where("form is not null"), store)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL; table documents. crc32 is the exclusive or of what each byte adds at its distance
#: from the end; words within one edit share a string that one deletion at most makes of both, and
#: their distance is then computed (on one byte per code point).
ORACLE = r"""
WITH RECURSIVE step AS (SELECT c AS b, list_reduce(list_concat([c], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(c)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
far(k, b, v) AS (SELECT 0, b, v FROM step UNION ALL SELECT k + 1, far.b, xor(far.v >> 8, step.v) FROM far JOIN step ON step.b = far.v & 255 WHERE k < (SELECT max(octet_length(encode(run))) + 40 FROM runs)),
empty(len, v) AS (SELECT 0, 4294967295 UNION ALL SELECT len + 1, xor(empty.v >> 8, step.v) FROM empty JOIN step ON step.b = empty.v & 255 WHERE len < (SELECT max(octet_length(encode(run))) + 40 FROM runs)),
keyed AS (SELECT *, row_number() OVER () AS r, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
bytes AS (SELECT r, len(x) // 2 AS len, i AS i, ('0x' || substr(x, 2 * i::INTEGER + 1, 2))::INTEGER AS b FROM keyed, unnest(range(len(x) // 2)) u(i)),
sums AS (SELECT r, any_value(len) AS len, bit_xor(far.v) AS v FROM bytes JOIN far ON far.k = bytes.len - 1 - bytes.i AND far.b = bytes.b GROUP BY r),
odd AS (SELECT doc_id, run, n, xor(xor(sums.v, empty.v), 4294967295) AS h FROM keyed JOIN sums USING (r) JOIN empty ON empty.len = sums.len),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM odd),
voc AS (SELECT word, sum(n)::BIGINT AS n FROM cut GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5),
one AS (SELECT word, n, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') AS t FROM voc),
less AS (SELECT DISTINCT word, n, t, u.d AS d FROM one, unnest(list_append(list_transform(range(1, len(t) + 1), lambda i: substr(t, 1, i::INTEGER - 1) || substr(t, i::INTEGER + 1)), t)) u(d)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (d) WHERE a.word <> b.word AND levenshtein(a.t, b.t) = 1),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -near_n, near := encode(near))) AS best FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * n THEN decode(best.near) END AS form, CASE WHEN -best.m >= 2 * n THEN (-best.m)::BIGINT END AS form_n FROM voc LEFT JOIN best USING (word)),
path(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT path.word, forms.form FROM path JOIN forms ON forms.word = path.root WHERE forms.form IS NOT NULL),
last AS (SELECT path.word, path.root FROM path JOIN forms ON forms.word = path.root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)"""
