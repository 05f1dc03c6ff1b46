import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from denialkit.llm import queries
from denialkit.llm.bpe_codec import bpe_decode, bpe_encode
from denialkit.llm.token_count import token_count

from .fixtures import awkward, prose, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(4)
    odd = ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x4E00, 0x4F00), 0x1F600 + rng.randrange(60)))) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    return awkward() + prose(60) + odd + ["a" * 5000, "\n" * 300 + "x", "<|endoftext|>" * 3, "ab<|endoftext|>cd", "̀́e‍", "l'été 12345'll", "\x00\x01"]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_counts(spark):
    t, all_ = library(), texts()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count(table(spark, all_), PATH).collect()}
    want = {i: (len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in enumerate(all_)}
    assert got == want
    assert token_count(table(spark, all_).limit(0), PATH).count() == 0


def test_codec(spark):
    t, all_ = library(), texts()
    rows = bpe_encode(table(spark, all_), PATH, round_trip=True).select("doc_id", "ids", "decoded").collect()
    assert len(rows) == len(all_)
    for r in rows:
        want = t.encode(all_[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe_encode(table(spark, all_).limit(0), PATH).count() == 0


def test_a_small_lexicon_changes_nothing_and_decode_stands_alone(spark):
    from denialkit.llm.bpe_codec import build_lexicon

    docs = table(spark, texts(), extra=False)
    few = bpe_encode(docs, PATH, build_lexicon(docs, PATH, 100))
    many = bpe_encode(docs, PATH)
    assert {(r.doc_id, tuple(r.ids)) for r in few.collect()} == {(r.doc_id, tuple(r.ids)) for r in many.collect()}
    assert {(r.doc_id, r.decoded) for r in bpe_decode(many, PATH).collect()} == {(i, x or "") for i, x in enumerate(texts())}


def test_query_digests(spark, tmp_path):
    all_ = [*awkward(), *prose(10)]
    table(spark, all_).write.parquet(f"{tmp_path}/documents.parquet")
    t = library()
    for r in queries.op7_bpe_codec(spark, str(tmp_path)).collect():
        ids = t.encode(all_[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
