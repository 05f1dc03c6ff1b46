"""Small document tables with the awkward cases, and plain restatements of the contracts."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def awkward():
    """Nulls, empty and blank texts, odd spaces, a very long text, ties and repeated rows."""
    return [None, "", " \t\n", "one", "two words", "Ünï çödé words ÀÉ", "a b\x0bc\x0cd\re", "x\x1cy\x85z w   nbsp", "<|endoftext|> in text <|endoftext|>", "same same same same " * 30, "long " * 3000 + "end", "ONE", "don't we'll 123 4567 !!! ###  \n\n  end ", "0"]


def table(spark, texts, extra=True):
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns whose names operators use themselves
        for name in ("h", "key", "node", "size", "kept", "ids", "score", "a", "b", "n", "comp"):
            df = df.selectExpr("*", f"cast('x' as string) as {name}")
    return df


def prose(n, seed=5, vocabulary=400, least=5, most=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(rng.choices(vocab, k=rng.randint(least, most))) for _ in range(n)]


def near_copies(texts, rng, each, edits):
    out = []
    for t in texts:
        for _ in range(each):
            w = t.split()
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out
