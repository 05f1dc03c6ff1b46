"""Byte-level BPE on ragged numpy arrays: rank-synchronous merging of many pre-tokens at once."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

#: Fixed values of byte-level BPE: the splitting pattern and the printable stand-ins of bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space (no less than the pattern knows), that of ASCII, and the places before single spaces
#: between other signs.
WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
ASCII_WHITE, SINGLE = [c for c in WHITE if c.isascii()], re.compile(r"(?<=\S)(?= \S)")
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary file."""
    own = {b for r in PRINTABLE for b in r}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """Vocabulary and merge ranks of a tokenizers ``.json`` file (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_ids = np.array([vocab[c] for c in chars], np.int32)
        back = {c: b for b, c in enumerate(chars)}
        self.id_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.id_bytes[i] = token.encode() if token in self.special else bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.id_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string is an item of its own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.split(part)
        return out

    def segments(self, text: str) -> list[str]:
        """Pieces of a text that split into pre-tokens as the whole text does: it is cut before
        single spaces between other signs, where no pre-token can reach across, and around the
        strings of special tokens, which are pieces of their own."""
        if self.cut is not None and any(s in text for s in self.special):
            return [x for part in self.cut.split(text) if part for x in ([part] if part in self.special else self._pieces(part))]
        return self._pieces(text)

    @staticmethod
    def _pieces(text: str) -> list[str]:
        loose = any(w in text and (w + " " in text or " " + w in text) for w in (ASCII_WHITE if text.isascii() else WHITE))
        if loose or "\0" in text or text[:1] == " " or text[-1:] == " ":
            return SINGLE.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of each byte string.

        In each round every string finds its lowest-rank adjacent pair and merges all its
        occurrences, left to right without overlap; strings without a pair leave the round.
        """
        size = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        kept_ids, kept_owner = [], []
        while len(symbols):
            rank = np.full(len(symbols), np.iinfo(np.int32).max, np.int32)
            near = np.flatnonzero(owner[1:] == owner[:-1])
            key = symbols[near].astype(np.int64) * self.size + symbols[near + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            rank[near[known]] = self.ranks[at[known]]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(owner)))
            done = lowest == np.iinfo(np.int32).max
            hit = np.flatnonzero((rank == lowest) & ~done)
            if len(hit):  # of touching occurrences (a pair of equal symbols) every second one counts
                run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
                symbols = symbols.copy()
                symbols[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            if done.any():
                kept_ids.append(symbols[done])
                kept_owner.append(owner[done])
            stay &= ~done
            symbols, owner = symbols[stay], owner[stay]
        if not kept_ids:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        ids, owner = np.concatenate(kept_ids), np.concatenate(kept_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
