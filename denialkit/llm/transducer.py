"""A minimal acyclic transducer from words to token ids, as flat arrays that can be memory-mapped.

Words share prefixes and suffixes. Each arc carries a number; the sum along a word's path is the
word's rank among all words, which leads to its ids. Looking up steps many words at once.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

FIELDS = (("keys", np.int64), ("target", np.int32), ("output", np.int32), ("final", np.int8), ("at", np.int64), ("ids", np.int32))


def compile_words(words: list[bytes], ids: np.ndarray, at: np.ndarray) -> bytes:
    """The transducer of sorted, distinct words; ids[at[i]:at[i+1]] belong to words[i]."""
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each finished state: (byte, target, words below target)
    below: list[int] = []

    def finish(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key)
            below.append(int(state[0]) + sum(below[t] for _, t in state[1]))
        return register[key]

    path: list[list] = [[False, []]]  # states along the last word: [accepts, finished arcs]
    last = b""
    for word in [*words, None]:
        same = 0
        if word is not None:
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
        while len(path) > same + 1:
            done = finish(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        if word is not None:
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
    root = finish(path[0])
    keys, target, output = [], [], []
    for state, (accepts, out) in enumerate(arcs):
        passed = int(accepts)
        for byte, to in out:
            keys.append(state * 256 + byte)
            target.append(to)
            output.append(passed)
            passed += below[to]
    order = np.argsort(np.array(keys, np.int64))
    fields = {"keys": np.array(keys)[order], "target": np.array(target)[order], "output": np.array(output)[order], "final": np.array([a for a, _ in arcs]), "at": at, "ids": ids}
    parts = [np.ascontiguousarray(fields[n], kind).tobytes() for n, kind in FIELDS]
    head = np.array([root, *map(len, parts)], np.int64).tobytes()
    return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)


class Transducer:
    def __init__(self, blob: bytes):
        """Maps the blob through an unnamed file, so that its pages belong to the page cache."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(view, np.int64, 1 + len(FIELDS))
        self.root, place = int(head[0]), 8 * (1 + len(FIELDS))
        for (name, kind), n in zip(FIELDS, head[1:].tolist(), strict=True):
            setattr(self, name, np.frombuffer(view, kind, n // np.dtype(kind).itemsize, place))
            place += n + -n % 8

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is not in the lexicon; all words step together."""
        out = np.full(len(words), -1, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8)
        live, state, rank, step = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), 0
        while len(live):
            over = size[live] == step
            accepted = over & (self.final[state] == 1)
            out[live[accepted]] = rank[accepted]
            live, state, rank = live[~over], state[~over], rank[~over]
            if not len(live) or not len(self.keys):
                break
            key = state * 256 + data[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            live, state, rank = live[known], self.target[arc[known]].astype(np.int64), rank[known] + self.output[arc[known]]
            step += 1
        return out
