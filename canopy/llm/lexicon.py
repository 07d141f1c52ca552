"""A minimal acyclic transducer from words to ids, in one file that processes map into memory.

States that accept the same rest of words are one state (shared suffixes). Every transition holds how many words come
before those that take it, so that the sum along a word's path is its number among all words in byte order; ids lie at that number.

File, little-endian, arrays aligned to 8 bytes::

    magic "MATL0001", i64 states, transitions, words, ids, root
    i64 keys[transitions]        state * 256 + byte, ascending
    i32 target[transitions], i32 before[transitions], u8 final[states]
    i64 first[words + 1], i32 ids[ids]
"""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence

import numpy as np

MAGIC = b"MATL0001"
LONGEST = 64


def _arrays(states: int, transitions: int, words: int, ids: int) -> list[tuple[str, str, int]]:
    return [("keys", "<i8", transitions), ("target", "<i4", transitions), ("before", "<i4", transitions), ("final", "u1", states), ("first", "<i8", words + 1), ("ids", "<i4", ids)]


def compile_lexicon(words: Mapping[bytes, Sequence[int]]) -> bytes:
    """The file's content for these words; words are added in byte order and the states that no later word can change are merged."""
    known: dict[tuple, int] = {}
    frozen: list[tuple] = []
    reach: list[int] = []

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        state = (final, tuple(arcs))
        at = known.get(state)
        if at is None:
            at = known[state] = len(frozen)
            frozen.append(state)
            reach.append(final + sum(reach[t] for _, t in arcs))
        return at

    path: list[list] = [[False, []]]
    last = b""
    for word in sorted(words):
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        while len(path) > common + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(*done)))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(*done)))
    root = freeze(*path[0])

    keys, target, before = [], [], []
    for i, (final, arcs) in enumerate(frozen):
        n = int(final)
        for label, to in arcs:
            keys.append(i * 256 + label)
            target.append(to)
            before.append(n)
            n += reach[to]
    outputs = [words[w] for w in sorted(words)]
    values = {
        "keys": keys,
        "target": target,
        "before": before,
        "final": [f for f, _ in frozen],
        "first": np.concatenate([[0], np.cumsum([len(x) for x in outputs])]) if outputs else [0],
        "ids": [i for x in outputs for i in x],
    }
    sizes = (len(frozen), len(keys), len(outputs), len(values["ids"]))
    out = [MAGIC + struct.pack("<5q", *sizes, root)]
    for name, kind, _ in _arrays(*sizes):
        data = np.asarray(values[name], kind).tobytes()
        out.append(data + bytes(-len(data) % 8))
    return b"".join(out)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{path} is not a compiled lexicon")
        *sizes, self.root = struct.unpack("<5q", bytes(data[8:48]))
        at = 48
        for name, kind, n in _arrays(*sizes):
            end = at + n * np.dtype(kind).itemsize
            setattr(self, name, data[at:end].view(kind))
            at = end + -end % 8
        self.n_words = sizes[2]

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is not in the lexicon. All words take their next byte together."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(n, self.root, np.int64)
        number = np.zeros(n, np.int64)
        out = np.full(n, -1, np.int64)
        alive = np.flatnonzero(size <= LONGEST) if len(self.keys) else np.zeros(0, np.int64)
        for j in range(LONGEST + 1):
            ended = alive[size[alive] == j]
            good = ended[self.final[state[ended]] == 1]
            out[good] = number[good]
            alive = alive[size[alive] > j]
            if not len(alive):
                break
            key = state[alive] * 256 + data[start[alive] + j]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            number[alive] += self.before[at]
            state[alive] = self.target[at]
        return out

    def ids_of(self, number: int) -> tuple[int, ...]:
        return tuple(self.ids[self.first[number] : self.first[number + 1]].tolist())
