"""A minimal acyclic transducer from words (bytes) to id sequences, laid out in one file that is memory-mapped."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable

Ids = tuple[int, ...]


def _shared(a: Ids, b: Ids) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


class _State:
    """A state under construction: arcs in the order of labels, each [label, output, target number or None]."""

    __slots__ = ("arcs", "final", "rest")

    def __init__(self) -> None:
        self.arcs: list[list] = []
        self.final, self.rest = False, ()

    def delay(self, out: Ids) -> None:
        """Put an output in front of whatever leaves this state."""
        for arc in self.arcs:
            arc[1] = out + arc[1]
        if self.final:
            self.rest = out + self.rest


def compile_words(words: Iterable[tuple[bytes, Ids]]) -> bytes:
    """The automaton of the distinct words, which must come in the order of their bytes.

    Words share prefixes as they are added; a state that no later word can change is replaced by an equal one already kept, so
    suffixes are shared too. Outputs move towards the start as far as all words behind an arc agree.
    """
    kept: dict[tuple, int] = {}
    done: list[tuple] = []

    def freeze(s: _State) -> int:
        key = (s.final, s.rest, tuple((a[0], a[1], a[2]) for a in s.arcs))
        if key not in kept:
            kept[key] = len(done)
            done.append(key)
        return kept[key]

    path, last = [_State()], b""
    for word, ids in words:
        if word == last or not word:
            continue
        n = 0
        while n < len(word) and n < len(last) and word[n] == last[n]:
            n += 1
        for i in range(len(last), n, -1):
            path[i - 1].arcs[-1][2] = freeze(path[i])
        del path[n + 1 :]
        for i in range(n):
            arc = path[i].arcs[-1]
            k = _shared(arc[1], ids)
            if k < len(arc[1]):
                path[i + 1].delay(arc[1][k:])
                arc[1] = arc[1][:k]
            ids = ids[k:]
        for i in range(n, len(word)):
            path[i].arcs.append([word[i], ids if i == n else (), None])
            path.append(_State())
        path[-1].final = True
        if n == len(word):  # can't be: words are sorted and distinct
            path[-1].rest = ids
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1].arcs[-1][2] = freeze(path[i])
    root = freeze(path[0])

    pool: list[int] = []
    places: dict[Ids, int] = {}

    def place(ids: Ids) -> int:
        """Where an output lies in the pool, its length in the low byte; long ones don't occur for words of a vocabulary's size."""
        if ids not in places:
            places[ids] = len(pool) << 8 | len(ids)
            pool.extend(ids)
        return places[ids]

    first, labels, targets, outputs, finals = [], bytearray(), [], [], []
    for final, rest, arcs in done:
        first.append(len(labels))
        finals.append((1 + place(rest)) if final else 0)
        for label, out, target in arcs:
            labels.append(label)
            targets.append(target)
            outputs.append(place(out))
    first.append(len(labels))
    pad = -len(labels) % 8
    head = struct.pack("<4Q", root, len(done), len(labels), len(pool))
    body = b"".join(struct.pack(f"<{len(x)}Q", *x) for x in (first, finals, targets, outputs, pool))
    return head + body + bytes(labels) + b"\0" * pad


class Lexicon:
    """Looks words up in a compiled automaton that stays in its file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, states, arcs, pool = struct.unpack_from("<4Q", self.map, 0)
        view, at = memoryview(self.map), 32
        parts = []
        for n in (states + 1, states, arcs, arcs, pool):
            parts.append(view[at : at + 8 * n].cast("Q"))
            at += 8 * n
        self.first, self.finals, self.targets, self.outputs, self.pool = parts
        self.labels = at

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if it isn't in the lexicon."""
        s, ids = self.root, []
        find, base = self.map.find, self.labels
        for i in range(len(word)):
            k = find(word[i : i + 1], base + self.first[s], base + self.first[s + 1])
            if k < 0:
                return None
            k -= base
            out = self.outputs[k]
            if out & 255:
                ids += self.pool[out >> 8 : (out >> 8) + (out & 255)]
            s = self.targets[k]
        rest = self.finals[s]
        if not rest:
            return None
        rest -= 1
        return ids + list(self.pool[rest >> 8 : (rest >> 8) + (rest & 255)])
