"""Minimal acyclic transducer: byte strings to their id sequences, memory-mapped.

Sorted words are compiled into an automaton whose equal suffixes share states. Each arc
carries how many words sort before it, so the outputs along a path add up to the word's
number, which indexes the stored id sequences.
"""

from __future__ import annotations

import mmap
import struct
from array import array
from collections.abc import Iterable, Sequence


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file image for (word, ids) pairs in ascending byte order without repeats."""
    register: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            arcs.append(key[1])
            final.append(key[0])
        return state

    spine: list[list] = [[False, []]]           # open nodes of the last word: final, settled arcs
    last, starts, ids = b"", array("i", [0]), array("i")
    for word, seq in entries:
        same = 0
        for x, y in zip(word, last):
            if x != y:
                break
            same += 1
        for depth in range(len(last), same, -1):
            state = settle(spine.pop())
            spine[-1][1].append((last[depth - 1], state))
        spine.extend([False, []] for _ in word[same:])
        spine[-1][0] = True
        last = word
        ids.extend(seq)
        starts.append(len(ids))
    for depth in range(len(last), 0, -1):
        state = settle(spine.pop())
        spine[-1][1].append((last[depth - 1], state))
    root = settle(spine[0])

    below = [0] * len(arcs)                     # words that each state accepts; targets come first
    labels, first, target, before = bytearray(), array("i", [0]), array("i"), array("i")
    for s, out in enumerate(arcs):
        n = int(final[s])
        for label, to in out:
            labels.append(label)
            target.append(to)
            before.append(n)
            n += below[to]
        below[s] = n
        first.append(len(target))
    marks = bytes(final)
    pad = bytes(-(len(labels) + len(marks)) % 4)
    head = struct.pack("<6i", root, len(arcs), len(target), len(starts), len(ids), len(pad))
    return b"".join([head, first.tobytes(), target.tobytes(), before.tobytes(), starts.tobytes(), ids.tobytes(),
                     bytes(labels), marks, pad])


class Lexicon:
    """Reads a file image without copying it."""

    def __init__(self, image: mmap.mmap | bytes):
        view = memoryview(image)
        self.root, states, n, words, ids, _ = struct.unpack("<6i", view[:24])
        at, parts = 24, []
        for size in (states + 1, n, n, words, ids):
            parts.append(view[at:at + 4 * size].cast("i"))
            at += 4 * size
        self.first, self.target, self.before, self.starts, self.ids = parts
        self.image, self.labels, self.final = image, at, view[at + n:at + n + states]

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        state, number, find, base, first = self.root, 0, self.image.find, self.labels, self.first
        for k in range(len(word)):
            arc = find(word[k:k + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number += self.before[arc]
            state = self.target[arc]
        if not self.final[state]:
            return None
        return self.ids[self.starts[number]:self.starts[number + 1]].tolist()
