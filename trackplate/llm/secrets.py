"""Secrets in whole texts: every rule in one automaton, one pass over the bytes.

Rule patterns are parsed to automata over bytes. Each becomes a machine that finds its
leftmost, longest matches one after the other; the machines' product is built by subset
construction over byte classes and minimised into one transition array. A state says
which rules' matches ended just before the byte that led to it, so a pass reports match
ends. The start is found by a reversed automaton from the end, and a rule's value by an
anchored automaton of its head.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh


@dataclass(frozen=True)
class Rule:
    """A match is `head` then `body`; its body must have `least` bytes or it is dropped."""

    kind: str
    head: str
    body: str
    least: int = 1
    any_case: bool = False                     # letters of the head in either case


# The rules of the base result.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 8, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 12),
    Rule("hex", "", "[0-9a-f]{8}[0-9a-f]*", 32),      # counting on to 32 would multiply the states
)
# Public token formats that add spans.
MORE = (
    Rule("github", "gh[opsu]_", "[A-Za-z0-9]+", 36),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("stripe", "[rs]k_live_", "[A-Za-z0-9]+", 24),
    Rule("jwt", "", "eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    Rule("pem", "", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"),
)
RULES = BASE + MORE


# --- patterns -------------------------------------------------------------------------

def parse(pattern: str, any_case: bool = False):
    """Tree of ('set', bytes) | ('cat', parts) | ('or', parts) | ('rep', part, least, most)."""
    at = 0

    def char() -> int:
        nonlocal at
        if pattern[at] != "\\":
            at += 1
            return ord(pattern[at - 1])
        if pattern[at + 1] == "x":
            at += 4
            return int(pattern[at - 2:at], 16)
        at += 2
        return ord(pattern[at - 1])

    def leaf(chars) -> tuple:
        own = frozenset(chars)
        if any_case:
            own |= {ord(f(chr(c))) for c in own if chr(c).isalpha() for f in (str.lower, str.upper)}
        return "set", own

    def bracket() -> tuple:
        nonlocal at
        chars: set[int] = set()
        while pattern[at] != "]":
            low = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                chars.update(range(low, char() + 1))
            else:
                chars.add(low)
        at += 1
        return leaf(chars)

    def item():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            node = branch()
            at += 1
        elif pattern[at] == "[":
            at += 1
            node = bracket()
        else:
            node = leaf([char()])
        while at < len(pattern) and pattern[at] in "?*+{":
            sign, at = pattern[at], at + 1
            if sign == "{":
                n = pattern.index("}", at)
                low, _, high = pattern[at:n].partition(",")
                at = n + 1
                node = ("rep", node, int(low), int(high or low))
            else:
                node = ("rep", node, int(sign == "+"), 1 if sign == "?" else None)
        return node

    def branch():
        nonlocal at
        choices, row = [], []
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                choices.append(("cat", row))
                row = []
            else:
                row.append(item())
        return ("or", [*choices, ("cat", row)]) if choices else ("cat", row)

    return branch()


def backwards(node):
    if node[0] == "cat":
        return "cat", [backwards(x) for x in reversed(node[1])]
    if node[0] == "or":
        return "or", [backwards(x) for x in node[1]]
    return node if node[0] == "set" else ("rep", backwards(node[1]), *node[2:])


class Nfa:
    def __init__(self, tree):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []
        self.accept = self._state()
        self.start = self._build(tree, self.accept)
        self._closed: dict[frozenset, frozenset] = {}

    def _state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.moves) - 1

    def _build(self, node, to: int) -> int:
        """First state of `node`, whose end leads to `to`."""
        kind = node[0]
        if kind == "set":
            s = self._state()
            self.moves[s] = (node[1], to)
            return s
        if kind == "cat":
            for part in reversed(node[1]):
                to = self._build(part, to)
            return to
        if kind == "or":
            s = self._state()
            self.empty[s] = [self._build(part, to) for part in node[1]]
            return s
        _, part, least, most = node
        if most is None:
            s = self._state()
            self.empty[s] = [self._build(part, s), to]
            to = s
        else:
            for _ in range(most - least):
                s = self._state()
                self.empty[s] = [self._build(part, to), to]
                to = s
        for _ in range(least):
            to = self._build(part, to)
        return to

    def closure(self, states) -> frozenset:
        key = frozenset(states)
        if key not in self._closed:
            todo, seen = list(key), set(key)
            while todo:
                for t in self.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self._closed[key] = frozenset(s for s in seen if self.moves[s] or s == self.accept)
        return self._closed[key]

    def after(self, states: frozenset, byte: int) -> frozenset:
        return self.closure(m[1] for s in states if (m := self.moves[s]) and byte in m[0])


class Anchored:
    """Subset automaton of one pattern from a fixed place: {state: {byte: state}}, accepting states."""

    def __init__(self, tree):
        nfa = Nfa(tree)
        first = nfa.closure([nfa.start])
        number, todo = {first: 0}, [first]
        self.steps: list[dict[int, int]] = []
        self.accepts: list[bool] = []
        while todo:
            own = todo.pop(0)
            row = {}
            for byte in set().union(*(nfa.moves[s][0] for s in own if nfa.moves[s])):
                to = nfa.after(own, byte)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[byte] = number[to]
            self.steps.append(row)
            self.accepts.append(nfa.accept in own)

    def longest(self, data: bytes, at: int, stop: int, way: int) -> int:
        """Farthest place up to `stop` where a match that starts at `at` can end."""
        state, best = 0, at
        while at != stop:
            state = self.steps[state].get(data[at if way > 0 else at - 1], -1)
            if state < 0:
                break
            at += way
            if self.accepts[state]:
                best = at
        return best


class Machine:
    """Leftmost-longest matches of one rule, one after the other, as states of thread groups.

    A group holds the threads of one start, oldest first. Once the oldest group accepts,
    younger ones go. Rules must be decided byte by byte: from a match's first accepted
    byte on each byte either extends it or ends it. Others are refused.
    """

    def __init__(self, tree, kind: str):
        self.nfa, self.kind = Nfa(tree), kind
        self.fresh = self.nfa.closure([self.nfa.start])
        if self.nfa.accept in self.fresh:
            raise ValueError(f"rule {kind} matches the empty text")

    def _advance(self, groups, byte: int):
        out, seen = [], frozenset()
        for g in groups:
            n = self.nfa.after(g, byte) - seen
            if n:
                out.append(n)
                seen |= n
                if self.nfa.accept in n:
                    if len(out) > 1:
                        raise ValueError(f"rule {self.kind} needs backtracking")
                    break
        return tuple(out)

    def accepted(self, groups) -> bool:
        return bool(groups) and self.nfa.accept in groups[0]

    def step(self, groups, byte: int | None):
        """(next groups, whether a match ended before the byte); None is the end of the text."""
        ended = False
        if self.accepted(groups):
            out = self._advance(groups, byte) if byte is not None else ()
            if out:
                if not self.accepted(out):
                    raise ValueError(f"rule {self.kind} needs backtracking")
                return out, False
            groups, ended = (), True
        return (self._advance((*groups, self.fresh), byte) if byte is not None else ()), ended


class Scanner:
    """The combined automaton of all rules, and what places its matches."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = tuple(rules)
        trees = [("cat", [parse(r.head, r.any_case), parse(r.body)]) for r in rules]
        self.back = [Anchored(backwards(t)) for t in trees]
        self.heads = [Anchored(parse(r.head, r.any_case)) for r in rules]
        machines = [Machine(t, r.kind) for t, r in zip(trees, rules)]

        sets = {m[0] for x in machines for m in x.nfa.moves if m}
        by_use: dict[tuple, list[int]] = defaultdict(list)
        for byte in range(256):
            by_use[tuple(byte in s for s in sets)].append(byte)
        classes = list(by_use.values())
        self.table = bytes(next(k for k, c in enumerate(classes) if b in c) for b in range(256))
        self.end = len(classes)
        samples: list[int | None] = [c[0] for c in classes] + [None]

        steps: list[dict] = [{} for _ in machines]
        first = (tuple(() for _ in machines), ())
        number, todo, rows = {first: 0}, [first], []
        while todo:                                            # subset construction of the product
            groups, _ = todo.pop(0)
            row = []
            for byte in samples:
                nxt, ended = [], []
                for k, (m, g) in enumerate(zip(machines, groups)):
                    if (g, byte) not in steps[k]:
                        steps[k][g, byte] = m.step(g, byte)
                    to, over = steps[k][g, byte]
                    nxt.append(to)
                    if over:
                        ended.append(k)
                node = (tuple(nxt), tuple(ended))
                if node not in number:
                    number[node] = len(number)
                    todo.append(node)
                row.append(number[node])
            rows.append(row)
        outputs = [ended for _, ended in number]
        self._minimise(np.array(rows), outputs)

    def _minimise(self, rows: np.ndarray, outputs: list[tuple]) -> None:
        """Moore's refinement: states part while their outputs or successors' blocks differ."""
        _, block = np.unique([repr(o) for o in outputs], return_inverse=True)
        n = block.max() + 1
        while True:
            _, block = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
            block = block.ravel()
            if block.max() + 1 == n:
                break
            n = block.max() + 1
        some = {b: s for s, b in enumerate(block)}
        order = sorted(range(n), key=lambda b: (bool(outputs[some[b]]), b))
        place = {b: k for k, b in enumerate(order)}
        width = rows.shape[1]
        self.steps = [place[block[t]] * width for b in order for t in rows[some[b]]]
        self.start = place[block[0]] * width
        self.ended = {place[b] * width: outputs[some[b]] for b in order if outputs[some[b]]}
        self.hot = min(self.ended, default=len(self.steps))
        self.states = n

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule number) in code points, by start and then rule."""
        data = text.encode("utf-8", "surrogatepass")
        s, steps, hot, hits = self.start, self.steps, self.hot, []
        for i, c in enumerate(data.translate(self.table) + bytes([self.end])):
            s = steps[s + c]
            if s >= hot:
                hits.append((i, s))
        if not hits:
            return []
        spans, free = [], [0] * len(self.rules)
        for end, state in hits:
            for k in self.ended[state]:
                start = self.back[k].longest(data, end, free[k], -1)
                free[k] = end
                if end - self.heads[k].longest(data, start, end, 1) >= self.rules[k].least:
                    spans.append((start, end, k))
        if not text.isascii():
            lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            place = lambda b: int(lead[b - 1]) if b else 0
            spans = [(place(a), place(b), k) for a, b, k in spans]
        return sorted(spans, key=lambda x: (x[0], x[2]))


def scan(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add `spans`: array of (kind, start, end) in code points over each whole text.

    NULL and empty texts have none; rows are independent, so repeated rows and ids stay. A
    column named `spans` is replaced, all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))        # bounded by the rules

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = shared.value
        for s in series:
            yield pd.Series([[{"kind": scanner.rules[k].kind, "start": a, "end": b} for a, b, k in scanner.find(t or "")] for t in s],
                            dtype=object)

    tmp = fresh(docs, "spans")
    return docs.withColumn(tmp, run(F.col(text).cast("string"))).withColumn("spans", F.col(tmp)).drop(*({tmp} - {"spans"}))
