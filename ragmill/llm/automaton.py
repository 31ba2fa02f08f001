"""Regular expressions compiled together into one minimal deterministic automaton over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that no UTF-8 text has; they lead every automaton that searches back to its start.
NEVER = frozenset(range(0xF8, 0x100))
SEPARATOR = 0xFF


class _Reader:
    """Reads a pattern: literals, \\xHH, classes, groups, (?i:...), |, ?, *, +, {m}, {m,}, {m,n}; ASCII only.

    Trees are ("set", bytes), ("cat", parts), ("alt", parts) and ("rep", part, least, most).
    """

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False
        if not pattern.isascii():
            raise ValueError(f"not ASCII: {pattern}")

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self, n: int = 1) -> str:
        self.i += n
        return self.s[self.i - n : self.i]

    def tree(self) -> tuple:
        out = self.choice()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.peek()} at {self.i} of {self.s}")
        return out

    def choice(self) -> tuple:
        parts = [self.row()]
        while self.peek() == "|":
            self.take()
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def row(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part: tuple) -> tuple:
        while (mark := self.peek()) and mark in "?*+{":
            self.take()
            if mark == "{":
                least, comma, most = self.s[self.i : self.s.index("}", self.i)].partition(",")
                self.i = self.s.index("}", self.i) + 1
                part = ("rep", part, int(least), int(most or least) if most or not comma else None)
            else:
                part = ("rep", part, int(mark == "+"), 1 if mark == "?" else None)
        return part

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            before = self.fold
            if self.s.startswith("?i:", self.i):
                self.take(3)
                self.fold = True
            elif self.s.startswith("?:", self.i):
                self.take(2)
            out = self.choice()
            if self.take() != ")":
                raise ValueError(f"open group in {self.s}")
            self.fold = before
            return out
        if c == "[":
            return ("set", self.members())
        return ("set", self.either(self.char(c)))

    def char(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        return int(self.take(2), 16) if c == "x" else {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def either(self, *codes: int) -> frozenset:
        chars = map(chr, codes)
        return frozenset(ord(x) for c in chars for x in ((c.lower(), c.upper()) if self.fold else (c,)))

    def members(self) -> frozenset:
        out, negated = set(), self.peek() == "^"
        self.i += negated
        while self.peek() != "]":
            low = high = self.char(self.take())
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] != "]":
                self.take()
                high = self.char(self.take())
            out |= self.either(*range(low, high + 1))
        self.take()
        return frozenset(range(256)) - out - NEVER if negated else frozenset(out)


def mirrored(tree: tuple) -> tuple:
    """The tree of the same strings, read backwards."""
    if tree[0] == "cat":
        return ("cat", [mirrored(p) for p in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [mirrored(p) for p in tree[1]])
    return ("rep", mirrored(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Positions:
    """Position automaton of several trees: what a byte read at a place may be followed by; sets are bits of integers."""

    def __init__(self):
        self.sets: list[frozenset] = []
        self.follow: list[int] = []

    def add(self, tree: tuple) -> tuple[bool, int, int]:
        """Whether the tree takes the empty string, its first and its last positions."""
        kind = tree[0]
        if kind == "set":
            self.sets.append(tree[1])
            self.follow.append(0)
            bit = 1 << (len(self.sets) - 1)
            return False, bit, bit
        if kind == "alt":
            got = [self.add(p) for p in tree[1]]
            return any(g[0] for g in got), _union(g[1] for g in got), _union(g[2] for g in got)
        if kind == "cat":
            return self.row([self.add(p) for p in tree[1]])
        _, part, least, most = tree
        got = [self.add(part) for _ in range(max(least, most or 1, 1))]
        got = [(empty or i >= least, first, last) for i, (empty, first, last) in enumerate(got)]
        if most is None:
            self.link(got[-1][2], got[-1][1])
        return self.row(got)

    def row(self, parts: list[tuple]) -> tuple[bool, int, int]:
        empty, first, last = True, 0, 0
        for e, f, l in parts:
            self.link(last, f)
            first |= f if empty else 0
            last = l | last if e else l
            empty &= e
        return empty, first, last

    def link(self, before: int, after: int) -> None:
        for p in _bits(before):
            self.follow[p] |= after


def _union(xs) -> int:
    out = 0
    for x in xs:
        out |= x
    return out


def _bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


@dataclass(frozen=True)
class Automaton:
    """After byte b in state s comes state table[s, kinds[b]]; bit r of accepts[s] is set where pattern r ends. State `start` begins, `dead` never accepts."""

    kinds: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    start: int
    dead: int


def compile_all(patterns: list[str], search: bool = False, backwards: bool = False) -> Automaton:
    """One automaton for all patterns: subset construction over their positions, then minimisation.

    With `search` it finds strings that end at the present byte, wherever they began; without, such as begin where it
    began. With `backwards` texts are read from their end. At most 63 patterns, none of which takes the empty string.
    """
    places, firsts, lasts = _Positions(), [], []
    for pattern in patterns:
        tree = _Reader(pattern).tree()
        empty, first, last = places.add(mirrored(tree) if backwards else tree)
        if empty:
            raise ValueError(f"takes the empty string: {pattern}")
        firsts.append(first)
        lasts.append(last)
    member = np.array([[b in s for s in places.sets] for b in range(256)])
    groups, kinds = np.unique(member, axis=0, return_inverse=True)
    has = [_union(1 << int(p) for p in np.flatnonzero(g)) for g in groups]
    begin = _union(firsts)
    # a state is the set of positions read last; -1 is the start of an automaton that doesn't search
    order, rows, number = [0 if search else -1], [], {0 if search else -1: 0}
    for state in order:
        after = begin if state == -1 else _union(places.follow[p] for p in _bits(state)) | (begin if search else 0)
        row = []
        for h in has:
            to = after & h
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    accepts = np.array([sum(1 << r for r, last in enumerate(lasts) if s > 0 and s & last) for s in order], np.int64)
    part, table = minimised(np.array(rows), accepts)
    _, one = np.unique(part, return_index=True)
    dead = int(part[number[0]]) if not search and 0 in number else -1
    return Automaton(kinds.reshape(-1).astype(np.uint8), table[one].astype(np.uint16), accepts[one], int(part[0]), dead)


def minimised(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each state, states of a class having the same future, and `table` with classes for states.

    Classes start from what states accept and are split until those of a class lead to the same classes.
    """
    part = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            if finer.max() >= 1 << 16:
                raise ValueError("over 65,536 states")
            return finer, finer[table]
        part = finer


def find(auto: Automaton, data: np.ndarray, lane: int = 512, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Places of `data` after whose byte the searching automaton accepts, and what it accepts there, in one pass.

    The data is cut into lanes, which step together. Each starts as if nothing stood before it; where the lane before
    ended in another state, its first steps are done again from there, until they meet the states they had.
    """
    at, what, carry = [], [], auto.start
    for begin in range(0, data.size, piece):
        part = data[begin : begin + piece]
        n = -(-part.size // lane)
        padded = np.full(n * lane, SEPARATOR, np.uint8)
        padded[: part.size] = part
        kinds = np.ascontiguousarray(auto.kinds[padded].reshape(n, lane).T)
        width, flat = auto.table.shape[1], auto.table.reshape(-1)
        states = np.empty((lane, n), np.uint16)
        now = np.full(n, auto.start, np.int64)
        for j in range(lane):
            now = flat[now * width + kinds[j]].astype(np.int64)
            states[j] = now
        entered = np.full(n, auto.start, np.int64)
        while True:
            enters = np.concatenate(([carry], states[-1, :-1])).astype(np.int64)
            odd = np.flatnonzero(enters != entered)
            if not odd.size:
                break
            entered, now = enters, enters[odd]
            for j in range(lane):
                now = flat[now * width + kinds[j, odd]].astype(np.int64)
                off = now != states[j, odd]
                odd, now = odd[off], now[off]
                if not odd.size:
                    break
                states[j, odd] = now
        accepted = auto.accepts[states]
        j, k = np.nonzero(accepted)
        place = k * lane + j
        inside = place < part.size
        at.append(place[inside] + begin)
        what.append(accepted[j, k][inside])
        carry = int(states[(part.size - 1) % lane, n - 1])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, what = np.concatenate(at), np.concatenate(what)
    order = np.argsort(at)
    return at[order], what[order]
