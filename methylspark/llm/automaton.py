"""Byte automata: regexes to NFAs, subset construction, minimisation, transition arrays.

The regex dialect: literals, ``\\x20``-style bytes and escaped characters, classes with ranges and
``^``, groups, ``|``, and ``? * + {m} {m,} {m,n}``. Everything is over single bytes.
"""

from __future__ import annotations

import numpy as np


class Nfa:
    """States are numbers; ``edges[s]`` has (set of bytes, target), ``free[s]`` empty moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1


class _Reader:
    """A regex as a tree of ("set", bytes), ("seq", ..), ("alt", ..), ("rep", node, low, high)."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i:self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def tree(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated(self.atom()))
        return ("seq", items)

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.tree()
            self.take()
            return node
        if c == "[":
            return ("set", self.members())
        return ("set", frozenset([self.byte(c)]))

    def byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2:self.i], 16)
        return ord(c)

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = self.byte(self.take())
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                found.update(range(low, self.byte(self.take()) + 1))
            else:
                found.add(low)
        self.take()
        return frozenset(set(range(256)) - found if negated else found)

    def repeated(self, node):
        c = self.peek()
        if not c or c not in "?*+{":
            return node
        self.take()
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
        if c == "{":
            inner = self.p[self.i:self.p.index("}", self.i)]
            self.i += len(inner) + 1
            first, comma, last = inner.partition(",")
            low, high = int(first), int(last) if last else None if comma else int(first)
        return ("rep", node, low, high)


def _either_case(node):
    kind = node[0]
    if kind == "set":
        low = {b + 32 for b in node[1] if 65 <= b <= 90}
        return ("set", node[1] | low | {b - 32 for b in node[1] if 97 <= b <= 122})
    if kind == "rep":
        return ("rep", _either_case(node[1]), *node[2:])
    return (kind, [_either_case(x) for x in node[1]])


def _backwards(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", _backwards(node[1]), *node[2:])
    items = [_backwards(x) for x in node[1]]
    return (kind, items[::-1] if kind == "seq" else items)


def parse(pattern: str, either_case: str = ""):
    """The tree of ``pattern``, after ``either_case``, a leading part whose letters have no case."""
    tree = _Reader(pattern).tree()
    return ("seq", [_either_case(_Reader(either_case).tree()), tree]) if either_case else tree


def _add(nfa: Nfa, node, start: int) -> int:
    """Add ``node`` from ``start``; the state where it ends."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.edges[start].append((node[1], end))
        return end
    if kind == "seq":
        for item in node[1]:
            start = _add(nfa, item, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for item in node[1]:
            nfa.free[_add(nfa, item, start)].append(end)
        return end
    _, inner, low, high = node
    for _ in range(low):
        start = _add(nfa, inner, start)
    if high is None:
        loop = nfa.state()
        nfa.free[start].append(loop)
        nfa.free[_add(nfa, inner, loop)].append(loop)
        return loop
    end = nfa.state()
    for _ in range(high - low):
        nfa.free[start].append(end)
        start = _add(nfa, inner, start)
    nfa.free[start].append(end)
    return end


class Dfa:
    """``next[s, b]`` is the following state; ``accepts[s]`` the rules that end there.

    State 0 is the start. In an anchored automaton ``dead`` is the state that nothing leaves,
    or -1.
    """

    def __init__(self, trees: list, search: bool) -> None:
        """``search``: a match may begin at every byte, else only at the first."""
        nfa = Nfa()
        start = nfa.state()
        ends = {}
        for rule, tree in enumerate(trees):
            first = nfa.state()
            nfa.free[start].append(first)
            ends[_add(nfa, tree, first)] = rule
        table, finals = self._subsets(nfa, start, ends, search)
        self.next, self.accepts = self._smallest(table, finals)
        stuck = [s for s in range(len(self.next))
                 if not self.accepts[s] and (self.next[s] == s).all()]
        self.dead = stuck[0] if stuck else -1

    @staticmethod
    def _subsets(nfa: Nfa, start: int, ends: dict[int, int], search: bool):
        reach: dict[int, frozenset[int]] = {}

        def closed(s: int) -> frozenset[int]:
            if s not in reach:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.free[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                reach[s] = frozenset(seen)
            return reach[s]

        # bytes that every edge treats alike share a column while subsets are formed
        sets = list({members for edges in nfa.edges for members, _ in edges})
        alike: dict[tuple[bool, ...], int] = {}
        column = [alike.setdefault(tuple(b in m for m in sets), len(alike)) for b in range(256)]
        covers = {m: {column[b] for b in m} for m in sets}

        origin = closed(start)
        number, order, table, finals = {origin: 0}, [origin], [], []
        for subset in order:  # grows while it is walked
            targets: list[set[int]] = [set() for _ in alike]
            for s in subset:
                for members, t in nfa.edges[s]:
                    for c in covers[members]:
                        targets[c] |= closed(t)
            row = []
            for target in targets:
                key = frozenset(target | origin) if search else frozenset(target)
                if key not in number:
                    number[key] = len(order)
                    order.append(key)
                row.append(number[key])
            table.append([row[c] for c in column])
            finals.append(tuple(sorted(ends[s] for s in subset if s in ends)))
        return np.array(table, np.int32), finals

    @staticmethod
    def _smallest(table: np.ndarray, finals: list[tuple[int, ...]]):
        """Moore's refinement: states stay together while all their moves do."""
        names = {f: k for k, f in enumerate(dict.fromkeys(finals))}
        block = np.array([names[f] for f in finals])
        while True:
            _, first, finer = np.unique(np.column_stack([block, block[table]]), axis=0,
                                        return_index=True, return_inverse=True)
            finer = finer.ravel()
            if len(first) == block.max() + 1:
                break
            block = finer
        rank = np.argsort(np.argsort([np.flatnonzero(finer == finer[f])[0] for f in first]))
        block = rank[finer]  # the start stays state 0
        keep = np.zeros(len(first), np.int64)
        keep[rank] = first
        return block[table[keep]].astype(np.int32), [finals[k] for k in keep]


def forward_and_back(trees: list) -> tuple[Dfa, list[Dfa], list[Dfa]]:
    """One searching automaton for all rules; per rule, one from a start and one from an end."""
    return (Dfa(trees, True), [Dfa([t], False) for t in trees],
            [Dfa([_backwards(t)], False) for t in trees])
