"""Expressions over single characters as automata: a match takes time linear in the text, whatever the expression.

The expression becomes a graph of nodes that read a character or none; sets of nodes become states when a text
first reaches them, so only the part of the deterministic automaton that texts need is ever built.
"""

from __future__ import annotations

import re

#: States kept; beyond that they are forgotten and built again as needed.
MAX_STATES = 20_000


class Automaton:
    """Literals, sets of literals, groups, alternatives and greedy repeats."""

    def __init__(self, pattern: str):
        self.free: list[list[int]] = []  # nodes reached without reading
        self.read: list[tuple[frozenset[str], int] | None] = []  # (characters, node after one of them)
        self.start = self._node()
        self.end = self._sequence(re._parser.parse(pattern), self.start)
        self._reach: dict[int, tuple[int, ...]] = {}
        self._forget()

    def _node(self) -> int:
        self.free.append([])
        self.read.append(None)
        return len(self.free) - 1

    def _sequence(self, parts, at: int) -> int:
        for op, arg in parts:
            at = self._part(str(op), arg, at)
        return at

    def _part(self, op: str, arg, at: int) -> int:
        if op in ("LITERAL", "IN"):
            chars = frozenset(chr(a) for _, a in ([(op, arg)] if op == "LITERAL" else arg))
            reader, after = self._node(), self._node()
            self.free[at].append(reader)
            self.read[reader] = (chars, after)
            return after
        if op == "SUBPATTERN":
            return self._sequence(arg[-1], at)
        if op == "BRANCH":
            after = self._node()
            for way in arg[1]:
                begin = self._node()
                self.free[at].append(begin)
                self.free[self._sequence(way, begin)].append(after)
            return after
        if op == "MAX_REPEAT":
            lo, hi, inner = arg
            for _ in range(lo):
                at = self._sequence(inner, at)
            after = self._node()
            self.free[at].append(after)
            if hi == re._parser.MAXREPEAT:
                begin = self._node()
                self.free[at].append(begin)
                last = self._sequence(inner, begin)
                self.free[last] += [begin, after]
            else:
                for _ in range(hi - lo):
                    at = self._sequence(inner, at)
                    self.free[at].append(after)
            return after
        raise ValueError(op)

    def _readers(self, node: int) -> tuple[int, ...]:
        """Nodes that read, and the end, reached from a node without reading."""
        known = self._reach.get(node)
        if known is None:
            seen, open_ = {node}, [node]
            while open_:
                for n in self.free[open_.pop()]:
                    if n not in seen:
                        seen.add(n)
                        open_.append(n)
            known = self._reach[node] = tuple(n for n in seen if self.read[n] is not None or n == self.end)
        return known

    def _forget(self) -> None:
        self._number: dict[frozenset[int], int] = {}
        self._states: list[frozenset[int]] = []
        self._next: list[dict[str, int]] = []
        self._first = self._state(frozenset(self._readers(self.start)))

    def _state(self, nodes: frozenset[int]) -> int:
        i = self._number.get(nodes)
        if i is None:
            i = self._number[nodes] = len(self._states)
            self._states.append(nodes)
            self._next.append({})
        return i

    def fullmatch(self, text: str) -> bool:
        if len(self._states) > MAX_STATES:
            self._forget()
        state = self._first
        for c in text:
            after = self._next[state].get(c)
            if after is None:
                to: set[int] = set()
                for n in self._states[state]:
                    r = self.read[n]
                    if r is not None and c in r[0]:
                        to.update(self._readers(r[1]))
                after = self._next[state][c] = self._state(frozenset(to))
            state = after
            if not self._states[state]:
                return False
        return self.end in self._states[state]
