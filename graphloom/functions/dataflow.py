"""Monotone dataflow over one function: sets as integers' bits, constants, intervals with widening, and taint.

A function is its graph of blocks in execution order, and for each block its events or instructions.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from graphloom.functions.digraph import Graph, flat, reverse, reverse_post_order, weak_order

STRATEGIES = ("rpo", "po", "wto", "fifo", "fifo-r", "lifo")
MAX_VISITS = 20_000


class TooManyVisits(Exception):
    pass


def gen_kill(events: list[tuple[str, bool]], bit: dict[str, int]) -> tuple[int, int]:
    """(uses that no definition in the block precedes, variables defined)"""
    use = define = 0
    for var, is_def in events:
        if is_def:
            define |= bit[var]
        elif not define & bit[var]:
            use |= bit[var]
    return use, define


class Worklist:
    def __init__(self, strategy: str, order: list) -> None:
        self.strategy, self.rank = strategy, {n: k for k, n in enumerate(order)}
        self.items: deque | list = [] if strategy in ("rpo", "po", "wto") else deque()
        self.held: set = set()

    def add(self, n) -> None:
        if n not in self.held:
            self.held.add(n)
            if isinstance(self.items, list):
                heapq.heappush(self.items, (self.rank[n], n))
            else:
                self.items.append(n)

    def take(self):
        n = heapq.heappop(self.items)[1] if isinstance(self.items, list) else self.items.pop() if self.strategy == "lifo" else self.items.popleft()
        self.held.discard(n)
        return n


def solve(g: Graph, root, gen: dict, kill: dict, forward: bool, boundary: int = 0, strategy: str = "rpo", max_visits: int | None = None) -> tuple[dict, dict, int]:
    """The least solution of in = union of the outs before, out = gen | in & ~kill, and how many blocks were visited. It always ends, so a budget is only kept if one is given."""
    before = reverse(g)
    into, onto = (before, g) if forward else (g, before)
    rpo = reverse_post_order(g, [root])
    reached = set(rpo)
    rpo += [n for n in g if n not in reached]
    order = rpo
    if strategy == "po" or strategy in ("fifo", "lifo", "rpo", "fifo-r") and not forward:
        order = rpo[::-1]
    if strategy == "wto":
        nested = weak_order(g, root)
        if nested is None:
            raise ValueError("no weak topological order: the graph is irreducible")
        order = flat(nested)
        ordered = set(order)
        order += [n for n in g if n not in ordered]
    if strategy == "fifo-r":
        order = order[::-1]
    entry = {n: 0 for n in g}
    exit_ = {n: gen.get(n, 0) for n in g}
    work, visits = Worklist(strategy, order), 0
    for n in order:
        work.add(n)
    while work.held:
        n = work.take()
        visits += 1
        if max_visits is not None and visits > max_visits:
            raise TooManyVisits(visits)
        state = boundary if (n == root if forward else not g[n]) else 0
        for p in into[n]:
            state |= exit_[p]
        entry[n] = state
        out = gen.get(n, 0) | state & ~kill.get(n, 0)
        if out != exit_[n]:
            exit_[n] = out
            for s in onto[n]:
                work.add(s)
    return entry, exit_, visits


# A flat lattice of constants: None is no value yet, TOP any.
TOP = "top"


def join_constants(a, b):
    return b if a is None else a if b is None or a == b else TOP


def evaluate(op: str, a, b):
    if a == TOP or b == TOP or a is None or b is None:
        return TOP
    return {"+": a + b, "-": a - b, "*": a * b}.get(op, TOP)


@dataclass(frozen=True)
class Interval:
    """lo > hi is the empty one; None at an end is infinity."""

    lo: int | None
    hi: int | None
    empty: bool = False

    def join(self, o: Interval) -> Interval:
        if self.empty or o.empty:
            return o if self.empty else self
        return Interval(None if self.lo is None or o.lo is None else min(self.lo, o.lo), None if self.hi is None or o.hi is None else max(self.hi, o.hi))

    def widen(self, now: Interval) -> Interval:
        """A bound that moved outwards since self goes to infinity; the other stays where it was."""
        if self.empty or now.empty:
            return self.join(now)
        low = self.lo is None or now.lo is not None and now.lo >= self.lo
        high = self.hi is None or now.hi is not None and now.hi <= self.hi
        return Interval(self.lo if low else None, self.hi if high else None)

    def plus(self, o: Interval) -> Interval:
        if self.empty or o.empty:
            return EMPTY
        return Interval(None if self.lo is None or o.lo is None else self.lo + o.lo, None if self.hi is None or o.hi is None else self.hi + o.hi)

    def negated(self) -> Interval:
        return self if self.empty else Interval(None if self.hi is None else -self.hi, None if self.lo is None else -self.lo)

    def meet(self, op: str, c: int) -> Interval:
        """What remains where the comparison with c holds."""
        lo, hi = {"<": (None, c - 1), "<=": (None, c), ">": (c + 1, None), ">=": (c, None), "==": (c, c)}.get(op, (None, None))
        if self.empty:
            return EMPTY
        low = lo if self.lo is None else self.lo if lo is None else max(lo, self.lo)
        high = hi if self.hi is None else self.hi if hi is None else min(hi, self.hi)
        return EMPTY if low is not None and high is not None and low > high else Interval(low, high)


EMPTY, ANY = Interval(0, -1, True), Interval(None, None)
NEGATED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}


@dataclass
class Cost:
    visits: int = 0
    joins: int = 0
    widens: int = 0


def fixpoint(g: Graph, root, start: dict, transfer: Callable, join: Callable, widen: Callable | None = None, on_edge: Callable = lambda s, a, b: s, max_visits: int | None = MAX_VISITS) -> tuple[dict, dict, Cost]:
    """States before and behind each reached block, visited by reverse post-order. A block with an edge back to it widens against its former state."""
    order = reverse_post_order(g, [root])
    rank = {n: k for k, n in enumerate(order)}
    heads = {b for a in order for b in g[a] if rank[b] <= rank[a]}
    before, behind, cost = {}, {}, Cost()
    before_of = reverse(g)
    heap, held = [(0, root)], {root}
    while heap:
        _, n = heapq.heappop(heap)
        held.discard(n)
        cost.visits += 1
        if max_visits is not None and cost.visits > max_visits:
            raise TooManyVisits(cost.visits)
        state = dict(start) if n == root else None
        for p in before_of[n]:
            if p in behind:
                s = on_edge(behind[p], p, n)
                if s is not None:
                    if state is None:
                        state = dict(s)
                    else:
                        cost.joins += 1
                        state = {v: join(state.get(v), s.get(v)) for v in state.keys() | s.keys()}
        if state is None:
            continue
        if widen and n in heads and n in before:
            cost.widens += 1
            state = {v: widen(before[n].get(v), x) for v, x in state.items()}
        before[n] = state
        after = transfer(n, dict(state))
        if n not in behind or behind[n] != after:
            behind[n] = after
            for s in g[n]:
                if s not in held:
                    held.add(s)
                    heapq.heappush(heap, (rank[s], s))
    return before, behind, cost


def run_constants(state: dict, instructions: list[tuple]) -> dict:
    """Instructions (target, operation, operand, operand); an operand is a number or a variable, of which a missing one is any value."""
    for target, op, a, b in instructions:
        x, y = (v if isinstance(v, int) else state.get(v, TOP) if v is not None else None for v in (a, b))
        state[target] = x if op == "=" else evaluate(op, x, y)
    return state


def run_intervals(state: dict, instructions: list[tuple]) -> dict:
    for target, op, a, b in instructions:
        x, y = (Interval(v, v) if isinstance(v, int) else state.get(v, ANY) if v is not None else ANY for v in (a, b))
        state[target] = x if op == "=" else x.plus(y) if op == "+" else x.plus(y.negated()) if op == "-" else ANY
    return state
