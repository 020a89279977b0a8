"""Checkers over control-flow graphs: moves, locks, calls that must happen once, unchecked access. Each asks what holds on some way and what on all.

What a block does to its variable: signup sets it (initialises, acquires, checks), purchase gives it up (moves, releases, calls), click uses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.functions import dataflow as df
from graphloom.functions import digraph as dg
from graphloom.operators.cfg import Function, each


def doing(f: Function, kind: str) -> dict[int, int]:
    """Which variable each block of the kind acts on, as a bit."""
    return {b: sum(f.bit[v] for v, _ in es) for b, es in f.events.items() if f.kind[b] == kind}


def some_way(f: Function, gen: dict[int, int], kill: dict[int, int], at_first: int) -> dict[int, int]:
    """What may hold before each block."""
    return df.solve(f.g, f.entry, gen, kill, True, at_first)[0]


def moves_of(f: Function) -> list[tuple]:
    moved, kept = doing(f, "purchase"), doing(f, "signup")
    may = some_way(f, moved, kept, 0)
    may_not = some_way(f, kept, moved, sum(f.bit.values()))
    live = dg.levels(f.g, [f.entry])
    return [(b, v, "possible" if may_not[b] & f.bit[v] else "certain") for b, used in doing(f, "click").items() if b in live for v in f.names(used & may[b])]


def moves(facts_: DataFrame) -> DataFrame:
    """Uses of a variable that was moved: on all ways (certain) or on some (possible). What the entry doesn't reach is left out."""
    return each(facts_, moves_of, "b long, v long, verdict string")


def locks(facts_: DataFrame) -> DataFrame:
    """Locks acquired while they may be held, released while they may not be, and variables used while their lock may not be held."""

    def of(f: Function) -> list[tuple]:
        takes, gives, uses = doing(f, "signup"), doing(f, "purchase"), doing(f, "click")
        held = some_way(f, takes, gives, 0)
        free = some_way(f, gives, takes, sum(f.bit.values()))
        rules = (("double acquire", takes, held), ("release unheld", gives, free), ("use unlocked", uses, free))
        live = dg.levels(f.g, [f.entry])
        return [(b, v, what) for what, at, state in rules for b, m in at.items() if b in live for v in f.names(m & state[b])]

    return each(facts_, of, "b long, v long, what string")


def called_once(facts_: DataFrame) -> DataFrame:
    """How often ways from entry to exit call each variable that is called at all: which of 0, 1 and more occur, and the verdict."""

    def of(f: Function) -> list[tuple]:
        calls, out = doing(f, "purchase"), []
        for v in f.vars:
            bit = f.bit[v]
            if not any(m & bit for m in calls.values()):
                continue
            before, behind, _ = df.fixpoint(f.g, f.entry, {"n": 1}, lambda b, s, bit=bit: {"n": (s["n"] << 1 | (s["n"] & 4)) & 7} if calls.get(b, 0) & bit else s, lambda a, b: (a or 0) | (b or 0), max_visits=None)
            n = behind.get(f.exit, {"n": 0})["n"]
            verdict = "once" if n == 2 else "never" if n == 1 else "more than once" if n & 4 else "not on every way"
            out.append((v, bool(n & 1), bool(n & 2), bool(n & 4), verdict))
        return out

    return each(facts_, of, "v long, zero boolean, one boolean, more boolean, verdict string")


def unchecked(facts_: DataFrame) -> DataFrame:
    """Uses that no check of the same variable dominates."""

    def of(f: Function) -> list[tuple]:
        dom, checks = f.dominators(), doing(f, "signup")
        return [(b, v) for b, m in doing(f, "click").items() if b in dom for v in f.names(m) if not any(checks.get(d, 0) & f.bit[v] for d in dom[b])]

    return each(facts_, of, "b long, v long")


def liveness_by_hand(facts_: DataFrame) -> DataFrame:
    """Variables live at a block's beginning, found element by element in rounds over all blocks until none changes."""

    def of(f: Function) -> list[tuple]:
        live: dict = dict.fromkeys(f.g, 0)
        changed = True
        while changed:
            changed = False
            for b in sorted(f.g, reverse=True):
                state = 0
                for s in f.g[b]:
                    state |= live[s]
                for v, is_def in reversed(f.events.get(b, [])):
                    state = state & ~f.bit[v] if is_def else state | f.bit[v]
                if state != live[b]:
                    live[b], changed = state, True
        return [(b, v) for b, state in live.items() for v in f.names(state)]

    return each(facts_, of, "b long, v long")


def typestates(facts_: DataFrame) -> DataFrame:
    """(fn, b, v, states): the states that a variable may be in where it is used: unknown (as the function begins), whole (set) and consumed (given up)."""

    def of(f: Function) -> list[tuple]:
        sets, gives = doing(f, "signup"), doing(f, "purchase")
        either = {b: sets.get(b, 0) | gives.get(b, 0) for b in f.g}
        every = sum(f.bit.values())
        ways = {"consumed": some_way(f, gives, sets, 0), "unknown": some_way(f, {}, either, every), "whole": some_way(f, sets, gives, 0)}
        return [(b, v, "|".join(s for s, at in ways.items() if at[b] & f.bit[v])) for b, used in doing(f, "click").items() for v in f.names(used)]

    return each(facts_, of, "b long, v long, states string")


def expired_loans(facts_: DataFrame) -> DataFrame:
    """(fn, issue, b, v, confidence): uses of a variable whose loan, issued where it was set, ended where it was given up: definite if on all ways from the issue that reach the use, else maybe."""

    def of(f: Function) -> list[tuple]:
        sets, gives, uses = doing(f, "signup"), doing(f, "purchase"), doing(f, "click")
        out = []
        for issue, mask in sets.items():
            for v in f.names(mask):
                bit = f.bit[v]
                seen, work = set(), [(s, False) for s in f.g[issue]]
                while work:
                    b, over = work.pop()
                    if (b, over) in seen:
                        continue
                    seen.add((b, over))
                    if not sets.get(b, 0) & bit:
                        work += [(s, over or bool(gives.get(b, 0) & bit)) for s in f.g[b]]
                out += [(issue, b, v, "maybe" if (b, False) in seen else "definite") for b, used in uses.items() if used & bit and (b, True) in seen]
        return out

    return each(facts_, of, "issue long, b long, v long, confidence string")


def leading_reports(facts_: DataFrame) -> DataFrame:
    """Uses after moves as moves gives them, without those that another report on the same variable dominates."""

    def of(f: Function) -> list[tuple]:
        dom, found = f.dominators(), moves_of(f)
        return [(b, v, verdict) for b, v, verdict in found if not any(x != b and w == v and x in dom[b] for x, w, _ in found)]

    return each(facts_, of, "b long, v long, verdict string")


def unit_status(facts_: DataFrame, most_visits: int) -> DataFrame:
    """(fn, status, reports): functions without a move are skipped, those whose analysis takes more visits than allowed give an error, the others the number of uses after moves."""

    def of(f: Function) -> list[tuple]:
        moved, kept = doing(f, "purchase"), doing(f, "signup")
        if not any(moved.values()):
            return [("skip:no-move", 0)]
        try:
            may, _, _ = df.solve(f.g, f.entry, moved, kept, True, 0, "rpo", most_visits)
        except df.TooManyVisits:
            return [("error:max-visits", 0)]
        n = sum(len(f.names(used & may[b])) for b, used in doing(f, "click").items())
        return [("found" if n else "clean", n)]

    return each(facts_, of, "status string, reports long")


def log(facts_: DataFrame) -> DataFrame:
    """(fn, step, event, b): what the search for moved variables does, as it goes."""

    def of(f: Function) -> list[tuple]:
        moved, kept, out = doing(f, "purchase"), doing(f, "signup"), [("begin", f.entry)]

        def enter(b: int, s: dict) -> dict:
            out.append(("enter", b))
            return {v: True for v in s if not kept.get(b, 0) & f.bit[v]} | dict.fromkeys(f.names(moved.get(b, 0)), True)

        df.fixpoint(f.g, f.entry, {}, enter, lambda a, b: a or b, max_visits=None)
        out.append(("converged", f.exit))
        return [(k, *row) for k, row in enumerate(out)]

    return each(facts_, of, "step long, event string, b long")
