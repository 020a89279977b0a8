"""Boolean formulas: built interned and simplified, solved with a limit of steps.

A formula is True, False, ("atom", name), ("not", f), ("and", frozenset) or ("or", frozenset).
"""

from __future__ import annotations

from dataclasses import dataclass

Formula = bool | tuple
MAX_STEPS = 1_000_000_000


def atom(name: str) -> Formula:
    return ("atom", name)


def negate(f: Formula) -> Formula:
    return (not f) if isinstance(f, bool) else f[1] if f[0] == "not" else ("not", f)


def _gather(kind: str, parts: tuple[Formula, ...], unit: bool) -> Formula:
    out: set = set()
    for f in parts:
        if f is (not unit):
            return not unit
        if f is unit:
            continue
        out |= f[1] if f[0] == kind else {f}
    if any(negate(f) in out for f in out):
        return not unit
    return unit if not out else next(iter(out)) if len(out) == 1 else (kind, frozenset(out))


def both(*parts: Formula) -> Formula:
    return _gather("and", parts, True)


def either(*parts: Formula) -> Formula:
    return _gather("or", parts, False)


def implies(a: Formula, b: Formula) -> Formula:
    return either(negate(a), b)


def equal(a: Formula, b: Formula) -> Formula:
    return either(both(a, b), both(negate(a), negate(b)))


def parse(text: str) -> Formula:
    """Names, ! & | => = and brackets; = binds loosest, then =>, |, &."""
    import re

    tokens = [*re.findall(r"\w+|=>|[!&|=()]", text), ""]
    at = 0

    def take(t: str) -> bool:
        nonlocal at
        if tokens[at] == t:
            at += 1
            return True
        return False

    def level(k: int) -> Formula:
        nonlocal at
        if k == 4:
            if take("!"):
                return negate(level(4))
            if take("("):
                f = level(0)
                if not take(")"):
                    raise ValueError(f"a bracket isn't closed in {text!r}")
                return f
            at += 1
            name = tokens[at - 1]
            if not name[:1].isalnum() and name[:1] != "_":
                raise ValueError(f"a name is missing in {text!r}")
            return {"true": True, "false": False}.get(name, atom(name))
        f = level(k + 1)
        while take(("=", "=>", "|", "&")[k]):
            f = (equal, implies, either, both)[k](f, level(k if k == 1 else k + 1))
        return f

    f = level(0)
    if tokens[at]:
        raise ValueError(f"{tokens[at]!r} is left over in {text!r}")
    return f


def assign(f: Formula, name: str, value: bool) -> Formula:
    if isinstance(f, bool):
        return f
    if f[0] == "atom":
        return value if f[1] == name else f
    if f[0] == "not":
        return negate(assign(f[1], name, value))
    return (both if f[0] == "and" else either)(*(assign(x, name, value) for x in f[1]))


def first_atom(f: tuple) -> str:
    if f[0] == "atom":
        return f[1]
    return first_atom(f[1]) if f[0] == "not" else min(first_atom(x) for x in f[1])


def forced(f: tuple) -> tuple[str, bool] | None:
    """An atom that must have a value: the formula itself, or a part of a conjunction."""
    for x in sorted(f[1], key=str) if f[0] == "and" else (f,):
        if x[0] == "atom":
            return x[1], True
        if x[0] == "not" and x[1][0] == "atom":
            return x[1][1], False
    return None


@dataclass
class Answer:
    status: str
    model: dict[str, bool] | None
    steps: int


def solve(f: Formula, limit: int = MAX_STEPS) -> Answer:
    """Satisfiable with a model, Unsatisfiable, or TimedOut beyond the limit of assignments."""
    stack, steps = [(f, {})], 0
    while stack:
        g, model = stack.pop()
        while not isinstance(g, bool):
            steps += 1
            if steps > limit:
                return Answer("TimedOut", None, steps)
            known = forced(g)
            name, value = known or (first_atom(g), True)
            if not known:
                stack.append((assign(g, name, False), model | {name: False}))
            g, model = assign(g, name, value), model | {name: value}
        if g:
            return Answer("Satisfiable", model, steps)
    return Answer("Unsatisfiable", None, steps)


def proves(condition: Formula, f: Formula, limit: int = MAX_STEPS) -> bool:
    return solve(both(condition, negate(f)), limit).status == "Unsatisfiable"


def allows(condition: Formula, f: Formula, limit: int = MAX_STEPS) -> bool:
    return solve(both(condition, f), limit).status == "Satisfiable"


def in_models(f: Formula) -> Formula:
    """The same formula as the alternatives that satisfy it, each a branch of the solver, so that its size depends on its atoms and not on how it came about."""
    found, stack = [], [(f, ())]
    while stack:
        g, way = stack.pop()
        if isinstance(g, bool):
            if g:
                found.append(both(*way))
            continue
        name = first_atom(g)
        stack += [(assign(g, name, value), (*way, atom(name) if value else negate(atom(name)))) for value in (False, True)]
    return either(*found)


class FlowCondition:
    """What holds on the ways to a place: forked for branches, constrained by them, joined where they meet."""

    def __init__(self, formula: Formula = True) -> None:
        self.formula = formula

    def fork(self) -> FlowCondition:
        return FlowCondition(self.formula)

    def constrain(self, f: Formula) -> FlowCondition:
        return FlowCondition(both(self.formula, f))

    def join(self, other: FlowCondition) -> FlowCondition:
        return FlowCondition(either(self.formula, other.formula))

    def proves(self, f: Formula) -> bool:
        return proves(self.formula, f)

    def allows(self, f: Formula) -> bool:
        return allows(self.formula, f)
