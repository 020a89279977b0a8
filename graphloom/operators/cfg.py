"""Questions about control-flow graphs, one kernel per function over its facts (see plans.derive.cfg_facts)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.functions import boolean as bl
from graphloom.functions import dataflow as df
from graphloom.functions import digraph as dg
from graphloom.plans.fixpoint import per_function


class Function:
    """One function: its graph, entry and exit, events by block, and what kind of block each is."""

    def __init__(self, facts: pd.DataFrame) -> None:
        rows = list(zip(facts.kind, facts.a.astype(int), facts.b.astype(int), facts.x, strict=True))
        self.kind = {a: x for k, a, _, x in rows if k == "b"}
        self.n = len(self.kind)
        self.g = dg.graph(sorted(self.kind), [(a, b) for k, a, b, _ in rows if k == "e"])
        self.entry, self.exit = 1, self.n
        self.events: dict[int, list[tuple[str, bool]]] = {}
        for k, a, b, _ in rows:
            if k in ("u", "d"):
                self.events.setdefault(a, []).append((b, k == "d"))
        self.viewed = {a: b for k, a, b, _ in rows if k == "c"}
        self.vars = sorted({v for es in self.events.values() for v, _ in es})
        self.bit = {v: 1 << k for k, v in enumerate(self.vars)}

    def dominators(self) -> dict:
        return dg.dominators(dg.immediate_dominators(self.g, self.entry), self.entry)

    def post(self) -> tuple[dict, dict, object]:
        r, end = dg.with_virtual_exit(self.g, [self.exit])
        idom = dg.immediate_dominators(r, end)
        return idom, dg.dominators(idom, end), end

    def gen_kill(self) -> dict[int, tuple[int, int]]:
        return {b: df.gen_kill(self.events.get(b, []), self.bit) for b in self.g}

    def names(self, state: int) -> list:
        return [v for v in self.vars if state & self.bit[v]]


def each(facts: DataFrame, f: Callable[[Function], list[tuple]], schema: str) -> DataFrame:
    return per_function(facts, lambda fn, pdf: [(fn, *r) for r in f(Function(pdf))], f"fn long, {schema}")


def within_budget(f: Callable[[Function], list[tuple]], status: tuple) -> Callable[[Function], list[tuple]]:
    """What f gives; for a function that takes more visits than the budget, one row of status, at block 0 and variable -1, which no function has."""

    def of(function: Function) -> list[tuple]:
        try:
            return f(function)
        except df.TooManyVisits:
            return [(0, -1, *status)]

    return of


MAX_VISITS = "error:max-visits"


def dom_pairs(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: [(d, b) for b, ds in f.dominators().items() for d in ds], "dom long, b long")


def idom(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: [(b, d) for b, d in dg.immediate_dominators(f.g, f.entry).items()], "b long, idom long")


def pdom_pairs(facts: DataFrame) -> DataFrame:
    def of(f: Function) -> list[tuple]:
        _, dom, end = f.post()
        return [(d, b) for b, ds in dom.items() if b != end for d in ds if d != end]

    return each(facts, of, "pdom long, b long")


def ipdom(facts: DataFrame) -> DataFrame:
    """0 for the virtual exit."""

    def of(f: Function) -> list[tuple]:
        tree, _, end = f.post()
        return [(b, 0 if d == end else d) for b, d in tree.items()]

    return each(facts, of, "b long, ipdom long")


def reachable(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: [(b, k) for b, k in dg.levels(f.g, [f.entry]).items()], "b long, level long")


def reach_pairs(facts: DataFrame) -> DataFrame:
    """A chain of one edge or more."""

    def of(f: Function) -> list[tuple]:
        return [(a, b) for a in f.g for b in dg.levels(f.g, f.g[a])]

    return each(facts, of, "a long, b long")


def scc(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: [(b, c[0], dg.cyclic(f.g, c)) for c in dg.components(f.g) for b in c], "b long, label long, cyclic boolean")


def dominance_back_edges(facts: DataFrame) -> DataFrame:
    def of(f: Function) -> list[tuple]:
        dom = f.dominators()
        return [(a, b) for a in dom for b in f.g[a] if b in dom[a]]

    return each(facts, of, "s long, d long")


def loop_bodies(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: [(h, b) for h, body in dg.natural_loops(f.g, f.dominators()).items() for b in body], "header long, b long")


def loop_depths(facts: DataFrame) -> DataFrame:
    def of(f: Function) -> list[tuple]:
        loops = dg.natural_loops(f.g, f.dominators())
        return [(h, sum(h in body for body in loops.values())) for h in loops]

    return each(facts, of, "header long, depth long")


def reducible(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: [(dg.weak_order(f.g, f.entry) is not None,)], "reducible boolean")


def retreating_not_back(facts: DataFrame) -> DataFrame:
    """Witnesses of irreducibility: edges into an open block that doesn't dominate them."""

    def of(f: Function) -> list[tuple]:
        dom = f.dominators()
        return [(a, b) for a, b in dg.depth_first(f.g, [f.entry])[2] if b not in dom[a]]

    return each(facts, of, "s long, d long")


def frontier(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: [(a, n) for a, ns in dg.frontier(f.g, f.dominators()).items() for n in ns], "b long, frontier long")


def phi_blocks(facts: DataFrame) -> DataFrame:
    """Where definitions of a variable meet: the iterated frontier of the blocks that define it."""

    def of(f: Function) -> list[tuple]:
        df_ = dg.frontier(f.g, f.dominators())
        return [(v, b) for v in f.vars for b in dg.iterated_frontier(df_, [b for b, es in f.events.items() if (v, True) in es])]

    return each(facts, of, "v long, b long")


def control_dependence(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: sorted(dg.control_dependence(f.g, f.post()[1])), "b long, branch long")


def backward_slice(facts: DataFrame, criterion: int | None = None) -> DataFrame:
    """(kind, id): variables and blocks that a criterion block depends on, by data (any definition that can reach it) and by control."""

    def of(f: Function) -> list[tuple]:
        target = criterion or f.exit
        can = set(dg.levels(dg.reverse(f.g), [target]))
        depends: dict = {}
        for b, d in dg.control_dependence(f.g, f.post()[1]):
            depends.setdefault(b, set()).add(d)
        blocks, variables, work = set(), set(), [target]
        while work:
            b = work.pop()
            if b in blocks:
                continue
            blocks.add(b)
            work += [d for d in depends.get(b, ()) if d in can]
            new = {v for v, is_def in f.events.get(b, []) if not is_def} - variables
            variables |= new
            work += [d for d, es in f.events.items() if d in can and any(is_def and v in new for v, is_def in es)]
        return [("block", b) for b in blocks] + [("var", v) for v in variables]

    return each(facts, of, "kind string, id long")


def orders(facts: DataFrame) -> DataFrame:
    """Positions of each reached block in pre-order, post-order, reverse post-order, that with last children first, and inverse post-order (over predecessors, from the exit; -1 if not reached)."""

    def of(f: Function) -> list[tuple]:
        pre, post, _ = dg.depth_first(f.g, [f.entry])
        body_first = dg.reverse_post_order(f.g, [f.entry], lambda s: s[::-1])
        inverse = dg.depth_first(dg.reverse(f.g), [f.exit])[1]
        at = [{b: k for k, b in enumerate(o)} for o in (pre, post, post[::-1], body_first, inverse)]
        return [(b, *(o.get(b, -1) for o in at)) for b in pre]

    return each(facts, of, "b long, pre long, po long, rpo long, rpo_body_first long, inverse_po long")


def weak_orders(facts: DataFrame) -> DataFrame:
    def of(f: Function) -> list[tuple]:
        order = dg.weak_order(f.g, f.entry)
        return [(b, k) for k, b in enumerate(dg.flat(order))] if order else []

    return each(facts, of, "b long, rank long")


def dfs_back_edges(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: dg.depth_first(f.g, [f.entry])[2], "s long, d long")


def gen_kill(facts: DataFrame) -> DataFrame:
    return each(facts, lambda f: [(b, v, bool(u & f.bit[v]), bool(d & f.bit[v])) for b, (u, d) in f.gen_kill().items() for v in f.names(u | d)], "b long, v long, gen boolean, kill boolean")


def liveness(facts: DataFrame, strategy: str = "po", side: str = "in") -> DataFrame:
    """Variables live at a block's beginning or end."""

    def of(f: Function) -> list[tuple]:
        gk = f.gen_kill()
        at_end, at_start, _ = df.solve(f.g, f.entry, {b: u for b, (u, _) in gk.items()}, {b: d for b, (_, d) in gk.items()}, forward=False, strategy=strategy)
        return [(b, v) for b, state in (at_start if side == "in" else at_end).items() for v in f.names(state)]

    return each(facts, of, "b long, v long")


def maybe_uninit(facts: DataFrame, strategy: str = "rpo", uses: bool = False) -> DataFrame:
    """Variables that some way from the entry reaches a block (or, with uses, a use) without a definition."""

    def of(f: Function) -> list[tuple]:
        gk = f.gen_kill()
        every = sum(f.bit.values())
        before, _, _ = df.solve(f.g, f.entry, {}, {b: d for b, (_, d) in gk.items()}, forward=True, boundary=every, strategy=strategy)
        live = dg.levels(f.g, [f.entry])
        return [(b, v) for b, state in before.items() if b in live for v in f.names(state & gk[b][0] if uses else state)]

    return each(facts, of, "b long, v long")


def may_assigned(facts: DataFrame) -> DataFrame:
    def of(f: Function) -> list[tuple]:
        gk = f.gen_kill()
        before, _, _ = df.solve(f.g, f.entry, {b: d for b, (_, d) in gk.items()}, {}, forward=True)
        return [(b, v) for b, state in before.items() for v in f.names(state)]

    return each(facts, of, "b long, v long")


def uninit_kinds(facts: DataFrame) -> DataFrame:
    """Of each use that may be uninitialised, whether it always is: no definition reaches it on any way."""

    def of(f: Function) -> list[tuple]:
        gk = f.gen_kill()
        defs = {b: d for b, (_, d) in gk.items()}
        may, _, _ = df.solve(f.g, f.entry, {}, defs, forward=True, boundary=sum(f.bit.values()))
        assigned, _, _ = df.solve(f.g, f.entry, defs, {}, forward=True)
        live = dg.levels(f.g, [f.entry])
        return [(b, v, "sometimes" if assigned[b] & f.bit[v] else "always") for b in live for v in f.names(may[b] & gk[b][0])]

    return each(facts, of, "b long, v long, kind string")


def dead_stores(facts: DataFrame) -> DataFrame:
    """Definitions whose variable isn't live behind them."""

    def of(f: Function) -> list[tuple]:
        gk = f.gen_kill()
        at_end, _, _ = df.solve(f.g, f.entry, {b: u for b, (u, _) in gk.items()}, {b: d for b, (_, d) in gk.items()}, forward=False, strategy="po")
        out = []
        for b, es in f.events.items():
            live = at_end[b]
            for v, is_def in reversed(es):
                if is_def:
                    if not live & f.bit[v]:
                        out.append((b, v))
                    live &= ~f.bit[v]
                else:
                    live |= f.bit[v]
        return out

    return each(facts, of, "b long, v long")


def solver_costs(facts: DataFrame) -> DataFrame:
    """Visits of each strategy for liveness and uninitialised variables, and whether all reach one fixpoint. -1: no weak order."""

    def of(f: Function) -> list[tuple]:
        gk = f.gen_kill()
        use, define = {b: u for b, (u, _) in gk.items()}, {b: d for b, (_, d) in gk.items()}
        out = []
        for problem, forward, gen, boundary in (("liveness", False, use, 0), ("uninit", True, {}, sum(f.bit.values()))):
            found = []
            for s in df.STRATEGIES:
                try:
                    entry, _, visits = df.solve(f.g, f.entry, gen, define, forward, boundary, s)
                    found.append((s, visits, entry))
                except ValueError:
                    found.append((s, -1, None))
            first = next(e for _, _, e in found if e is not None)
            out += [(problem, s, n, e is None or e == first) for s, n, e in found]
        return out

    return each(facts, of, "problem string, strategy string, visits long, same boolean")


def instructions(f: Function) -> dict[int, list[tuple]]:
    """A small program over the function's variables, by name: signup sets its variable to the block's number, click adds one, purchase subtracts two, error multiplies."""
    out: dict[int, list[tuple]] = {}
    for b, es in f.events.items():
        op = {"signup": ("=", b, None), "click": ("+", None, 1), "purchase": ("-", None, 2)}.get(f.kind[b], ("*", None, 2))
        out[b] = [(str(v), op[0], op[1] if op[1] is not None else str(v), op[2]) for v, _ in es]
    return out


def constants(facts: DataFrame) -> DataFrame:
    """What each variable holds at a block's beginning, if it is one number on all ways. Kind error:max-visits: the budget of visits was not enough."""

    def of(f: Function) -> list[tuple]:
        code = instructions(f)
        before, _, _ = df.fixpoint(f.g, f.entry, {}, lambda b, s: df.run_constants(s, code.get(b, [])), df.join_constants)
        return [(b, int(v), "const" if x != df.TOP else "top", x if x != df.TOP else 0) for b, s in before.items() for v, x in s.items() if x is not None]

    return each(facts, within_budget(of, (MAX_VISITS, 0)), "b long, v long, kind string, value long")


def intervals(facts: DataFrame) -> DataFrame:
    """Bounds of each variable at a block's beginning, widened at loops; a null bound is infinite. Status is ok, or error:max-visits where the budget of visits was not enough."""

    def of(f: Function) -> list[tuple]:
        code = instructions(f)
        join = lambda a, b: df.ANY if a is None or b is None else a.join(b)
        widen = lambda a, b: b if a is None else a.widen(b)
        before, _, cost = df.fixpoint(f.g, f.entry, {}, lambda b, s: df.run_intervals(s, code.get(b, [])), join, widen)
        return [(b, int(v), None if x.lo is None else float(x.lo), None if x.hi is None else float(x.hi), cost.widens, "ok") for b, s in before.items() for v, x in s.items()]

    return each(facts, within_budget(of, (None, None, 0, MAX_VISITS)), "b long, v long, lo double, hi double, widens long, status string")


def refined(facts: DataFrame) -> DataFrame:
    """Bounds as intervals gives them, with what branches say: a view of variable v in block b skips where v < b and goes on where not; a way on which that can't hold is none."""

    def of(f: Function) -> list[tuple]:
        code, seen = instructions(f), f.viewed
        join = lambda a, b: df.ANY if a is None or b is None else a.join(b)
        widen = lambda a, b: b if a is None else a.widen(b)

        def on_edge(state: dict, a: int, b: int) -> dict | None:
            if a not in seen or len(f.g[a]) < 2:
                return state
            op = "<" if b != a + 1 else df.NEGATED["<"]
            name = str(seen[a])
            left = state.get(name, df.ANY).meet(op, a)
            return None if left.empty else state | {name: left}

        before, _, cost = df.fixpoint(f.g, f.entry, {}, lambda b, s: df.run_intervals(s, code.get(b, [])), join, widen, on_edge)
        return [(b, int(v), None if x.lo is None else float(x.lo), None if x.hi is None else float(x.hi), cost.joins, cost.widens, "ok") for b, s in before.items() for v, x in s.items()]

    return each(facts, within_budget(of, (None, None, 0, 0, MAX_VISITS)), "b long, v long, lo double, hi double, joins long, widens long, status string")


def element_states(facts: DataFrame) -> DataFrame:
    """(fn, b, when, v, kind, value): what each variable holds before and after the element of each block that sets one."""

    def of(f: Function) -> list[tuple]:
        code, out = instructions(f), []
        before, behind, _ = df.fixpoint(f.g, f.entry, {}, lambda b, s: df.run_constants(s, code.get(b, [])), df.join_constants, max_visits=None)
        for b in code:
            for when, states in (("before", before), ("after", behind)):
                out += [(b, when, int(v), "const" if x != df.TOP else "top", x if x != df.TOP else 0) for v, x in states.get(b, {}).items() if x is not None]
        return out

    return each(facts, of, "b long, when string, v long, kind string, value long")


def flow_conditions(facts: DataFrame, names: int = 4) -> DataFrame:
    """(fn, b, verdict): of each branch, what the conditions on the ways to it say of its own, by solving formulas: ALWAYS TRUE, ALWAYS FALSE, unknown, or BOTH PROVEN where no way leads. A view of variable v tests atom v modulo names and skips if it holds; ways run forwards."""

    def of(f: Function) -> list[tuple]:
        fc, out = {b: False for b in f.g}, []
        fc[f.entry] = True
        for b in sorted(f.g):
            test = bl.atom(f"x{f.viewed[b] % names}") if b in f.viewed else None
            if test is not None:
                yes, no = bl.proves(fc[b], test), bl.proves(fc[b], bl.negate(test))
                out.append((b, "BOTH PROVEN" if yes and no else "ALWAYS TRUE" if yes else "ALWAYS FALSE" if no else "unknown"))
            for s in f.g[b]:
                if s > b:
                    way = fc[b] if test is None or len([x for x in f.g[b] if x > b]) < 2 else bl.both(fc[b], test if s != b + 1 else bl.negate(test))
                    fc[s] = bl.in_models(bl.either(fc[s], way))
        return out

    return each(facts, of, "b long, verdict string")


def taint(facts: DataFrame) -> DataFrame:
    """Variables set by signup are tainted, purchase cleans them; what a block that clicks may see of each. Verdict error:max-visits: the budget of visits was not enough."""

    def of(f: Function) -> list[tuple]:
        def step(b: int, s: dict) -> dict:
            for v, _ in f.events.get(b, []):
                if f.kind[b] in ("signup", "purchase"):
                    s[v] = "tainted" if f.kind[b] == "signup" else "clean"
            return s

        join = lambda a, b: (a or "clean") if (a or "clean") == (b or "clean") else "maybe"
        before, _, _ = df.fixpoint(f.g, f.entry, {}, step, join)
        return [(b, v, before[b].get(v, "clean")) for b in before if f.kind[b] == "click" for v, _ in f.events.get(b, [])]

    return each(facts, within_budget(of, (MAX_VISITS,)), "b long, v long, verdict string")


def shape(facts: DataFrame) -> DataFrame:
    """Blocks, edges, cyclomatic number, loops by dominance, back edges of a depth-first search, and the budget of visits that follows."""

    def of(f: Function) -> list[tuple]:
        edges = sum(map(len, f.g.values()))
        loops = dg.natural_loops(f.g, f.dominators())
        back = dg.depth_first(f.g, [f.entry])[2]
        return [(f.n, edges, edges - f.n + 2, len(loops), len(back), max(1, 150 * f.n * (1 + len(loops)) // 100))]

    return each(facts, of, "blocks long, edges long, cyclomatic long, loops long, back_edges long, budget long")
