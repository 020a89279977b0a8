"""Solvers against path-wise definitions, all strategies against one another, and lattices against a small interpreter."""

import random

import pytest

from graphloom.functions import boolean as bl
from graphloom.functions import dataflow as df
from graphloom.functions import digraph as dg


def random_function(seed):
    r = random.Random(seed)
    n = r.randint(2, 9)
    edges = {(k, k + 1) for k in range(1, n)} | {(r.randint(1, n), r.randint(1, n)) for _ in range(r.randint(0, 5))}
    events = {b: [(r.choice("xyz"), r.random() < 0.5) for _ in range(r.randint(0, 3))] for b in range(1, n + 1)}
    return dg.graph(range(1, n + 1), sorted(edges)), events


@pytest.mark.parametrize("seed", range(40))
def test_strategies_and_definitions(seed):
    g, events = random_function(seed)
    bit = {"x": 1, "y": 2, "z": 4}
    gk = {b: df.gen_kill(events[b], bit) for b in g}
    use, define = {b: u for b, (u, _) in gk.items()}, {b: d for b, (_, d) in gk.items()}
    found = []
    for s in df.STRATEGIES:
        try:
            found.append((df.solve(g, 1, use, define, False, 0, s)[:2], df.solve(g, 1, {}, define, True, 7, s)[:2]))
        except ValueError:
            assert s == "wto" and dg.weak_order(g, 1) is None
    assert all(f == found[0] for f in found)
    (_, live), (uninit, _) = found[0]
    for b in g:  # live: a use is reached with no definition before it
        for v, m in bit.items():
            seen, work, hit = set(), [b], False
            while work:
                c = work.pop()
                if c in seen:
                    continue
                seen.add(c)
                hit |= bool(use[c] & m)
                if not use[c] & m and not define[c] & m:
                    work += g[c]
            assert hit == bool(live[b] & m)
    reach, work = set(), [(1, m) for m in bit.values()]
    while work:
        b, m = work.pop()
        if (b, m) not in reach:
            reach.add((b, m))
            if not define[b] & m:
                work += [(c, m) for c in g[b]]
    live_blocks = dg.levels(g, [1])
    assert all(bool(uninit[b] & m) == ((b, m) in reach) for b in live_blocks for m in bit.values())


def test_budget():
    g = dg.graph([1, 2], [(1, 2), (2, 1)])
    with pytest.raises(df.TooManyVisits):
        df.solve(g, 1, {1: 1}, {}, False, max_visits=1)


@pytest.mark.parametrize("seed", range(30))
def test_lattices_hold_what_runs_do(seed):
    """Whatever a run of the program finds lies in the constants and intervals of the block."""
    r = random.Random(seed)
    g, _ = random_function(seed)
    code = {b: [(r.choice("xy"), r.choice(["=", "+", "-"]), r.choice([r.randint(0, 3), "x", "y"]), r.randint(0, 2)) for _ in range(r.randint(0, 2))] for b in g}
    code[1] = [("x", "=", 1, None), ("y", "=", 2, None)]
    consts, _, _ = df.fixpoint(g, 1, {}, lambda b, s: df.run_constants(s, code[b]), lambda a, b: df.join_constants(a, b) if a is not None and b is not None else df.TOP)
    bounds, _, _ = df.fixpoint(g, 1, {}, lambda b, s: df.run_intervals(s, code[b]), lambda a, b: df.ANY if a is None or b is None else a.join(b), lambda a, b: b if a is None else a.widen(b))
    for _ in range(30):
        b, s = 1, {}
        for _ in range(25):
            for v, x in s.items():
                assert consts[b].get(v, df.TOP) in (df.TOP, x)
                i = bounds[b].get(v, df.ANY)
                assert (i.lo is None or i.lo <= x) and (i.hi is None or x <= i.hi)
            for t, op, p, q in code[b]:
                x, y = (v if isinstance(v, int) or v is None else s.get(v, 0) for v in (p, q))
                s[t] = x if op == "=" else x + y if op == "+" else x - y
            if not g[b]:
                break
            b = r.choice(g[b])


def test_widening_ends():
    g = dg.graph([1, 2, 3], [(1, 2), (2, 2), (2, 3)])
    code = {1: [("i", "=", 0, None)], 2: [("i", "+", "i", 1)], 3: []}
    bounds, _, cost = df.fixpoint(g, 1, {}, lambda b, s: df.run_intervals(s, code[b]), lambda a, b: df.ANY if a is None or b is None else a.join(b), lambda a, b: b if a is None else a.widen(b))
    assert bounds[2]["i"] == df.Interval(0, None) and bounds[3]["i"] == df.Interval(1, None) and cost.widens
    assert df.Interval(0, 9).meet(">", 9).empty and df.Interval(0, 9).meet("<", 5) == df.Interval(0, 4)


@pytest.mark.parametrize("seed", range(60))
def test_boolean_by_truth_table(seed):
    r = random.Random(seed)

    def text(d):
        return r.choice("abcd") if not d else r.choice(["!({0})", "({0}) & ({1})", "({0}) | ({1})", "({0}) => ({1})", "({0}) = ({1})"]).format(text(d - 1), text(d - 1))

    t = text(3)
    f = bl.parse(t)
    py = t.replace("=>", "<=").replace("!", " not ").replace("&", " and ").replace("|", " or ")
    py = py.replace(" = ", " == ")
    table = []
    for k in range(16):
        env = {n: bool(k >> i & 1) for i, n in enumerate("abcd")}
        g = f
        for n, v in env.items():
            g = bl.assign(g, n, v)
        assert g is eval(py, {}, env)
        table.append(g)
    answer = bl.solve(f)
    assert answer.status == ("Satisfiable" if any(table) else "Unsatisfiable")
    assert bl.proves(True, f) == all(table) and bl.allows(True, f) == any(table)


def test_boolean_rules_and_limit():
    p, q = bl.atom("p"), bl.atom("q")
    assert bl.both(p, q) == bl.both(q, p) and bl.either(p, p) == p and bl.negate(bl.negate(p)) == p
    assert bl.both(p, True) == p and bl.both(p, False) is False and bl.both(p, bl.negate(p)) is False
    pigeons = bl.both(*(bl.either(*(bl.atom(f"{i}in{j}") for j in range(4))) for i in range(5)), *(bl.either(bl.negate(bl.atom(f"{a}in{j}")), bl.negate(bl.atom(f"{b}in{j}"))) for j in range(4) for a in range(5) for b in range(a)))
    assert bl.solve(pigeons, 10).status == "TimedOut" and bl.solve(pigeons, 100_000).status == "Unsatisfiable"
    assert not bl.proves(pigeons, p, 10) and not bl.allows(pigeons, p, 10)
