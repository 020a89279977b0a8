"""Kernels against their definitions, on small graphs with known answers and on random ones."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions import digraph as dg

GRAPHS = st.integers(1, 8).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=20, unique=True)))


def reaches(g, a, without=None):
    seen, work = {a}, [a]
    while work:
        for b in g[work.pop()]:
            if b != without and b not in seen:
                seen.add(b)
                work.append(b)
    return seen


@settings(max_examples=150, deadline=None)
@given(GRAPHS)
def test_definitions(case):
    n, edges = case
    g = dg.graph(range(n), edges)
    parts = dg.components(g)
    of = {m: k for k, c in enumerate(parts) for m in c}
    for a, b in itertools.product(g, g):
        assert (of[a] == of[b]) == (b in reaches(g, a) and a in reaches(g, b))
    for a, b in edges:
        assert of[b] <= of[a]  # callees first
    live = reaches(g, 0)
    dom = dg.dominators(dg.immediate_dominators(g, 0), 0)
    assert set(dom) == live
    for b in live:
        assert dom[b] == {a for a in live if a == b or a == 0 or b not in reaches(g, 0, a)}
    order = dg.reverse_post_order(g, [0])
    assert set(order) == live and order[0] == 0
    pre, post, back = dg.depth_first(g, list(g))
    assert sorted(pre) == sorted(post) == list(range(n))
    rest = dg.graph(g, [e for e in edges if e not in set(back)])
    assert not any(dg.cyclic(rest, c) for c in dg.components(rest))
    level = dg.levels(g, [0])
    assert set(level) == live and all(level[b] <= level[a] + 1 for a in live for b in g[a])
    for head, body in dg.natural_loops(g, dom).items():
        assert head in body and all(head in dom[b] for b in body)
    weak = dg.weak_order(g, 0)
    irreducible = any(b not in dom[a] for a, b in dg.depth_first(g, [0])[2])
    assert (weak is None) == irreducible
    if weak is not None:
        assert sorted(dg.flat(weak)) == sorted(live)


def test_heights_and_cycles():
    g = dg.graph([], [("main", "a"), ("a", "b"), ("b", "a"), ("main", "c"), ("c", "d"), ("e", "a"), ("f", "f")])
    assert dg.heights(g) == {"main": 2, "a": None, "b": None, "c": 1, "d": 0, "e": 1, "f": None}
    assert dg.shortest_chain(g, "a", lambda x: x == "a") == ["a", "b", "a"]
    assert dg.shortest_chain(g, "d", lambda x: x == "a") is None


def test_known_shapes():
    calls = [("load", "parse"), ("parse", "term"), ("term", "factor"), ("factor", "parse"), ("parse", "report"), ("report", "report"), ("load", "store"), ("store", "flush"), ("flush", "store"), ("flush", "sync")]
    g = dg.graph([], calls)
    assert [c for c in sorted(dg.components(g)) if dg.cyclic(g, c)] == [["factor", "parse", "term"], ["flush", "store"], ["report"]]
    diamond = dg.graph(range(1, 5), [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert dg.immediate_dominators(diamond, 1) == {2: 1, 3: 1, 4: 1}
    dom = dg.dominators(dg.immediate_dominators(diamond, 1), 1)
    assert dg.frontier(diamond, dom) == {2: {4}, 3: {4}}
    r, end = dg.with_virtual_exit(diamond, [4])
    post = dg.dominators(dg.immediate_dominators(r, end), end)
    assert dg.control_dependence(diamond, post) == {(2, 1), (3, 1)}
    two_entries = dg.graph(range(4), [(0, 1), (0, 2), (1, 2), (2, 1), (1, 3)])
    assert dg.weak_order(two_entries, 0) is None
    nested = dg.graph(range(6), [(0, 1), (1, 2), (2, 3), (3, 2), (3, 4), (4, 1), (4, 5)])
    assert dg.weak_order(nested, 0) == [0, [1, [2, 3], 4], 5]
    deep = dg.graph(range(50_000), [(k, k + 1) for k in range(49_999)])
    assert len(dg.components(deep)) == 50_000 and dg.heights(deep)[0] == 49_999
