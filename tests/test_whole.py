"""Queries answer for whole tables, and hold against plain Python where they have no SQL."""

import pandas as pd
import pytest
from conftest import DATA

from graphloom import registry
from graphloom.functions import dataflow as df
from graphloom.operators import callgraph as cg
from graphloom.operators import cfg, checkers, interproc_queries, views
from graphloom.operators import interproc as ip
from graphloom.plans import derive as dv

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", ["rpo_order", "wto", "dfs_back_edges", "retreating_not_back", "solver_visits", "const_prop", "interval_widen", "interval_refine", "element_states", "analysis_log", "taint_clicks", "cfg_shape", "live_in", "idom"])
def test_all_users(spark, name):
    users = {r.user_id for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}
    assert len(users) == 15 and {r.fn for r in registry.queries()[name](spark, SF).select("fn").distinct().collect()} == users


def test_no_oracle_restricts_its_table(spark):
    """Derived graphs hold every row of their tables."""
    sql = registry.oracle_sql()
    assert not [n for n, q in sql.items() if "user_id %" in q or "l_quantity >= 4" in q and n.startswith(("cg_", "metric", "scc", "cfg"))]
    assert dv.call_sites(spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert dv.blocks(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_all_calls(spark):
    """Orders, back edges and sinks of the graph of all rows, against plain Python."""
    li = spark.read.parquet(f"{SF}/lineitem.parquet").collect()

    def callee(r):
        o, p = r.l_orderkey, r.l_partkey
        return -1 if o % 40 == 39 else o - o % 40 + p % 40 if r.l_tax == 0 and r.l_discount == 0 else min(o + 1 + p % 7, o - o % 40 + 39)

    calls = sorted((r.l_orderkey, callee(r), r.l_partkey, r.l_linenumber) for r in li)
    assert len(calls) == dv.call_sites(spark, SF).count() == 6000
    known = {x for a, b, *_ in calls for x in (a, b)} | {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    g = {f: [] for f in sorted(known)}
    for a, b, *_ in calls:
        if b not in g[a]:
            g[a].append(b)
    pre, post, back, open_ = [], [], set(), set()

    def visit(f):
        pre.append(f)
        open_.add(f)
        for b in g[f]:
            if b in open_:
                back.add((f, b))
            elif b not in pre:
                visit(b)
        open_.discard(f)
        post.append(f)

    for f in g:
        if f not in pre:
            visit(f)
    q = registry.queries()
    assert {tuple(r) for r in q["cg_orders"](spark, SF).collect()} == {(f, pre.index(f), post.index(f), len(post) - 1 - post.index(f)) for f in g}
    assert {tuple(r) for r in q["cg_back_edges"](spark, SF).collect()} == back


def test_more_sinks_than_ten_thousand(spark):
    """Each sink has one caller; all of them count, with none brought to the driver."""
    n = 12_000
    nodes = spark.range(17 * n).where("id % 17 < 7 AND id % 17 > 4").withColumnRenamed("id", "fn")
    edges = nodes.where("fn % 17 = 6").selectExpr("fn AS src", "fn - 1 AS dst")
    sinks = interproc_queries.sinks(nodes)
    assert sinks.count() == n
    body = edges.selectExpr("src AS fn", "1L AS block", "dst")
    flow = body.selectExpr("fn", "0L AS a", "1L AS b").unionByName(body.selectExpr("fn", "1L AS a", "2L AS b"))
    assert ip.sink_levels(ip.sink_rounds(nodes, body, flow, sinks)).groupBy("level").count().collect() == [("always", 2 * n)]
    for small in (True, False):
        assert sorted(tuple(r) for r in cg.reach(nodes, edges, sinks, backwards=True, small=small).groupBy("level").count().collect()) == [(0, n), (1, n)]


def test_functions_of_more_blocks_than_the_budget(monkeypatch):
    """A chain of 20,500 blocks that sets its variable first, gives it up in the middle and uses it last."""
    n = 20_500
    kinds = {1: "signup", n // 2: "purchase", n: "click"}
    facts = [("b", b, n, kinds.get(b, "view")) for b in range(1, n + 1)] + [("e", b, b + 1, "") for b in range(1, n)] + [("d", 1, 0, ""), ("u", n // 2, 0, ""), ("u", n, 0, "")]
    f = cfg.Function(pd.DataFrame(facts, columns=["kind", "a", "b", "x"]))
    for module in (cfg, checkers):
        monkeypatch.setattr(module, "each", lambda facts, of, schema: of(facts))
    assert sorted(cfg.liveness(f)) == [(b, 0) for b in range(2, n + 1)]
    assert len(cfg.liveness(f, side="out")) == n - 1 and cfg.maybe_uninit(f) == [(1, 0)] and cfg.maybe_uninit(f, uses=True) == []
    assert len(cfg.may_assigned(f)) == n - 1 and cfg.uninit_kinds(f) == [] and cfg.dead_stores(f) == []
    assert checkers.moves(f) == [(n, 0, "certain")] and checkers.locks(f) == [(n, 0, "use unlocked")]
    assert checkers.called_once(f) == [(0, False, True, False, "once")]
    assert cfg.constants(f) == [(0, -1, "error:max-visits", 0)]
    assert cfg.intervals(f) == [(0, -1, None, None, 0, "error:max-visits")]
    assert cfg.taint(f) == [(0, -1, "error:max-visits")]


def counting(limit, refine, widening):
    """i = 0; while (i < limit) i = i + 1; return i — as blocks 1 to 4; a limit of None never ends by itself."""
    g = {1: [2], 2: [3, 4], 3: [2], 4: []}
    code = {1: [("i", "=", 0, None)], 3: [("i", "+", "i", 1)]}
    join = lambda a, b: df.ANY if a is None or b is None else a.join(b)
    widen = (lambda a, b: b if a is None else a.widen(b)) if widening else None

    def on_edge(s, a, b):
        if not refine or a != 2 or limit is None:
            return s
        left = s["i"].meet("<" if b == 3 else df.NEGATED["<"], limit)
        return None if left.empty else s | {"i": left}

    before, _, cost = df.fixpoint(g, 1, {}, lambda b, s: df.run_intervals(s, code.get(b, [])), join, widen, on_edge, max_visits=200)
    return before[4]["i"], cost.widens


def test_loops_that_count():
    """Refined alone: exactly the limit. Refined and widened: the limit or more. Widened alone: any from 0. Neither: more visits than allowed."""
    assert counting(10, True, False) == (df.Interval(10, 10), 0)
    assert counting(10, True, True)[0] == df.Interval(10, None)
    assert counting(None, False, True)[0] == df.Interval(0, None)
    with pytest.raises(df.TooManyVisits):
        counting(None, False, False)
    assert df.Interval(0, 10).widen(df.Interval(2, 10)) == df.Interval(0, 10) and df.Interval(0, 10).widen(df.Interval(0, 11)) == df.Interval(0, None)


def runs(f, steps=400):
    """What variables hold at each block on one run that takes the first way its branch allows; those never set hold 3."""
    b, state, code = f.entry, dict.fromkeys(map(str, f.vars), 3), cfg.instructions(f)
    for _ in range(steps):
        yield b, dict(state)
        for v, op, x, _y in code.get(b, []):
            state[v] = x if op == "=" else {"+": state[v] + 1, "-": state[v] - 2}[op]
        if not f.g[b]:
            return
        ways = f.g[b]
        if b in f.viewed and len(ways) > 1:
            holds = state.get(str(f.viewed[b]), 3) < b
            ways = [s for s in ways if (s != b + 1) == holds]
        b = ways[0]


def test_bounds_hold_what_runs_do(spark):
    """Every value that a run shows lies in the bounds, refined or not, for variables that the function sets itself."""
    facts = dv.cfg_facts(spark, SF).toPandas()
    bounds = {}
    for name, rows in (("plain", cfg.intervals(dv.cfg_facts(spark, SF))), ("refined", cfg.refined(dv.cfg_facts(spark, SF)))):
        bounds[name] = {(r.fn, r.b, r.v): (r.lo, r.hi) for r in rows.collect()}
    seen = 0
    for fn, own in facts.groupby("fn"):
        for b, state in runs(cfg.Function(own.sort_values(["kind", "a", "b"]))):
            for v, x in state.items():
                for which in bounds.values():
                    if (fn, b, int(v)) in which:
                        lo, hi = which[(fn, b, int(v))]
                        assert (lo is None or x >= lo) and (hi is None or x <= hi), (fn, b, v, x, lo, hi)
                        seen += 1
    assert seen > 500


def test_pairs_are_split_outside_brackets():
    assert [views.split_outside(t) for t in ("a,b", "f<a,b>,g(c,d)", "x", "f(a,(b,c)),y,z", ",")] == [("a", "b"), ("f<a,b>", "g(c,d)"), ("x", None), ("f(a,(b,c))", "y,z"), ("", "")]
