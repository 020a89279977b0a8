"""Kernels and rounds of joins give the same; formats round trip; documents that lack something are refused."""

import itertools
import json
import os
import random

import pyarrow as pa
import pytest

from graphloom.functions import digraph as dg
from graphloom.operators import callgraph as cg
from graphloom.operators import interproc as ip
from graphloom.plans import fixpoint as fx
from graphloom.sources import formats as fm
from graphloom.streaming import windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    edges = fm.synthetic_calls(spark, 40, 1, seed=3).union(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 5), (5, 6)], "src long, dst long")).where("src < 30")
    return spark.range(40).withColumnRenamed("id", "fn"), fx.written(edges.distinct())


def test_kernels_and_loops_agree(small):
    nodes, edges = small
    for f in (lambda s: cg.reach(nodes, edges, [0, 7], small=s), lambda s: cg.closure(nodes, edges, small=s), lambda s: cg.components(nodes, edges, small=s)):
        assert rows(f(True)) == rows(f(False))
    def named(df):
        return sorted((r.fn, -1 if r.height is None else r.height) for r in df.collect())

    assert named(cg.heights(nodes, edges, small=True)) == named(cg.heights(nodes, edges, small=False))


def test_call_strings(spark):
    sites = spark.createDataFrame([(0, 1, 1, 0), (0, 2, 2, 1), (1, 3, 3, 2), (2, 3, 4, 2), (3, 3, 5, 2)], "src long, dst long, line long, col long")
    nodes, entries = spark.range(4).withColumnRenamed("id", "fn"), spark.createDataFrame([(0,)], "fn long")
    none = {(r.fn, tuple(r.string)): r.value for r in ip.contexts(nodes, sites, entries, 0).collect()}
    assert none == {(0, ()): 3, (1, ()): 1, (2, ()): 2, (3, ()): 3}
    two = {(r.fn, tuple(r.string)): r.value for r in ip.contexts(nodes, sites, entries, 2).collect()}
    assert two[(3, ("0:1:0", "1:3:2"))] == 1 and two[(3, ("0:2:1", "2:4:2"))] == 2 and two[(3, ("3:5:2", "3:5:2"))] == 3
    with pytest.raises(ip.TooManyContexts):
        ip.contexts(nodes, sites, entries, 2, limit=3)


def test_sinks_by_control_flow(spark):
    """Kernel, rounds and plain Python agree. Function 6 has a loop, and a way to its exit beside the sink; 7 calls sinks on both arms."""
    calls = [(2, 1, 1), (3, 1, 0), (3, 2, 1), (4, 1, 2), (5, 1, 5), (6, 1, 1), (7, 1, 1), (7, 2, 2), (8, 1, 7)]
    flow = [(2, 0, 1), (2, 1, 2), (3, 0, 1), (3, 1, 2), (3, 1, 3), (3, 2, 3), (4, 0, 1), (4, 1, 2), (5, 0, 1), (5, 1, 2), (6, 0, 0), (6, 0, 1), (6, 0, 2), (6, 1, 2), (7, 0, 1), (7, 0, 2), (7, 1, 3), (7, 2, 3), (8, 0, 1), (8, 1, 2)]
    nodes = spark.range(9).withColumnRenamed("id", "fn")
    c, f, sinks = spark.createDataFrame(calls, "fn long, block long, dst long"), spark.createDataFrame(flow, "fn long, a long, b long"), spark.createDataFrame([(1,)], "fn long")
    want = {0: (None, None), 1: (0, 0), 2: (1, 1), 3: (1, None), 4: (2, 2), 5: (None, None), 6: (1, None), 7: (1, 2), 8: (2, 3)}
    for small in (True, False):
        got = ip.sink_rounds(nodes, c, f, sinks, small)
        assert {r.fn: (r.may, r.always) for r in got.collect()} == want
    assert {(r.fn, r.level, r.iter) for r in ip.sink_levels(got).collect()} >= {(0, "none", 0), (3, "may", 1), (7, "always", 2)}
    assert rows(ip.sink_trace(got).where("fn = 7")) == [(7, 1, "may"), (7, 2, "always")]
    chains = ip.sink_chains(c.selectExpr("fn AS src", "dst"), got.where("may IS NOT NULL").selectExpr("fn", "may AS level"))
    assert {r.fn: r.chain for r in chains.collect()} == {1: "1", 2: "2>1", 3: "3>1", 4: "4>2>1", 6: "6>1", 7: "7>1", 8: "8>7>1"}


def test_cycles_in_rounds(small):
    nodes, edges = small
    assert rows(cg.cycle_chains(nodes, edges, small=True)) == rows(cg.cycle_chains(nodes, edges, small=False)) != []


def test_the_boundary_between_kernel_and_rounds(small, monkeypatch):
    """At the limit of edges and one beyond it, the same rows."""
    nodes, edges = small
    n = edges.count()
    found = []
    for limit in (n, n - 1):
        monkeypatch.setattr(fx, "WHOLE", limit)
        assert fx.is_small(edges) == (limit == n)
        found.append(rows(cg.components(nodes, edges)) + rows(cg.reach(nodes, edges, [0])))
    assert found[0] == found[1]


def test_numbers_without_one_task(spark):
    table = spark.range(1000).selectExpr("id % 7 AS k", "id * 37 % 1000 AS v", "id")
    for keys in ([], ["k"]):
        got = {r.id: r.n for r in fx.numbered(table, ["v", "id"], "n", keys).collect()}
        seen, want = {}, {}
        for k, _, i in sorted(((r.k if keys else 0, r.v, r.id) for r in table.collect())):
            seen[k] = want[i] = seen.get(k, 0) + 1
        assert got == want


def test_precedence_and_inlining(spark):
    sites = spark.createDataFrame([(1,), (2,), (3,)], "site long")
    a, b = spark.createDataFrame([(1, "x")], "site long, target string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "w")], "site long, target string")
    assert sorted((r.site, r.rule, r.target or "") for r in ip.resolved(sites, [("a", a), ("b", b)]).collect()) == [(1, "a", "x"), (2, "b", "w"), (2, "b", "z"), (3, "unresolved", "")]
    calls = spark.createDataFrame([(0, 1, True), (1, 0, True), (1, 2, True), (2, 3, True), (0, 9, True), (0, 2, False)], "src long, dst long, fits boolean")
    got = ip.inlined(calls, spark.createDataFrame([(0,)], "fn long"), spark.range(4).withColumnRenamed("id", "fn"), 2)
    assert {(r.path, r.verdict) for r in got.collect()} == {("0>1", "inlined"), ("0>9", "no body"), ("0>2", "arguments"), ("0>1>0", "recursion"), ("0>1>2", "inlined"), ("0>1>2>3", "depth")}


def test_merge_refuses(spark, tmp_path):
    good = {"tus": ["a"], "nodes": [{"name": "f", "key": "k", "kind": "def"}], "edges": [{"from": "f", "to": "f", "line": 1, "col": 2, "file": "x"}]}
    cases = {"no tus, nodes or edges": {"tus": ["a"]}, "several units": good | {"tus": ["a", "b"]}, "lacks name": good | {"nodes": [{"name": "f", "kind": "def"}]}, "unknown node": good | {"edges": [{"from": "f", "to": "g", "line": 1, "col": 1}]}}
    for k, (why, doc) in enumerate(cases.items()):
        p = tmp_path / f"{k}.json"
        p.write_text(json.dumps(doc))
        with pytest.raises(fm.BadDocument, match=why):
            fm.read_merge_json(spark, str(p))
    p = tmp_path / "good.json"
    p.write_text(json.dumps(good))
    nodes, edges = fm.read_merge_json(spark, str(p))
    assert [(r.tu, r.key) for r in nodes.collect()] == [("a", "k")] and edges.first().path == "x"


def test_texts(spark):
    dump = " [B3 (ENTRY)]\n   Succs (1): B2\n\n [B2]\n   1: x\n   2: x > 0\n   T: if [B2.2]\n   Preds (1): B3\n   Succs (2): B1 B0\n\n [B1]\n   1: y\n   Preds (1): B2\n   Succs (1): B0\n\n [B0 (EXIT)]\n   Preds (2): B1 B2\n"
    texts = spark.createDataFrame([("f", dump)], "file string, text string")
    got = {r.block: (r.note, r.elements, r.terminator, r.preds, r.succs) for r in fm.read_block_dump(texts).collect()}
    assert got == {3: ("ENTRY", 0, None, None, [2]), 2: (None, 2, "if [B2.2]", [3], [1, 0]), 1: (None, 1, None, [2], [0]), 0: ("EXIT", 0, None, [1, 2], None)}
    calls = spark.createDataFrame([("f", "Function: main calls: operator new f\nFunction: operator new calls:\nFunction: f calls: f")], "file string, text string")
    assert rows(fm.read_call_dump(calls)) == [("f", "f", "f"), ("f", "main", "f"), ("f", "main", "operator new")]
    marks = spark.createDataFrame([("f", "int a; // expect: certain\n// expect: none\nb(); // known-fp: possible\nc(); // other")], "file string, text string")
    assert rows(fm.read_markers(marks)) == [("f", 1, "expect", "certain"), ("f", 3, "known-fp", "possible")]
    odd = spark.createDataFrame([("g", 'say "x"', "edge"), ("g", "plain", "a\\b\nc"), ("g", "plain", "a\\b\nc")], "graph string, src string, dst string")
    assert rows(fm.read_dot(fm.dot_documents(odd))) == [("g", "plain", "a\\b\nc", 2), ("g", 'say "x"', "edge", 1)]
    assert rows(fm.read_pairs(spark.createDataFrame([("f", "(4,5) (3,4)")], "file string, text string"))) == [("f", 3, 4), ("f", 4, 5)]


def test_stream_ends_where_it_began(spark, tmp_path):
    from conftest import DATA

    table = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    got = windows.drained(windows.windowed_kinds(windows.arriving(spark, f"{DATA}/sf0.001/events.parquet*")), f"file://{tmp_path}")
    assert rows(got) == rows(windows.windowed_kinds(table))


def test_stream_drops_what_is_too_late(spark, tmp_path):
    """Files come one by one: a row within the two hours still counts, one that comes after its window is closed doesn't."""
    row = lambda k, ts: (k, ts, 1, "click", 1.0, "{}")
    files = [[row(1, "2024-01-01 00:10:00")], [row(2, "2024-01-01 01:30:00"), row(3, "2024-01-01 00:50:00")], [row(4, "2024-01-01 09:00:00")], [row(7, "2024-01-01 09:10:00")], [row(5, "2024-01-01 00:20:00")], [row(6, "2024-01-01 08:30:00")]]
    for k, f in enumerate(files):
        spark.createDataFrame(f, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for p in (tmp_path / "in" / str(k)).glob("part-*"):
            os.makedirs(tmp_path / "all", exist_ok=True)
            os.rename(p, tmp_path / "all" / f"{k}.parquet")
            os.utime(tmp_path / "all" / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    got = windows.drained(windows.windowed_kinds(windows.arriving(spark, f"{tmp_path}/all", files=1)), f"file://{tmp_path}/out")
    assert {(r.start.hour, r.n) for r in got.collect()} == {(0, 2), (1, 1), (9, 2), (8, 1)}


def test_names(spark):
    nodes = spark.createDataFrame([(1, "f", "int", 1), (2, "f", "int", 2), (3, "f", "char", 1), (4, "g", "", 1), (5, "h", "a", 1), (6, "h", "a", 1)], "fn long, base string, signature string, line long")
    assert {r.fn: r.name for r in ip.unique_names(nodes).collect()} == {1: "f(int)@L1", 2: "f(int)@L2", 3: "f(char)", 4: "g", 5: "h(a)@L1#1", 6: "h(a)@L1#2"}


def test_pieces(spark, monkeypatch):
    """A graph of more edges than one task takes falls into pieces of random numbers, which lead to leaves that they share; one of them is too large again. All answers are those of one kernel, and no rounds are taken where all pieces fit."""
    rng = random.Random(7)
    ids = rng.sample(range(1000), 400)
    sizes, edges, at = [60, *[10] * 29], set(), 0
    leaves = [*ids[350:380], -3]
    for size in sizes:
        own = ids[at : at + size] if at + size <= 350 else []
        at += size
        edges |= {(a, rng.choice(own)) for a in own for _ in range(rng.choice([0, 1, 2]))} | {(rng.choice(own), rng.choice(leaves)) for _ in own[::3]}
    nodes = spark.createDataFrame([(n,) for n in [*ids, -3]], "fn long")
    e = fx.written(spark.createDataFrame(sorted(edges), "src long, dst long"))
    some = spark.createDataFrame([(n,) for n in [*ids[::9], *leaves[::4], -3]], "fn long")
    calls = e.selectExpr("src AS fn", "row_number() OVER (PARTITION BY src ORDER BY dst) + 0L AS block", "dst")
    last = calls.groupBy("fn").agg({"block": "max"}).toDF("fn", "n")
    flow = calls.join(last, "fn").selectExpr("fn", "block - 1 AS a", "explode(array(block, if(block % 3 = 0, n + 1, block), if(block = n, n + 1, block))) AS b").distinct().where("b > a")
    flow = fx.written(flow.unionByName(last.selectExpr("fn", "n AS a", "n + 1 AS b")).distinct())
    asked = {
        "components": lambda s: cg.components(nodes, e, s),
        "heights": lambda s: cg.heights(nodes, e, s),
        "endless": lambda s: cg.endless(nodes, e, s),
        "cycles": lambda s: cg.cycle_chains(nodes, e, s),
        "metrics": lambda s: cg.metrics(nodes, e, some, s),
        "orders": lambda s: cg.orders(nodes, e, s),
        "back edges": lambda s: cg.back_edges(nodes, e, s),
        "sinks": lambda s: ip.sink_rounds(nodes, calls, flow, some, s),
    }
    plain = lambda df: sorted(map(repr, df.collect()))
    want = {name: plain(f(True)) for name, f in asked.items()}
    assert all(want.values()) and len(want["orders"]) == 401
    levels, labels = fx.levels, fx.scc_labels
    taken = []
    monkeypatch.setattr(fx, "scc_labels", lambda *a: taken.append("scc") or labels(*a))
    monkeypatch.setattr(fx, "levels", lambda *a: taken.append("levels") or levels(*a))
    for most, share in ((150, 100), (50, 150)):  # all pieces fit (those of sinks have more edges); one doesn't
        monkeypatch.setattr(fx, "WHOLE", most)
        monkeypatch.setattr(fx, "SHARE", share)
        for name, f in asked.items():
            if (most == 150) == (name == "sinks") and name not in ("components", "orders", "back edges"):
                continue
            assert plain(f(None)) == want[name], (name, most)
        assert bool(taken) == (most == 50)


def parted(nodes, edges):
    g = dg.graph(sorted({*nodes, *itertools.chain(*edges)}), sorted(set(edges)))
    return sorted((m, c[0], len(c), dg.cyclic(g, c)) for c in dg.components(g) for m in c)


def units(seed, n=60, size=10):
    """Calls within units of near ids, repeated at times, to one function outside and to leaves that no unit holds; functions that nothing names."""
    rng = random.Random(seed)
    edges = [(size * u + rng.randrange(size - 2), size * u + rng.randrange(size)) for u in range(n) for _ in range(2 * size)] + [(size * u + rng.randrange(size), -1) for u in range(n)]
    return [*range(n * size, n * size + 20)], edges + edges[::3] + [(x, 10**15 + x) for x in range(0, n * size, 7)]


@pytest.mark.parametrize("more", [[], [(3, 405), (405, 3), (123, 456), (590, 11)]])
def test_components_by_ranges(spark, monkeypatch, more):
    """F16: edges may repeat and nodes needn't name their ends; only pieces that ranges cut, or that call across them, are dealt out again."""
    lone, edges = units(5)
    edges = edges + more
    monkeypatch.setattr(fx, "WHOLE", 400)
    monkeypatch.setattr(fx, "SHARE", 100)
    again, solved = [], fx.solved
    monkeypatch.setattr(fx, "solved", lambda ns, *a: again.append(ns.count()) or solved(ns, *a))
    got = cg.components(spark.createDataFrame([(x,) for x in lone], "fn long"), spark.createDataFrame(edges, "src long, dst long"))
    assert rows(got) == parted(lone, edges)
    assert sum(again) < 150 and (again or not more)


def test_components_leave_large_pieces_to_rounds(spark, monkeypatch):
    """F16: a piece of too many edges inside one range, and its leaves."""
    circle = [(x, (x + k) % 30) for x in range(30) for k in range(1, 20)] + [(x, 1000 + x % 9) for x in range(30)]
    edges = circle + [(x, x + 1) for x in range(400, 500, 2)]
    taken, labels = [], fx.scc_labels
    monkeypatch.setattr(fx, "scc_labels", lambda *a: taken.append(1) or labels(*a))
    monkeypatch.setattr(fx, "WHOLE", 500)
    got = cg.components(spark.createDataFrame([], "fn long"), spark.createDataFrame(edges, "src long, dst long"))
    assert rows(got) == parted([], edges) and taken


def test_range_kernel(monkeypatch):
    """F16: batch by batch, told apart in between, or all at once; random graphs against the plain kernel, ids up to the ends of 64 bits."""
    rng = random.Random(2)
    for most in (3, 1000):
        monkeypatch.setattr(fx, "WHOLE", most)
        for n in (1, 5, 30):
            ids = [-(2**63), 2**63 - 1, *(rng.randrange(-(2**63), 2**63) for _ in range(n))]
            edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(2 * n)]
            both = [*edges, *((x, None) for x in ids)]
            batch = lambda part: pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], ["src", "dst"])
            out = pa.Table.from_batches(fx.settled_range(iter([batch(both[k : k + 4]) for k in range(0, len(both), 4)]), 1000)).to_pylist()
            assert sorted((r["fn"], r["label"], r["size"], r["cyclic"]) for r in out) == parted(ids, edges) and {r["kind"] for r in out} == {0}
    assert list(fx.settled_range(iter([]), 9)) == []


def test_weak_labels(spark, monkeypatch):
    """In turns, when one task can't hold the edges: a path in random order, a star and a circle."""
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 300)
    edges = list(itertools.pairwise(ids[:150])) + [(ids[150], x) for x in ids[151:200]] + list(zip(ids[200:], [*ids[201:], ids[200]], strict=True))
    monkeypatch.setattr(fx, "WHOLE", 40)
    got = {r.fn: r.piece for r in fx.weak_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(ids) and [len({got[x] for x in part}) for part in (ids[:150], ids[150:200], ids[200:])] == [1, 1, 1] and len(set(got.values())) == 3


def test_pointers_of_one_type_need_no_distinct(spark):
    """Repeated sites, sites of several types, repeated functions and nulls: each pair once; pairs are never gathered to be told apart where sites have one type."""
    sites = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (3, None), (4, 9)], "site long, fn_type long")
    taken = spark.createDataFrame([(7, 1), (7, 1), (7, 2), (8, 2), (9, None)], "target long, fn_type long")
    got = ip.resolve_pointers(sites, taken)
    assert rows(got) == [(1, 7), (2, 7), (2, 8)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Aggregate [site#") - plan.count("collect_set") == 1
