"""Queries over the derived call graph and control-flow graphs, each with SQL of an independent formulation where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import callgraph as cg
from graphloom.operators import cfg
from graphloom.plans import derive as dv
from graphloom.registry import query

G = "WITH RECURSIVE " + dv.CG + ", "
CLOSURE = "c AS (SELECT src, dst FROM p UNION SELECT c.src, p.dst FROM c JOIN p ON c.dst = p.src)"
SCC = CLOSURE + ", s AS (SELECT fn, least(fn, coalesce(min(m.dst), fn)) AS label FROM nodes LEFT JOIN (SELECT a.src, a.dst FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src) m ON m.src = fn GROUP BY fn), loops AS (SELECT DISTINCT src AS fn FROM c WHERE src = dst)"
# Ways from a unit leave it only to the one function outside, so none that repeats nothing is longer than a unit and one.
BFS = "l AS (SELECT fn, 0::BIGINT AS level FROM nodes WHERE {roots} UNION SELECT {to}, level + 1 FROM l JOIN p ON p.{of} = l.fn WHERE level < " + str(dv.UNIT + 1) + "), lv AS (SELECT fn, min(level) AS level FROM l GROUP BY fn)"
FORWARD, ENTRIES = {"to": "dst", "of": "src"}, {"roots": dv.ENTRY}
HEIGHT = "h AS (SELECT fn, 0 AS d FROM nodes UNION SELECT p.src, CASE WHEN h.fn IN (SELECT fn FROM loops) THEN 1 ELSE d + 1 END FROM h JOIN p ON p.dst = h.fn WHERE p.src NOT IN (SELECT fn FROM loops))"


def graph(spark, d):
    return dv.call_nodes(spark, d), dv.call_pairs(spark, d)


def entries(nodes):
    return nodes.where(dv.ENTRY)


@query("cg_edges_scan", G + "x AS (SELECT 1) SELECT src, dst, line, col FROM cg")
def _(spark, d):
    return dv.call_sites(spark, d)


@query("cg_pairs_distinct", G + "x AS (SELECT 1) SELECT * FROM p")
def _(spark, d):
    return dv.call_pairs(spark, d)


@query("cg_parallel_fold", "WITH " + dv.CG + " SELECT src, dst, count(*) AS n_sites, string_agg(line || ':' || col, ',' ORDER BY line, col) AS sites FROM cg GROUP BY src, dst")
def _(spark, d):
    return cg.fold(dv.call_sites(spark, d))


DEGREE = "dg AS (SELECT fn, (SELECT count(*) FROM p WHERE dst = fn) AS in_deg, (SELECT count(*) FROM p WHERE src = fn) AS out_deg, (SELECT count(*) FROM cg WHERE src = fn) AS sites, (SELECT count(*) FROM p WHERE dst = fn AND src <> fn) AS other_callers FROM nodes)"


@query("metric_degree", G + DEGREE + " SELECT * FROM dg")
def _(spark, d):
    return cg.degrees(dv.call_nodes(spark, d), dv.call_sites(spark, d))


METRIC = G + SCC + ", " + HEIGHT + ", " + BFS.format(**ENTRIES, **FORWARD) + ", " + DEGREE + ", m AS (SELECT dg.fn, in_deg, out_deg, sites, CASE WHEN dg.fn NOT IN (SELECT fn FROM loops) THEN (SELECT max(d) FROM h WHERE h.fn = dg.fn) END::BIGINT AS height, out_deg = 0 AS leaf, other_callers = 0 AS root, dg.fn IN (SELECT fn FROM loops) AS recursive, dg.fn NOT IN (SELECT fn FROM lv) AS dead FROM dg) "


def inf():
    return F.coalesce(F.col("height").cast("string"), F.lit("inf"))


def metrics(spark, d):
    n = dv.call_nodes(spark, d)
    return cg.metrics(n, dv.call_sites(spark, d), entries(n))


@query("metric_flags", METRIC + "SELECT m.* REPLACE (coalesce(height::VARCHAR, 'inf') AS height), label FROM m JOIN s USING (fn)")
def _(spark, d):
    return metrics(spark, d).withColumn("height", inf())


@query("metric_totals", METRIC + "SELECT count(*) AS functions, (SELECT count(*) FROM p) AS edges, (SELECT count(*) FROM cg) AS sites, (SELECT count(DISTINCT label) FROM s) AS sccs, (SELECT count(DISTINCT label) FROM s WHERE fn IN (SELECT fn FROM loops)) AS cyclic, count(*) FILTER (dead) AS dead, count(*) FILTER (leaf) AS leaves, count(*) FILTER (root) AS roots, CASE WHEN bool_or(recursive) THEN 'inf' ELSE max(height)::VARCHAR END AS height FROM m")
def _(spark, d):
    m = metrics(spark, d)
    count = lambda c: F.count(F.when(c, 1))
    return m.agg(F.count(F.lit(1)).alias("functions"), F.sum("out_deg").alias("edges"), F.sum("sites").alias("sites"), F.countDistinct("label").alias("sccs"), F.countDistinct(F.when(F.col("recursive"), F.col("label"))).alias("cyclic"), count(F.col("dead")).alias("dead"), count(F.col("leaf")).alias("leaves"), count(F.col("root")).alias("roots"), F.when(F.max(F.col("recursive").cast("int")) == 1, "inf").otherwise(F.max("height").cast("string")).alias("height"))


@query("metric_topk_in", G + DEGREE + " SELECT fn, in_deg FROM dg ORDER BY in_deg DESC, fn LIMIT 10")
def _(spark, d):
    return cg.degrees(dv.call_nodes(spark, d), dv.call_sites(spark, d)).select("fn", "in_deg").orderBy(F.desc("in_deg"), "fn").limit(10)


@query("metric_topk_height", METRIC + "SELECT fn, coalesce(height::VARCHAR, 'inf') AS height FROM m ORDER BY m.height DESC NULLS FIRST, fn LIMIT 5")
def _(spark, d):
    return cg.heights(*graph(spark, d)).orderBy(F.desc_nulls_first("height"), "fn").limit(5).withColumn("height", inf())


@query("bfs_level", G + BFS.format(**ENTRIES, **FORWARD) + " SELECT * FROM lv")
def _(spark, d):
    n, p = graph(spark, d)
    return cg.reach(n, p, entries(n))


@query("bfs_level_reverse", G + BFS.format(roots="fn = -1", to="src", of="dst") + " SELECT * FROM lv")
def _(spark, d):
    return cg.reach(*graph(spark, d), [dv.EXTERNAL], backwards=True)


@query("reach_from", G + "r AS (SELECT fn FROM nodes WHERE fn IN (0, 3) UNION SELECT dst FROM r JOIN p ON src = fn) SELECT * FROM r")
def _(spark, d):
    return cg.reach(*graph(spark, d), [0, 3]).select("fn")


@query("callers_direct", G + "x AS (SELECT 1) SELECT dst AS fn, src AS caller FROM p")
def _(spark, d):
    return dv.call_pairs(spark, d).select(F.col("dst").alias("fn"), F.col("src").alias("caller"))


@query("callees_distinct", G + "x AS (SELECT 1) SELECT src AS fn, count(*) AS callees, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS names FROM p GROUP BY src")
def _(spark, d):
    return dv.call_pairs(spark, d).groupBy(F.col("src").alias("fn")).agg(F.count(F.lit(1)).alias("callees"), F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("names"))


@query("callers_transitive", G + CLOSURE + " SELECT dst AS fn, src AS caller FROM c")
def _(spark, d):
    return cg.closure(*graph(spark, d)).select(F.col("dst").alias("fn"), F.col("src").alias("caller"))


@query("closure_pairs", G + CLOSURE + " SELECT * FROM c")
def _(spark, d):
    return cg.closure(*graph(spark, d))


@query("cycle_members", G + CLOSURE + " SELECT DISTINCT src AS fn FROM c WHERE src = dst")
def _(spark, d):
    return cg.components(*graph(spark, d)).where("cyclic").select("fn")


@query("roots_all", G + "x AS (SELECT 1) SELECT fn FROM nodes WHERE NOT EXISTS (SELECT 1 FROM p WHERE dst = fn AND src <> fn)")
def _(spark, d):
    n, p = graph(spark, d)
    return n.join(p.where("src <> dst").select(F.col("dst").alias("fn")), "fn", "left_anti")


@query("dead_from_roots", G + BFS.format(**ENTRIES, **FORWARD) + " SELECT fn FROM nodes WHERE fn NOT IN (SELECT fn FROM lv)")
def _(spark, d):
    n, p = graph(spark, d)
    return n.join(cg.reach(n, p, entries(n)).select("fn"), "fn", "left_anti")


@query("scc_label", G + SCC + " SELECT * FROM s")
def _(spark, d):
    return cg.components(*graph(spark, d)).select("fn", "label")


@query("scc_members", G + SCC + " SELECT label, count(*) AS size, string_agg(fn::VARCHAR, ',' ORDER BY fn) AS members FROM s GROUP BY label")
def _(spark, d):
    return cg.components(*graph(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("fn")), lambda x: x.cast("string")), ",").alias("members"))


@query("scc_cyclic", G + SCC + " SELECT label, count(*) AS size, bool_or(EXISTS (SELECT 1 FROM p WHERE src = s.fn AND dst = s.fn)) AS self FROM s WHERE fn IN (SELECT fn FROM loops) GROUP BY label")
def _(spark, d):
    n, p = graph(spark, d)
    own = p.where("src = dst").select(F.col("src").alias("fn"), F.lit(True).alias("own"))
    return cg.components(n, p).where("cyclic").join(own, "fn", "left").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.bool_or("own"), F.lit(False)).alias("self"))


EXTRA = "WITH RECURSIVE " + dv.CG.replace("p AS (SELECT DISTINCT src, dst FROM cg)", "p AS (SELECT src, dst FROM cg UNION SELECT src, greatest(src - src % 40, src - 7) FROM cg WHERE src % 7 = 0)") + ", "


@query("scc_plus_extra", EXTRA + SCC + " SELECT * FROM s")
def _(spark, d):
    """Every seventh function may also call back, which is known from elsewhere."""
    src, dst = F.col("src"), F.col("dst")
    back = F.greatest(src - src % 40, src - 7)
    both = F.when(src % 7 == 0, F.array(dst, back)).otherwise(F.array(dst))
    return cg.components(dv.functions(spark, d), dv.call_sites(spark, d).select("src", F.explode(both).alias("dst"))).select("fn", "label")


@query("height_condensation", METRIC + "SELECT fn, coalesce(height::VARCHAR, 'inf') AS height FROM m")
def _(spark, d):
    return cg.heights(*graph(spark, d)).withColumn("height", inf())


@query("shortest_path_len", G + BFS.format(roots="fn = 0", **FORWARD) + " SELECT 0::BIGINT AS src, fn AS dst, level AS len FROM lv WHERE level > 0")
def _(spark, d):
    return cg.reach(*graph(spark, d), [0]).where("level > 0").select(F.lit(0).cast("long").alias("src"), F.col("fn").alias("dst"), F.col("level").alias("len"))


@query("shortest_cycle_len", G + SCC + ", heads AS (SELECT DISTINCT label FROM s WHERE fn IN (SELECT fn FROM loops)), w AS (SELECT label, label AS fn, 0::BIGINT AS len FROM heads UNION SELECT w.label, p.dst, len + 1 FROM w JOIN p ON p.src = w.fn JOIN s ON s.fn = p.dst AND s.label = w.label WHERE len <= (SELECT count(*) FROM s x WHERE x.label = w.label)) SELECT label, min(len) AS len FROM w WHERE fn = label AND len > 0 GROUP BY label")
def _(spark, d):
    return cg.shortest_cycles(*graph(spark, d))


PATHS = G + "w AS (SELECT 0::BIGINT AS z, [0::BIGINT] AS path UNION ALL SELECT p.dst, list_append(path, p.dst) FROM w JOIN p ON p.src = w.z WHERE NOT list_contains(path, p.dst) AND len(path) <= 8 AND w.z <> {to}), f AS (SELECT (len(path) - 1)::BIGINT AS len, array_to_string(path, '>') AS path FROM w WHERE z = {to} AND len(path) > 1)"


@query("simple_paths_bounded", PATHS.format(to=16) + " SELECT * FROM f")
def _(spark, d):
    return cg.simple_paths(dv.call_pairs(spark, d), 0, 16, 8)


@query("simple_paths_topk", PATHS.format(to=16) + " SELECT len, path, (SELECT count(*) FROM f) AS total FROM f ORDER BY len, path LIMIT 5")
def _(spark, d):
    found = cg.simple_paths(dv.call_pairs(spark, d), 0, 16, 8)
    return found.orderBy("len", "path").limit(5).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


@query("cg_orders")
def _(spark, d):
    return cg.orders(dv.call_nodes(spark, d), dv.call_sites(spark, d))


@query("cg_back_edges")
def _(spark, d):
    return cg.back_edges(dv.call_nodes(spark, d), dv.call_sites(spark, d))


@query("cg_back_edges_invariant", "SELECT 0::BIGINT AS violations")
def _(spark, d):
    """Without its back edges the graph has no cycle (an invariant, not a comparison of results)."""
    n, p = graph(spark, d)
    rest = p.join(cg.back_edges(n, dv.call_sites(spark, d)), ["src", "dst"], "left_anti")
    return cg.components(n, rest).agg(F.count(F.when(F.col("cyclic"), 1)).alias("violations"))


# Control-flow graphs. i: skips and back jumps; r: back jumps only.
I, R = "WITH RECURSIVE " + dv.CFG_I + ", ", "WITH RECURSIVE " + dv.CFG_R + ", "
REACH = "r AS (SELECT fn, 1::BIGINT AS b, 0::BIGINT AS level FROM blk WHERE b = 1 UNION SELECT e.fn, e.d, level + 1 FROM r JOIN e ON e.fn = r.fn AND e.s = r.b WHERE level < (SELECT max(n) FROM blk))"
AVOID = "av AS (SELECT x.fn, x.b AS x, 1::BIGINT AS b FROM blk x WHERE x.b <> 1 UNION SELECT av.fn, av.x, e.d FROM av JOIN e ON e.fn = av.fn AND e.s = av.b WHERE e.d <> av.x), dom AS (SELECT x.fn, x.b AS dom, y.b FROM blk x JOIN blk y USING (fn) WHERE x.b = 1 OR NOT EXISTS (SELECT 1 FROM av WHERE av.fn = x.fn AND av.x = x.b AND av.b = y.b))"
PAVOID = "pv AS (SELECT x.fn, x.b AS x, x.n AS b FROM blk x WHERE x.b <> x.n UNION SELECT pv.fn, pv.x, e.s FROM pv JOIN e ON e.fn = pv.fn AND e.d = pv.b WHERE e.s <> pv.x), pdom AS (SELECT x.fn, x.b AS pdom, y.b FROM blk x JOIN blk y USING (fn) WHERE x.b = x.n OR NOT EXISTS (SELECT 1 FROM pv WHERE pv.fn = x.fn AND pv.x = x.b AND pv.b = y.b))"
LOOP = AVOID + ", be AS (SELECT e.fn, e.s, e.d FROM e JOIN dom ON dom.fn = e.fn AND dom.b = e.s AND dom.dom = e.d), body AS (SELECT fn, d AS header, s AS b FROM be UNION SELECT fn, d, d FROM be UNION SELECT body.fn, header, e.s FROM body JOIN e ON e.fn = body.fn AND e.d = body.b WHERE body.b <> header)"
USES = "u AS (SELECT fn, b, v FROM blk WHERE et IN ('click', 'purchase') AND v IS NOT NULL), df AS (SELECT fn, b, v FROM blk WHERE et = 'signup' AND v IS NOT NULL), vars AS (SELECT DISTINCT fn, v FROM (SELECT * FROM u UNION ALL SELECT * FROM df))"
LIVE = USES + ", live AS (SELECT fn, b, v FROM u UNION SELECT live.fn, e.s, live.v FROM live JOIN e ON e.fn = live.fn AND e.d = live.b WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.fn = e.fn AND df.b = e.s AND df.v = live.v))"
UNINIT = USES + ", un AS (SELECT fn, 1::BIGINT AS b, v FROM vars UNION SELECT un.fn, e.d, un.v FROM un JOIN e ON e.fn = un.fn AND e.s = un.b WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.fn = un.fn AND df.b = un.b AND df.v = un.v))"
ASSIGNED = "asg AS (SELECT df.fn, e.d AS b, df.v FROM df JOIN e ON e.fn = df.fn AND e.s = df.b UNION SELECT asg.fn, e.d, asg.v FROM asg JOIN e ON e.fn = asg.fn AND e.s = asg.b)"
DF = AVOID + ", fr AS (SELECT DISTINCT p.fn, p.dom AS b, e.d AS frontier FROM dom p JOIN e ON e.fn = p.fn AND e.s = p.b WHERE p.dom = e.d OR NOT EXISTS (SELECT 1 FROM dom q WHERE q.fn = p.fn AND q.dom = p.dom AND q.b = e.d))"
CD = PAVOID + ", cd AS (SELECT DISTINCT e.fn, q.pdom AS b, e.s AS branch FROM e JOIN pdom q ON q.fn = e.fn AND q.b = e.d WHERE q.pdom = e.s OR NOT EXISTS (SELECT 1 FROM pdom z WHERE z.fn = e.fn AND z.pdom = q.pdom AND z.b = e.s))"


def facts(spark, d, variant="i"):
    return dv.cfg_facts(spark, d, variant)


def kernel(name, f, sql=None, variant="i"):
    query(name, sql)(lambda spark, d: f(facts(spark, d, variant)))


@query("cfg_edges", I + "x AS (SELECT 1) SELECT * FROM e")
def _(spark, d):
    return dv.cfg_edges(dv.blocks(spark, d))


@query("cfg_edge_roles", I + "x AS (SELECT 1) SELECT fn, s, d, CASE WHEN d = s + 1 THEN 'next' WHEN d > s THEN 'skip' ELSE 'back' END AS role FROM e")
def _(spark, d):
    return dv.cfg_edges(dv.blocks(spark, d)).withColumn("role", F.when(F.col("d") == F.col("s") + 1, "next").when(F.col("d") > F.col("s"), "skip").otherwise("back"))


@query("cfg_entry_exit", I + "x AS (SELECT 1) SELECT fn, min(b) AS entry, max(b) AS exit, count(*) AS blocks FROM blk GROUP BY fn")
def _(spark, d):
    return dv.blocks(spark, d).groupBy("fn").agg(F.min("b").alias("entry"), F.max("b").alias("exit"), F.count(F.lit(1)).alias("blocks"))


@query("cfg_element_kinds", I + "x AS (SELECT 1) SELECT et AS kind, count(*) AS n FROM blk GROUP BY et")
def _(spark, d):
    return dv.blocks(spark, d).groupBy(F.col("et").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("cfg_pivot_kinds", I + "x AS (SELECT 1) SELECT fn, " + ", ".join(f"count(*) FILTER (et = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM blk GROUP BY fn")
def _(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return dv.blocks(spark, d).groupBy("fn").pivot("et", kinds).count().na.fill(0)


@query("cfg_cyclomatic", I + "x AS (SELECT 1) SELECT fn, (SELECT count(*) FROM e WHERE e.fn = y.fn) AS edges, count(*) AS blocks, (SELECT count(*) FROM e WHERE e.fn = y.fn) - count(*) + 2 AS cyclomatic FROM blk y GROUP BY fn")
def _(spark, d):
    blk = dv.blocks(spark, d)
    counts = blk.select("fn", F.lit(0).alias("e"), F.lit(1).alias("b")).unionByName(dv.cfg_edges(blk).select("fn", F.lit(1).alias("e"), F.lit(0).alias("b"))).groupBy("fn").agg(F.sum("e").alias("edges"), F.sum("b").alias("blocks"))
    return counts.withColumn("cyclomatic", F.col("edges") - F.col("blocks") + 2)


kernel("cfg_reachable", cfg.reachable, I + REACH + " SELECT fn, b, min(level) AS level FROM r GROUP BY fn, b")
kernel("cfg_reach_pairs", cfg.reach_pairs, I + "c AS (SELECT fn, s AS a, d AS b FROM e UNION SELECT c.fn, c.a, e.d FROM c JOIN e ON e.fn = c.fn AND e.s = c.b) SELECT * FROM c")
kernel("cfg_cycle_members", lambda f: cfg.scc(f).where("cyclic").select("fn", "b"), I + "c AS (SELECT fn, s AS a, d AS b FROM e UNION SELECT c.fn, c.a, e.d FROM c JOIN e ON e.fn = c.fn AND e.s = c.b) SELECT fn, a AS b FROM c WHERE a = b")
kernel("cfg_scc", cfg.scc, I + "c AS (SELECT fn, s AS a, d AS b FROM e UNION SELECT c.fn, c.a, e.d FROM c JOIN e ON e.fn = c.fn AND e.s = c.b) SELECT y.fn, y.b, least(y.b, coalesce(min(m.b), y.b)) AS label, coalesce(bool_or(m.b = y.b), false) AS cyclic FROM blk y LEFT JOIN (SELECT c.* FROM c JOIN c z ON z.fn = c.fn AND z.a = c.b AND z.b = c.a) m ON m.fn = y.fn AND m.a = y.b GROUP BY y.fn, y.b")
kernel("dom_pairs", cfg.dom_pairs, I + AVOID + " SELECT * FROM dom")
kernel("idom", cfg.idom, I + AVOID + " SELECT x.fn, x.b, x.dom AS idom FROM dom x WHERE x.dom <> x.b AND NOT EXISTS (SELECT 1 FROM dom y WHERE y.fn = x.fn AND y.b = x.b AND y.dom <> x.b AND y.dom <> x.dom AND NOT EXISTS (SELECT 1 FROM dom z WHERE z.fn = x.fn AND z.dom = y.dom AND z.b = x.dom))")
kernel("pdom_pairs", cfg.pdom_pairs, I + PAVOID + " SELECT * FROM pdom")
kernel("ipdom", cfg.ipdom, I + PAVOID + " SELECT x.fn, x.b, x.pdom AS ipdom FROM pdom x WHERE x.pdom <> x.b AND NOT EXISTS (SELECT 1 FROM pdom y WHERE y.fn = x.fn AND y.b = x.b AND y.pdom <> x.b AND y.pdom <> x.pdom AND NOT EXISTS (SELECT 1 FROM pdom z WHERE z.fn = x.fn AND z.pdom = y.pdom AND z.b = x.pdom)) UNION ALL SELECT fn, b, 0 FROM blk WHERE b = n")
kernel("dom_back_edges", cfg.dominance_back_edges, R + LOOP + " SELECT * FROM be", "r")
kernel("dom_back_edges_irreducible", cfg.dominance_back_edges, I + LOOP + " SELECT * FROM be")
kernel("loop_body", cfg.loop_bodies, R + LOOP + " SELECT * FROM body", "r")
kernel("loop_depth", cfg.loop_depths, R + LOOP + " SELECT x.fn, x.header, count(DISTINCT y.header) AS depth FROM (SELECT DISTINCT fn, header FROM body) x JOIN body y ON y.fn = x.fn AND y.b = x.header GROUP BY x.fn, x.header", "r")
IRREDUCIBLE = LOOP + ", ne AS (SELECT * FROM e EXCEPT SELECT * FROM be), nc AS (SELECT fn, s AS a, d AS b FROM ne UNION SELECT nc.fn, nc.a, ne.d FROM nc JOIN ne ON ne.fn = nc.fn AND ne.s = nc.b) SELECT fn, NOT bool_or(EXISTS (SELECT 1 FROM nc WHERE nc.fn = blk.fn AND a = nc.b)) AS reducible FROM blk GROUP BY fn"
kernel("reducible_flag", cfg.reducible, I + IRREDUCIBLE)
kernel("reducible_flag_r", cfg.reducible, R + IRREDUCIBLE, "r")
kernel("dominance_frontier", cfg.frontier, I + DF + " SELECT * FROM fr")
kernel("idf_phi", cfg.phi_blocks, I + USES + ", " + DF + ", phi AS (SELECT df.fn, df.v, frontier AS b FROM df JOIN fr ON fr.fn = df.fn AND fr.b = df.b UNION SELECT phi.fn, phi.v, frontier FROM phi JOIN fr ON fr.fn = phi.fn AND fr.b = phi.b) SELECT * FROM phi")
kernel("control_dep", cfg.control_dependence, I + CD + " SELECT * FROM cd")
kernel("backward_slice", cfg.backward_slice, I + USES + ", " + CD + ", can AS (SELECT fn, n AS b FROM blk WHERE b = n UNION SELECT e.fn, e.s FROM can JOIN e ON e.fn = can.fn AND e.d = can.b), sl AS (SELECT fn, 'block' AS kind, n AS id FROM blk WHERE b = n UNION SELECT sl.fn, x.kind, x.id FROM sl JOIN (SELECT cd.fn, 'block' AS fk, cd.b AS fid, 'block' AS kind, branch AS id FROM cd JOIN can ON can.fn = cd.fn AND can.b = cd.branch UNION ALL SELECT fn, 'block', b, 'var', v FROM u UNION ALL SELECT df.fn, 'var', v, 'block', df.b FROM df JOIN can ON can.fn = df.fn AND can.b = df.b) x ON x.fn = sl.fn AND x.fk = sl.kind AND x.fid = sl.id) SELECT fn, kind, id::BIGINT AS id FROM sl")
kernel("gen_kill", cfg.gen_kill, I + USES + " SELECT fn, b, v::BIGINT AS v, max(g) = 1 AS gen, max(k) = 1 AS kill FROM (SELECT *, 1 AS g, 0 AS k FROM u UNION ALL SELECT *, 0, 1 FROM df) GROUP BY fn, b, v")
kernel("live_in", cfg.liveness, I + LIVE + " SELECT fn, b, v::BIGINT AS v FROM live")
kernel("live_out", lambda f: cfg.liveness(f, side="out"), I + LIVE + " SELECT DISTINCT e.fn, e.s AS b, v::BIGINT AS v FROM e JOIN live ON live.fn = e.fn AND live.b = e.d")
kernel("maybe_uninit", cfg.maybe_uninit, I + UNINIT + " SELECT fn, b, v::BIGINT AS v FROM un")
kernel("maybe_uninit_r", cfg.maybe_uninit, R + UNINIT + " SELECT fn, b, v::BIGINT AS v FROM un", "r")
kernel("uninit_uses", lambda f: cfg.maybe_uninit(f, uses=True), I + UNINIT + " SELECT fn, b, v::BIGINT AS v FROM un JOIN u USING (fn, b, v)")
kernel("uninit_kinds", cfg.uninit_kinds, I + UNINIT + ", " + ASSIGNED + " SELECT fn, b, v::BIGINT AS v, CASE WHEN EXISTS (SELECT 1 FROM asg WHERE asg.fn = un.fn AND asg.b = un.b AND asg.v = un.v) THEN 'sometimes' ELSE 'always' END AS kind FROM un JOIN u USING (fn, b, v)")
kernel("dead_stores", cfg.dead_stores, I + LIVE + " SELECT df.fn, df.b, df.v::BIGINT AS v FROM df WHERE NOT EXISTS (SELECT 1 FROM e JOIN live ON live.fn = e.fn AND live.b = e.d WHERE e.fn = df.fn AND e.s = df.b AND live.v = df.v)")
kernel("may_assigned", cfg.may_assigned, I + USES + ", " + ASSIGNED + " SELECT fn, b, v::BIGINT AS v FROM asg")
kernel("rpo_order", cfg.orders)
kernel("wto", cfg.weak_orders, variant="r")
kernel("dfs_back_edges", cfg.dfs_back_edges)
kernel("retreating_not_back", cfg.retreating_not_back)
kernel("solver_visits", cfg.solver_costs, variant="r")
kernel("solver_invariant", lambda f: cfg.solver_costs(f).agg(F.count(F.when(~F.col("same"), 1)).alias("violations")), "SELECT 0::BIGINT AS violations")
kernel("const_prop", cfg.constants)
kernel("interval_widen", cfg.intervals)
kernel("interval_refine", cfg.refined)
kernel("element_states", cfg.element_states)
TAINT = "act AS (SELECT fn, b, et, v::BIGINT AS v FROM blk WHERE et IN ('signup', 'purchase', 'click') AND v IS NOT NULL), tt AS (SELECT act.fn, e.d AS b, act.v, CASE et WHEN 'signup' THEN 'tainted' ELSE 'clean' END AS is FROM act JOIN e ON e.fn = act.fn AND e.s = act.b WHERE et <> 'click' UNION SELECT fn, 1, v, 'clean' FROM act UNION SELECT tt.fn, e.d, tt.v, tt.is FROM tt JOIN e ON e.fn = tt.fn AND e.s = tt.b WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.fn = tt.fn AND act.b = tt.b AND act.v = tt.v AND act.et <> 'click'))".replace(" AS is ", " AS st ").replace("tt.is", "tt.st")
kernel("taint_clicks", cfg.taint, I + TAINT + " SELECT tt.fn, tt.b, tt.v, CASE WHEN count(DISTINCT st) = 2 THEN 'maybe' ELSE min(st) END AS verdict FROM tt JOIN act ON act.fn = tt.fn AND act.b = tt.b AND act.v = tt.v AND act.et = 'click' GROUP BY tt.fn, tt.b, tt.v")
kernel("cfg_shape", cfg.shape)
kernel("cfg_shape_counts", lambda f: cfg.shape(f).drop("back_edges"), I + LOOP + ", hs AS (SELECT fn, count(DISTINCT d) AS loops FROM be GROUP BY fn), es AS (SELECT fn, count(*) AS edges FROM e GROUP BY fn) SELECT blk.fn, count(*) AS blocks, coalesce(max(edges), 0) AS edges, coalesce(max(edges), 0) - count(*) + 2 AS cyclomatic, coalesce(max(loops), 0) AS loops, greatest(1, 150 * count(*) * (1 + coalesce(max(loops), 0)) // 100) AS budget FROM blk LEFT JOIN hs USING (fn) LEFT JOIN es USING (fn) GROUP BY blk.fn")
FLOW = "br AS (SELECT fn, b, v % 4 AS x, b + 1 < n AS two FROM blk WHERE et = 'view' AND v IS NOT NULL), fw AS (SELECT fn, s, d FROM e WHERE d > s), w AS (SELECT fn, 1::BIGINT AS b, a FROM blk, range(16) r(a) WHERE b = 1 UNION SELECT w.fn, fw.d, w.a FROM w JOIN fw ON fw.fn = w.fn AND fw.s = w.b LEFT JOIN br ON br.fn = w.fn AND br.b = w.b WHERE br.b IS NULL OR NOT br.two OR (w.a // power(2, br.x)::BIGINT % 2 = 1) = (fw.d <> w.b + 1))"
kernel("flow_verdicts", cfg.flow_conditions, I + FLOW + " SELECT br.fn, br.b, CASE WHEN count(w.a) = 0 THEN 'BOTH PROVEN' WHEN bool_and(w.a // power(2, br.x)::BIGINT % 2 = 1) THEN 'ALWAYS TRUE' WHEN NOT bool_or(w.a // power(2, br.x)::BIGINT % 2 = 1) THEN 'ALWAYS FALSE' ELSE 'unknown' END AS verdict FROM br LEFT JOIN w ON w.fn = br.fn AND w.b = br.b GROUP BY br.fn, br.b")
