"""Queries for selections and projections, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import callgraph as cg
from graphloom.operators import cfg, checkers
from graphloom.operators import interproc as ip
from graphloom.operators import views as vw
from graphloom.operators.graph_queries import AVOID, CLOSURE, HEIGHT, LIVE, LOOP, PAVOID, SCC, UNINIT, USES, G, I, R, facts, graph, inf, kernel
from graphloom.plans import derive as dv
from graphloom.registry import query

CG = "WITH " + dv.CG + " "


@query("cg_one_function", CG + "SELECT DISTINCT src, dst FROM cg WHERE src = 17")
def _(spark, d):
    return vw.of_function(dv.call_pairs(spark, d), F.lit(17))


UNIT_SQL = CG + ", own AS (SELECT src, dst FROM cg WHERE tu = 'A') "


@query("cg_unit_nodes", UNIT_SQL + "SELECT fn, CASE WHEN fn IN (SELECT src FROM own) THEN 'def' ELSE 'callee' END AS kind FROM (SELECT src AS fn FROM own UNION SELECT dst FROM own)")
def _(spark, d):
    return vw.of_unit(dv.calls(spark, d), "A")[0]


@query("cg_unit_edges", UNIT_SQL + "SELECT DISTINCT src, dst FROM own")
def _(spark, d):
    return vw.of_unit(dv.calls(spark, d), "A")[1]


@query("cg_with_root", CG + "SELECT src, dst FROM p UNION ALL SELECT -2, fn FROM nodes")
def _(spark, d):
    return vw.with_root(*graph(spark, d))


@query("cg_provenance", CG + "SELECT fn, CASE WHEN fn IN (SELECT src FROM cg) THEN 'def' WHEN fn IN (SELECT dst FROM cg) THEN 'callee' ELSE 'block' END AS door FROM nodes")
def _(spark, d):
    return vw.provenance(dv.call_nodes(spark, d), dv.call_sites(spark, d))


@query("cg_node_kinds", CG + "SELECT fn, CASE WHEN fn = -1 THEN 'external' WHEN fn NOT IN (SELECT src FROM cg) THEN 'declaration' WHEN fn % 40 = 0 THEN 'entry' WHEN fn IN (SELECT src FROM cg WHERE src = dst) THEN 'self-recursive' ELSE 'plain' END AS kind FROM nodes")
def _(spark, d):
    return vw.node_kinds(dv.call_nodes(spark, d), dv.call_sites(spark, d), dv.EXTERNAL, dv.ENTRY)


@query("cg_node_ranks", CG + ", f AS (SELECT src, min((line, col)) AS place FROM cg GROUP BY src) SELECT fn, row_number() OVER (ORDER BY fn::VARCHAR) AS by_name, row_number() OVER (ORDER BY place IS NULL, place, fn) AS by_source FROM nodes LEFT JOIN f ON src = fn")
def _(spark, d):
    return vw.node_ranks(dv.call_nodes(spark, d), dv.call_sites(spark, d))


@query("cg_edge_ranks", CG + ", s AS (SELECT DISTINCT src, dst, line, col FROM cg) SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, line, col) AS by_callee, row_number() OVER (PARTITION BY src ORDER BY line, col, dst) AS by_source FROM s")
def _(spark, d):
    return vw.edge_ranks(dv.call_sites(spark, d))


GROUPS = {"dtors": ["error"], "calls": ["click", "purchase"], "scopes": ["signup", "view"]}


@query("cfg_kind_groups", I + "g(name, kind) AS (VALUES ('dtors', 'error'), ('calls', 'click'), ('calls', 'purchase')) SELECT name, kind, count(*) AS elements, count(DISTINCT fn) AS functions FROM blk JOIN g ON et = kind GROUP BY name, kind")
def _(spark, d):
    return vw.in_groups(dv.blocks(spark, d), GROUPS, ["dtors", "calls"])


VAR = "'x' || coalesce(v::VARCHAR, '?')"


@query("cfg_element_details", I + "z AS (SELECT 1) SELECT fn, b, CASE et WHEN 'signup' THEN 'init ' || " + VAR + " WHEN 'purchase' THEN 'give ' || " + VAR + " WHEN 'click' THEN 'read ' || " + VAR + " WHEN 'view' THEN 'if ' || " + VAR + " ELSE 'goto B' || greatest(b - 4, 1) END AS detail FROM blk")
def _(spark, d):
    return vw.details(dv.blocks(spark, d))


@query("cfg_terminators", I + "z AS (SELECT 1) SELECT fn, b, CASE et WHEN 'view' THEN 'if' ELSE 'goto' END AS kind, CASE et WHEN 'view' THEN 'x' || v END AS condition, CASE et WHEN 'view' THEN least(b + 3, n) ELSE greatest(b - 4, 1) END AS target FROM blk WHERE et IN ('view', 'error')")
def _(spark, d):
    return vw.terminators(dv.blocks(spark, d))


OWN = "own AS (SELECT fn, b, CASE et WHEN 'view' THEN 'terminator' WHEN 'error' THEN 'label' WHEN 'click' THEN 'element' WHEN 'purchase' THEN 'element' END AS r FROM blk)"


@query("cfg_statement_blocks", I + OWN + ", up AS (SELECT fn, b AS stmt, b AS spot, r FROM own UNION ALL SELECT up.fn, stmt, own.b, own.r FROM up JOIN own ON own.fn = up.fn AND own.b = up.spot // 2 WHERE up.r IS NULL), t AS (SELECT fn, stmt, max(spot) FILTER (r IS NOT NULL) AS block FROM up GROUP BY fn, stmt) SELECT t.fn, stmt, coalesce(own.r, CASE WHEN block IS NULL THEN 'none' ELSE 'ancestor' END) AS reason, block FROM t JOIN own ON own.fn = t.fn AND own.b = t.stmt")
def _(spark, d):
    return vw.statement_blocks(dv.blocks(spark, d))


@query("cfg_forced", I + "z AS (SELECT 1) SELECT fn, count(*) FILTER (et IN ('click', 'purchase')) AS before, count(*) FILTER (et IN ('click', 'purchase', 'view')) AS after, min(b) FILTER (et = 'view') AS first_block FROM blk GROUP BY fn")
def _(spark, d):
    return vw.forced(dv.blocks(spark, d), ["click", "purchase"], "view")


# Presets of a scan and what they keep.
PRESETS = {"full": ["click", "error", "purchase", "signup", "view"], "lean": ["click", "purchase"], "standard": ["click", "purchase", "signup", "view"]}
OPTIONS = [(p, k, k in kept) for p, kept in PRESETS.items() for k in PRESETS["full"]]


def options(spark):
    return spark.createDataFrame(OPTIONS, "preset string, kind string, keep boolean")


KEPT = "o(preset, kind, keep) AS (VALUES " + ", ".join(f"('{p}', '{k}', {keep})" for p, k, keep in OPTIONS) + "), k AS (SELECT preset, kind FROM o JOIN blk ON et = kind WHERE keep)"


@query("scan_presets", I + KEPT + " SELECT kind, " + ", ".join(f"count(*) FILTER (preset = '{p}') AS \"{p}\"" for p in PRESETS) + " FROM k GROUP BY kind")
def _(spark, d):
    return vw.presets(dv.blocks(spark, d), options(spark), list(PRESETS))


@query("preset_diff", I + KEPT + " SELECT kind, count(*) FILTER (preset = 'full') - count(*) FILTER (preset = 'lean') AS difference FROM k GROUP BY kind HAVING difference <> 0")
def _(spark, d):
    c = vw.presets(dv.blocks(spark, d), options(spark), list(PRESETS))
    return c.select("kind", (F.col("full") - F.col("lean")).alias("difference")).where("difference <> 0")


# Edges that a branch known beforehand prunes: purchases of variable 0 don't return.
PRUNED = I + "pe AS (SELECT e.fn, e.s, e.d, NOT (et = 'purchase' AND coalesce(v, 1) = 0 AND d = s + 1) AS reachable FROM e JOIN blk ON blk.fn = e.fn AND blk.b = e.s)"
LIVE_BLOCKS = PRUNED + ", lb AS (SELECT fn, b FROM blk WHERE b = 1 UNION SELECT pe.fn, pe.d FROM lb JOIN pe ON pe.fn = lb.fn AND pe.s = lb.b WHERE reachable), dead AS (SELECT fn, b FROM blk EXCEPT SELECT * FROM lb)"


@query("cfg_edge_totals", PRUNED + " SELECT fn, count(*) AS total, count(*) FILTER (reachable) AS reachable, count(*) FILTER (NOT reachable) AS pruned FROM pe GROUP BY fn")
def _(spark, d):
    return vw.edge_totals(dv.pruned_edges(dv.blocks(spark, d)))


@query("cfg_reachable_edges", PRUNED + " SELECT fn, s, d FROM pe WHERE reachable")
def _(spark, d):
    return dv.pruned_edges(dv.blocks(spark, d)).where("reachable").drop("reachable")


kernel("cfg_dead", vw.dead, LIVE_BLOCKS + " SELECT * FROM dead", "p")
kernel("unreachable_code", vw.unreachable_code, LIVE_BLOCKS + " SELECT dead.fn, dead.b, CASE et WHEN 'purchase' THEN 'Return' WHEN 'view' THEN 'Break' WHEN 'error' THEN 'LoopIncrement' ELSE 'Other' END AS kind FROM dead JOIN blk USING (fn, b) WHERE NOT EXISTS (SELECT 1 FROM pe JOIN dead x ON x.fn = pe.fn AND x.b = pe.s WHERE reachable AND pe.fn = dead.fn AND pe.d = dead.b AND pe.s <> dead.b)", "p")
kernel("state_per_block", vw.has_state, LIVE_BLOCKS + ", vs AS (SELECT fn, count(DISTINCT v) AS n FROM blk WHERE et IN ('signup', 'click', 'purchase') GROUP BY fn) SELECT blk.fn, blk.b, CASE WHEN lb.b IS NOT NULL THEN coalesce(vs.n, 0) END AS values FROM blk LEFT JOIN lb USING (fn, b) LEFT JOIN vs ON vs.fn = blk.fn", "p")
kernel("common_dominators", vw.common_dominators, I + AVOID + ", " + PAVOID + ", dd AS (SELECT fn, b, count(*) AS k FROM dom GROUP BY fn, b), pd AS (SELECT fn, b, count(*) AS k FROM pdom GROUP BY fn, b) SELECT e.fn, e.s, e.d, (SELECT arg_max(x.dom, k) FROM dom x JOIN dom y ON y.fn = x.fn AND y.dom = x.dom JOIN dd ON dd.fn = x.fn AND dd.b = x.dom WHERE x.fn = e.fn AND x.b = e.s AND y.b = e.d) AS dom, coalesce((SELECT arg_max(x.pdom, k) FROM pdom x JOIN pdom y ON y.fn = x.fn AND y.pdom = x.pdom JOIN pd ON pd.fn = x.fn AND pd.b = x.pdom WHERE x.fn = e.fn AND x.b = e.s AND y.b = e.d), 0) AS pdom FROM e")
kernel("loop_statements", vw.loop_statements, R + LOOP + " SELECT fn, count(*) FILTER (et = 'error' AND b > 1) AS loops, (SELECT count(*) FROM be WHERE be.fn = blk.fn) AS back_edges FROM blk GROUP BY fn", "r")
kernel("returns_in_loops", vw.returns_in_loops, R + LOOP + ", sz AS (SELECT fn, header, count(*) AS k FROM body GROUP BY fn, header) SELECT body.fn, body.b, string_agg(body.header::VARCHAR, ',' ORDER BY k, body.header) AS headers FROM body JOIN sz USING (fn, header) JOIN blk ON blk.fn = body.fn AND blk.b = body.b WHERE et = 'purchase' GROUP BY body.fn, body.b", "r")


@query("exception_targets", I + "h AS (SELECT *, min(CASE WHEN et = 'error' THEN b END) OVER (PARTITION BY fn ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS handler FROM blk), t AS (SELECT *, (SELECT arg_max(coalesce(y.handler, 0), y.b) FROM h y WHERE y.fn = h.fn AND y.b < h.b AND y.et = 'signup') AS target FROM h) SELECT fn, b, v % 2 = 1 AS rethrow, CASE WHEN target > b THEN target END AS target FROM t WHERE et = 'purchase'")
def _(spark, d):
    return vw.throws(dv.blocks(spark, d))


@query("call_walk", G + "ps AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY min((line, col)), dst) AS k FROM cg GROUP BY src, dst), w AS (SELECT fn AS entry, fn, []::BIGINT[] AS path FROM nodes WHERE fn % 40 = 0 UNION ALL SELECT entry, dst, list_append(path, k) FROM w JOIN ps ON src = fn WHERE len(path) < 2) SELECT entry, row_number() OVER (PARTITION BY entry ORDER BY path) AS step, len(path) AS depth, fn FROM w")
def _(spark, d):
    return vw.walk(dv.call_sites(spark, d), dv.call_nodes(spark, d).where(dv.ENTRY), 2)


@query("pair_split", "SELECT p_partkey AS id, 'map<' || p_brand || ',f(' || p_size || ',1)>' AS a, 'g(' || p_size || ',' || p_type || ')' AS b FROM part")
def _(spark, d):
    text = F.concat(F.lit("map<"), "p_brand", F.lit(",f("), F.col("p_size").cast("string"), F.lit(",1)>,g("), F.col("p_size").cast("string"), F.lit(","), "p_type", F.lit(")"))
    return dv.table(spark, d, "part").select(F.col("p_partkey").alias("id"), vw.split_pairs(text).alias("s")).select("id", "s.a", "s.b")


@query("relative_paths", "SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS path FROM pages")
def _(spark, d):
    return dv.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/", "").alias("path"))


@query("fallback_lookup", "WITH k AS (SELECT p_name AS key, min(p_partkey) AS fn FROM part WHERE p_size > 10 GROUP BY p_name), w AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS key FROM part), f AS (SELECT lower(key) AS form, min(fn) AS fn FROM k GROUP BY lower(key)) SELECT w.key, coalesce(k.fn, f.fn) AS fn, CASE WHEN k.fn IS NOT NULL THEN 'as given' WHEN f.fn IS NOT NULL THEN 'canonical' ELSE 'none' END AS found FROM w LEFT JOIN k ON k.key = w.key LEFT JOIN f ON f.form = lower(w.key)")
def _(spark, d):
    part = dv.table(spark, d, "part")
    known = part.where("p_size > 10").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("fn"))
    wanted = part.select(F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("key")).distinct()
    return vw.looked_up(wanted, known, F.lower("key"))


@query("policy_delta", CG + ", a AS (SELECT src, dst FROM cg), i AS (SELECT src, dst FROM cg WHERE NOT guarded), u AS (SELECT src, dst FROM cg WHERE tu <> 'R') SELECT 'implicit' AS policy, src, dst FROM (SELECT * FROM a EXCEPT SELECT * FROM i) UNION ALL SELECT 'unit', src, dst FROM (SELECT * FROM a EXCEPT SELECT * FROM u)")
def _(spark, d):
    """Edges that a graph loses without what a policy lets in."""
    c = dv.calls(spark, d)
    lost = lambda name, kept: c.select("src", "dst").subtract(c.where(kept).select("src", "dst")).select(F.lit(name).alias("policy"), "src", "dst")
    return lost("implicit", "NOT guarded").unionByName(lost("unit", "tu <> 'R'"))


@query("own_graph", CG + "SELECT DISTINCT src::VARCHAR AS src, CASE WHEN col = 7 THEN '?(' || tu || ')' ELSE dst::VARCHAR END AS dst FROM cg WHERE NOT (guarded AND col = 6)")
def _(spark, d):
    """A graph of our own making: calls through pointers (here the seventh of a line) lead to one node for each type, and policies leave out some calls."""
    c = dv.calls(spark, d).where(~(F.col("guarded") & (F.col("col") == 6)))
    return c.select(F.col("src").cast("string").alias("src"), F.when(F.col("col") == 7, F.concat(F.lit("?("), "tu", F.lit(")"))).otherwise(F.col("dst").cast("string")).alias("dst")).distinct()


@query("union_presence", CG + ", a AS (SELECT DISTINCT src AS fn FROM cg WHERE NOT guarded), b AS (SELECT DISTINCT dst AS fn FROM cg WHERE tu = 'A') SELECT coalesce(a.fn, b.fn) AS fn, CASE WHEN b.fn IS NULL THEN 'a' WHEN a.fn IS NULL THEN 'b' ELSE 'both' END AS \"in\" FROM a FULL JOIN b ON a.fn = b.fn")
def _(spark, d):
    c = dv.calls(spark, d)
    a, b = c.where("NOT guarded").select(F.col("src").alias("fn"), F.lit(1).alias("k")), c.where("tu = 'A'").select(F.col("dst").alias("fn"), F.lit(2).alias("k"))
    return a.unionByName(b).groupBy("fn").agg(F.element_at(F.array(*map(F.lit, ("a", "b", "both"))), F.bit_or("k")).alias("in"))


@query("height_inf_reach", G + SCC + ", " + HEIGHT + " SELECT fn, CASE WHEN fn IN (SELECT fn FROM loops) OR fn IN (SELECT src FROM c WHERE dst IN (SELECT fn FROM loops)) THEN 'inf' ELSE (SELECT max(d) FROM h WHERE h.fn = nodes.fn)::VARCHAR END AS height FROM nodes")
def _(spark, d):
    """Heights where whatever reaches a cycle is infinite as well."""
    return cg.endless(*graph(spark, d)).withColumn("height", inf())


@query("merge_names", CG + ", s AS (SELECT src AS key, tu, true AS def, line FROM cg UNION ALL SELECT dst, tu, false, line FROM cg) SELECT key, arg_min(key || '@' || tu, (NOT def, tu)) AS name, min(line) FILTER (NOT def) AS decl_line, bool_or(def) AS def FROM s GROUP BY key")
def _(spark, d):
    """Of each merged function the name that its definition gives, else the first unit's; and where it is declared first."""
    c = dv.calls(spark, d)
    seen = c.select(F.col("src").alias("key"), "tu", F.lit(True).alias("def"), "line").union(c.select("dst", "tu", F.lit(False), "line"))
    return seen.groupBy("key").agg(F.min_by(F.concat_ws("@", F.col("key").cast("string"), "tu"), F.struct(~F.col("def"), "tu")).alias("name"), F.min(F.when(~F.col("def"), F.col("line"))).alias("decl_line"), F.bool_or("def").alias("def"))


@query("block_callees", CG + ", s AS (SELECT src AS fn, row_number() OVER (PARTITION BY src ORDER BY line, col, guarded, dst) AS block, dst AS callee FROM cg) SELECT fn, callee, count(*) AS blocks, min(block) AS first FROM s GROUP BY fn, callee")
def _(spark, d):
    return dv.bodies(spark, d).groupBy("fn", F.col("dst").alias("callee")).agg(F.count(F.lit(1)).alias("blocks"), F.min("block").alias("first"))


SITE = "CASE WHEN l_tax = 0 THEN 'delete' WHEN l_discount = 0 THEN 'indirect' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'virtual' WHEN l_quantity >= 25 THEN CASE WHEN l_partkey % 120 IN (SELECT s_suppkey FROM supplier) THEN 'resolved' ELSE 'decl' END WHEN l_partkey % 120 NOT IN (SELECT s_suppkey FROM supplier) THEN 'missing:node' ELSE 'missing:edge' END"


@query("site_precedence", "SELECT class, count(*) AS n FROM (SELECT " + SITE + " AS class FROM lineitem) GROUP BY class")
def _(spark, d):
    """Why a call has no edge, by the first that holds; an edge to a function without a body is a declaration's."""
    known = dv.table(spark, d, "supplier").select(F.col("s_suppkey").alias("callee"), F.lit(True).alias("node"))
    rows = dv.table(spark, d, "lineitem").withColumn("callee", F.col("l_partkey") % 120).join(known, "callee", "left")
    node = F.col("node").isNotNull()
    what = F.when(F.col("l_tax") == 0, "delete").when(F.col("l_discount") == 0, "indirect").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "virtual").when((F.col("l_quantity") >= 25) & node, "resolved").when(F.col("l_quantity") >= 25, "decl").when(~node, "missing:node").otherwise("missing:edge")
    return rows.groupBy(what.alias("class")).agg(F.count(F.lit(1)).alias("n"))


UNINIT_ONLY = UNINIT.replace(USES + ", ", "")


@query("analysis_pipeline", I + LIVE + ", " + UNINIT_ONLY + ", " + LOOP + " SELECT 'blocks' AS analysis, count(*) AS n FROM blk UNION ALL SELECT 'dead stores', count(*) FROM df WHERE NOT EXISTS (SELECT 1 FROM e JOIN live ON live.fn = e.fn AND live.b = e.d WHERE e.fn = df.fn AND e.s = df.b AND live.v = df.v) UNION ALL SELECT 'loops', count(*) FROM (SELECT DISTINCT fn, d FROM be) UNION ALL SELECT 'uninitialised uses', count(*) FROM un JOIN u USING (fn, b, v)")
def _(spark, d):
    """Several analyses over one table of facts, which is read once, and how much each finds."""
    f = facts(spark, d).cache()
    found = {"blocks": f.where("kind = 'b'").select("fn"), "dead stores": cfg.dead_stores(f), "loops": cfg.loop_depths(f), "uninitialised uses": cfg.maybe_uninit(f, uses=True)}
    out = None
    for name, rows in found.items():
        one = rows.agg(F.lit(name).alias("analysis"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("live_cross_check", I + "z AS (SELECT 1) SELECT fn, count(*) AS blocks, 0::BIGINT AS mismatches FROM blk GROUP BY fn")
def _(spark, d):
    """Of each function the blocks where liveness found element by element in turns differs from the solver's."""
    f = facts(spark, d)
    both = cfg.liveness(f).select("fn", "b", "v", F.lit(1).alias("k")).unionByName(checkers.liveness_by_hand(f).select("fn", "b", "v", F.lit(2).alias("k")))
    apart = both.groupBy("fn", "b", "v").agg(F.bit_or("k").alias("k")).where("k <> 3").select("fn", "b").distinct().groupBy("fn").agg(F.count(F.lit(1)).alias("m"))
    return f.where("kind = 'b'").groupBy("fn").agg(F.count(F.lit(1)).alias("blocks")).join(apart, "fn", "left").select("fn", "blocks", F.coalesce("m", F.lit(0)).cast("long").alias("mismatches"))


kernel("live_by_hand", checkers.liveness_by_hand, I + LIVE + " SELECT fn, b, v::BIGINT AS v FROM live")


# Targets of indirect calls: an exact class beats those that are made, which beat those of the hierarchy.
@query("merge_sizes", CG + "SELECT 'edge' AS kind, count(*) AS n, sum(length('edge ' || src || ' ' || dst))::BIGINT AS chars FROM p UNION ALL SELECT 'node', count(*), sum(length('node ' || fn))::BIGINT FROM nodes")
def _(spark, d):
    """How large each kind of record is as text."""
    n, p = graph(spark, d)
    lines = n.select(F.lit("node").alias("kind"), F.concat_ws(" ", F.lit("node"), F.col("fn").cast("string")).alias("line")).unionByName(p.select(F.lit("edge").alias("kind"), F.concat_ws(" ", F.lit("edge"), F.col("src").cast("string"), F.col("dst").cast("string")).alias("line")))
    return lines.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


# Conditions `size op c` over parts, whose sizes run from 1 to 50; a part's half in number is the statement around it, and a few of the larger ones come from macros.
CONDITION = "SELECT p_partkey AS k, p_partkey % 3 AS op, p_partkey % 60 AS c, p_partkey % 97 = 5 AND p_size > 25 AS macro FROM part"


@query("constant_conditions", "WITH RECURSIVE q AS (" + CONDITION + "), m AS (SELECT k FROM q WHERE macro UNION SELECT k // 2 FROM m WHERE k > 1), v AS (SELECT k, CASE WHEN op = 0 AND c > 50 OR op = 1 AND c <= 1 THEN 'always true' WHEN op = 0 AND c <= 1 OR op = 1 AND c > 50 OR op = 2 AND (c < 1 OR c > 50) THEN 'always false' END AS verdict FROM q) SELECT k, verdict FROM v WHERE verdict IS NOT NULL AND k NOT IN (SELECT k FROM m)")
def _(spark, d):
    """Comparisons that their operand's range decides, but for those that hold something from a macro, however deep."""
    q = dv.table(spark, d, "part").select(F.col("p_partkey").alias("fn"), (F.col("p_partkey") % 3).alias("op"), (F.col("p_partkey") % 60).alias("c"), ((F.col("p_partkey") % 97 == 5) & (F.col("p_size") > 25)).alias("macro"))
    up = q.where("fn > 1").select(F.col("fn").alias("src"), F.floor(F.col("fn") / 2).alias("dst"))
    hidden = cg.reach(q.select("fn"), up, q.where("macro").select("fn")).select("fn")
    low, high = F.col("c") <= 1, F.col("c") > 50
    less, least, equal = (F.col("op") == k for k in range(3))
    verdict = F.when(less & high | least & low, "always true").when(less & low | least & high | equal & ((F.col("c") < 1) | high), "always false")
    return q.withColumn("verdict", verdict).where("verdict IS NOT NULL").join(hidden, "fn", "left_anti").select(F.col("fn").alias("k"), "verdict")


GATE = "CASE WHEN p_brand LIKE '%1' THEN 'error:c-input' WHEN p_size % 7 = 0 THEN 'error:template' WHEN p_size % 7 = 1 THEN 'skip:generic-lambda' ELSE 'ok' END"


@query("analysis_gate", "SELECT " + GATE + " AS status, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def _(spark, d):
    """What an analysis refuses before it begins, by the first reason that holds, and how many declarations of each kind there are."""
    status = F.when(F.col("p_brand").endswith("1"), "error:c-input").when(F.col("p_size") % 7 == 0, "error:template").when(F.col("p_size") % 7 == 1, "skip:generic-lambda").otherwise("ok")
    return dv.table(spark, d, "part").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


# Bodies of functions that are known though no unit defines them: blocks 0 (entry) to 3 (exit) of one that calls its argument once.
CALL_ONCE = [(0, 1), (1, 2), (1, 3), (2, 3)]


@query("synthesised_bodies", CG + ", s AS (SELECT src AS fn, row_number() OVER (PARTITION BY src ORDER BY line, col, guarded, dst) AS block, dst FROM cg) SELECT fn, block, a, b FROM s, (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in CALL_ONCE) + ") m(a, b) WHERE dst = -1")
def _(spark, d):
    """Control flow that is put in for each call to the external function. The model is four rows."""
    model = spark.createDataFrame([(dv.EXTERNAL, a, b) for a, b in CALL_ONCE], "dst long, a long, b long")
    return dv.bodies(spark, d).join(F.broadcast(model), "dst").select("fn", "block", "a", "b")
