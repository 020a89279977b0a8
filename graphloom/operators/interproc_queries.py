"""Queries between functions, over units (l_returnflag), classes (part.p_type as a tree of words) and sites of the derived call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import callgraph as cg
from graphloom.operators import interproc as ip
from graphloom.operators.graph_queries import SCC, G, graph
from graphloom.plans import derive as dv
from graphloom.plans import fixpoint as fx
from graphloom.registry import query

SINKS = "(SELECT fn FROM nodes WHERE fn % 17 = 5)"


def sinks(nodes):
    return nodes.where("fn % 17 = 5")


MAY = "l AS (SELECT fn, 0::BIGINT AS level FROM " + SINKS + " UNION SELECT src, level + 1 FROM l JOIN p ON p.dst = l.fn WHERE level < 41), may AS (SELECT fn, min(level) AS may FROM l GROUP BY fn)"
ROUNDS = G + MAY + ", q AS (SELECT DISTINCT src, dst FROM cg WHERE NOT guarded), a AS (SELECT fn, 0::BIGINT AS level FROM " + SINKS + " UNION SELECT src, level + 1 FROM a JOIN q ON q.dst = a.fn WHERE level < 41), al AS (SELECT fn, min(level) AS always FROM a GROUP BY fn), rounds AS (SELECT fn, may, always FROM nodes LEFT JOIN may USING (fn) LEFT JOIN al USING (fn))"


def rounds(spark, d):
    """A call that isn't guarded lies on every way to the exit, which SQL makes use of; here the exit must be out of reach without the blocks that end in a sink."""
    body, n = dv.bodies(spark, d), dv.call_nodes(spark, d)
    return ip.sink_rounds(n, body.select("fn", "block", "dst"), dv.body_edges(body), sinks(n))


@query("sink_may", ROUNDS + " SELECT fn FROM rounds WHERE may IS NOT NULL")
def _(spark, d):
    return ip.sink_levels(rounds(spark, d)).where("level <> 'none'").select("fn")


@query("sink_always", ROUNDS + " SELECT fn FROM rounds WHERE always IS NOT NULL")
def _(spark, d):
    return ip.sink_levels(rounds(spark, d)).where("level = 'always'").select("fn")


@query("sink_levels", ROUNDS + " SELECT fn, CASE WHEN always IS NOT NULL THEN 'always' WHEN may IS NOT NULL THEN 'may' ELSE 'none' END AS level, coalesce(always, may, 0) AS iter FROM rounds")
def _(spark, d):
    return ip.sink_levels(rounds(spark, d))


@query("sink_trace", ROUNDS + " SELECT fn, may AS pass, 'may' AS value FROM rounds WHERE may < coalesce(always, 99) UNION ALL SELECT fn, always, 'always' FROM rounds WHERE always IS NOT NULL")
def _(spark, d):
    return ip.sink_trace(rounds(spark, d))


@query("sink_chains", G + MAY + ", via AS (SELECT p.src AS fn, min(p.dst) AS via FROM p JOIN may x ON x.fn = p.src JOIN may y ON y.fn = p.dst WHERE y.may = x.may - 1 GROUP BY p.src), ch AS (SELECT fn, NULL::BIGINT AS via, 0::BIGINT AS len, fn::VARCHAR AS chain FROM may WHERE may = 0 UNION ALL SELECT v.fn, v.via, len + 1, v.fn || '>' || chain FROM ch JOIN via v ON v.via = ch.fn) SELECT * FROM ch")
def _(spark, d):
    n, p = graph(spark, d)
    return ip.sink_chains(p, cg.reach(n, p, sinks(n), backwards=True))


@query("shortest_cycles", G + SCC + ", heads AS (SELECT DISTINCT label FROM s WHERE fn IN (SELECT fn FROM loops)), w AS (SELECT label, label AS fn, 0::BIGINT AS len FROM heads UNION SELECT w.label, p.dst, len + 1 FROM w JOIN p ON p.src = w.fn JOIN s ON s.fn = p.dst AND s.label = w.label WHERE len <= (SELECT count(*) FROM s x WHERE x.label = w.label)), short AS (SELECT label, min(len) AS len FROM w WHERE fn = label AND len > 0 GROUP BY label), t AS (SELECT label, label AS fn, [label] AS path FROM short UNION ALL SELECT t.label, p.dst, list_append(path, p.dst) FROM t JOIN short USING (label) JOIN p ON p.src = t.fn JOIN s ON s.fn = p.dst AND s.label = t.label WHERE len(path) <= short.len) SELECT t.label, array_to_string(min(path), '>') AS cycle FROM t JOIN short USING (label) WHERE len(path) = short.len + 1 AND path[-1] = label GROUP BY t.label")
def _(spark, d):
    return cg.cycle_chains(*graph(spark, d))


@query("sink_shortest_len", G + "l AS (SELECT fn, 0::BIGINT AS level FROM " + SINKS + " UNION SELECT src, level + 1 FROM l JOIN p ON p.dst = l.fn WHERE level < 41) SELECT fn, min(level) AS level FROM l GROUP BY fn")
def _(spark, d):
    n, p = graph(spark, d)
    return cg.reach(n, p, sinks(n), backwards=True)


def ctx(k: int):
    """Roots are functions that none calls. SQL finds contexts and their possible values as one relation of single facts."""
    cut = f"CASE WHEN len(st) >= {k} THEN list_append(st[len(st) - {k} + 2:], site) ELSE list_append(st, site) END" if k else "[]::VARCHAR[]"
    sql = G + "calls AS (SELECT DISTINCT src, dst, src || ':' || line || ':' || col AS site, col % 3 AS arg FROM cg), entries AS (SELECT fn FROM nodes WHERE fn NOT IN (SELECT dst FROM cg)), " + f"x AS (SELECT fn, []::VARCHAR[] AS st, bit FROM entries, (VALUES (1), (2)) v(bit) UNION SELECT dst, {cut}, CASE arg WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE bit END FROM x JOIN calls ON src = fn) SELECT fn, array_to_string(st, ' ') AS string, bit_or(bit)::INT AS value FROM x GROUP BY fn, st"

    @query(f"ctx_k{k}", sql)
    def _(spark, d):
        n, s = dv.call_nodes(spark, d), dv.call_sites(spark, d)
        entries = n.join(s.select(F.col("dst").alias("fn")), "fn", "left_anti")
        return ip.contexts(n, s, entries, k, limit=None).select("fn", F.array_join("string", " ").alias("string"), "value")

    return sql


CTX = [ctx(k) for k in range(3)]


@query("ctx_warnings", "SELECT fn, count(*) AS contexts, count(*) FILTER (value % 2 = 1) AS warnings FROM (" + CTX[1] + ") GROUP BY fn")
def _(spark, d):
    from graphloom.registry import QUERIES

    c = QUERIES["ctx_k1"](spark, d)
    return c.groupBy("fn").agg(F.count(F.lit(1)).alias("contexts"), F.count(F.when(F.col("value") % 2 == 1, 1)).alias("warnings"))


CONTEXTS = "(" + CTX[1] + ")"


@query("ctx_divisions", "SELECT fn, string, CASE value WHEN 1 THEN 'zero' ELSE 'maybe zero' END AS warning FROM " + CONTEXTS + " WHERE fn % 3 = 0 AND value % 2 = 1")
def _(spark, d):
    """Functions that divide by their parameter (here every third), in the contexts where it may be zero."""
    from graphloom.registry import QUERIES

    return QUERIES["ctx_k1"](spark, d).where("fn % 3 = 0 AND value % 2 = 1").select("fn", "string", F.when(F.col("value") == 1, "zero").otherwise("maybe zero").alias("warning"))


@query("ctx_edges", "SELECT DISTINCT x.fn AS src, x.string AS src_string, c.dst, c.src || ':' || c.line || ':' || c.col AS dst_string FROM " + CONTEXTS + " x JOIN (" + "WITH " + dv.CG + " SELECT * FROM cg) c ON c.src = x.fn")
def _(spark, d):
    n, s = dv.call_nodes(spark, d), dv.call_sites(spark, d)
    found = ip.contexts(n, s, n.join(s.select(F.col("dst").alias("fn")), "fn", "left_anti"), 1, limit=None)
    return ip.context_edges(found, s, 1)


@query("inline_verdicts", G + "st AS (SELECT DISTINCT src, dst, col <> 5 AS fits FROM cg), w AS (SELECT fn AS entry, [fn] AS chain, 'inlined' AS verdict FROM nodes WHERE fn % 40 = 0 UNION SELECT entry, list_append(chain, dst), CASE WHEN dst NOT IN (SELECT src FROM cg) THEN 'no body' WHEN list_contains(chain, dst) THEN 'recursion' WHEN NOT fits THEN 'arguments' WHEN len(chain) = 3 THEN 'depth' ELSE 'inlined' END FROM w JOIN st ON src = chain[-1] WHERE verdict = 'inlined') SELECT entry, array_to_string(chain, '>') AS path, len(chain) - 2 AS depth, verdict FROM w WHERE len(chain) > 1")
def _(spark, d):
    s = dv.call_sites(spark, d)
    return ip.inlined(s.withColumn("fits", F.col("col") != 5), dv.call_nodes(spark, d).where(dv.ENTRY), s.select(F.col("src").alias("fn")).distinct(), 2).distinct()


CLASSES = "parts AS (SELECT DISTINCT string_split(p_type, ' ') AS w FROM part), base AS (SELECT DISTINCT array_to_string(w[:i], ' ') AS sub, CASE WHEN i = 1 THEN 'ANY' ELSE array_to_string(w[:i - 1], ' ') END AS sup FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM parts)), tree AS (SELECT sub AS sup, sub FROM base UNION SELECT sup, sup FROM base UNION SELECT tree.sup, base.sub FROM tree JOIN base ON base.sup = tree.sub), concrete AS (SELECT DISTINCT p_type AS class FROM part), vs AS (SELECT DISTINCT p_partkey AS site, string_split(p_type, ' ')[1] AS static_class FROM part), made AS (SELECT DISTINCT p_type AS class FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 49)"


def hierarchy(spark, d):
    part = dv.table(spark, d, "part")
    words = part.select(F.split("p_type", " ").alias("w")).distinct()
    steps = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    base = steps.select(F.array_join(F.slice("w", F.lit(1), F.col("i")), " ").alias("sub"), F.when(F.col("i") == 1, "ANY").otherwise(F.array_join(F.slice("w", F.lit(1), F.greatest(F.col("i") - 1, F.lit(1))), " ")).alias("sup")).distinct()
    classes = base.select(F.col("sub").alias("class")).join(part.select(F.col("p_type").alias("class"), F.lit(False).alias("abstract")).distinct(), "class", "left").select("class", F.coalesce("abstract", F.lit(True)).alias("abstract"))
    calls = part.select(F.col("p_partkey").alias("site"), F.split("p_type", " ")[0].alias("static_class")).distinct()
    return ip.descendants(base), classes, calls


def made(spark, d):
    big = dv.table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return dv.table(spark, d, "part").join(big, "p_partkey", "left_semi").select(F.col("p_type").alias("class")).distinct()


@query("class_closure", "WITH RECURSIVE " + CLASSES + " SELECT * FROM tree")
def _(spark, d):
    return hierarchy(spark, d)[0]


@query("resolve_cha", "WITH RECURSIVE " + CLASSES + " SELECT DISTINCT site, sub AS target FROM vs JOIN tree ON sup = static_class JOIN concrete ON class = sub")
def _(spark, d):
    tree, classes, calls = hierarchy(spark, d)
    return ip.resolve_virtual(calls, tree, classes).distinct()


RTA = "WITH RECURSIVE " + CLASSES + ", rta AS (SELECT DISTINCT site, sub AS target FROM vs JOIN tree ON sup = static_class JOIN concrete c ON c.class = sub JOIN made m ON m.class = sub)"


@query("resolve_rta", RTA + " SELECT * FROM rta")
def _(spark, d):
    tree, classes, calls = hierarchy(spark, d)
    return ip.resolve_virtual(calls, tree, classes, made(spark, d)).distinct()


EXACT = ", exact AS (SELECT DISTINCT p_partkey AS site, p_type AS target FROM part WHERE p_size % 5 = 0)"


@query("resolve_exact", "WITH t AS (SELECT 1)" + EXACT + " SELECT site, target, CASE WHEN site % 2 = 0 THEN 'final' ELSE 'static' END AS reason FROM exact")
def _(spark, d):
    """Calls whose class is known exactly, as it is final or made on the spot."""
    return exact(spark, d).withColumn("reason", F.when(F.col("site") % 2 == 0, "final").otherwise("static"))


def exact(spark, d):
    return dv.table(spark, d, "part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("site"), F.col("p_type").alias("target")).distinct()


@query("resolve_precedence", RTA + EXACT + ", few AS (SELECT * FROM rta WHERE site % 3 <> 1), cha AS (SELECT DISTINCT site, sub AS target FROM vs JOIN tree ON sup = static_class JOIN concrete ON class = sub WHERE site % 7 <> 1) SELECT DISTINCT site, 'exact' AS rule, target FROM vs JOIN exact USING (site) UNION ALL SELECT site, 'rta', target FROM few WHERE site NOT IN (SELECT site FROM exact) UNION ALL SELECT site, 'cha', target FROM cha WHERE site NOT IN (SELECT site FROM exact UNION ALL SELECT site FROM few) UNION ALL SELECT site, 'unresolved', NULL FROM (SELECT DISTINCT site FROM vs WHERE site NOT IN (SELECT site FROM exact UNION ALL SELECT site FROM few UNION ALL SELECT site FROM cha))")
def _(spark, d):
    """An exact class beats those that are made, which beat those of the hierarchy; each of the latter rules knows some sites only."""
    tree, classes, calls = hierarchy(spark, d)
    cha, rta = ip.resolve_virtual(calls, tree, classes).where("site % 7 <> 1"), ip.resolve_virtual(calls, tree, classes, made(spark, d)).where("site % 3 <> 1")
    return ip.resolved(calls, [("exact", exact(spark, d)), ("rta", rta), ("cha", cha)])


MEMBERS = ", big AS (SELECT DISTINCT p_type AS class FROM part WHERE p_size >= 48), member AS (SELECT DISTINCT a.p_type AS class, b.p_type AS part FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size = 1), inst AS (SELECT class FROM big UNION SELECT part FROM inst JOIN member USING (class))"


@query("instantiated_classes", "WITH RECURSIVE z AS (SELECT 1)" + MEMBERS + " SELECT class FROM inst")
def _(spark, d):
    """Classes that are made, and those that they hold by value, and those that these hold."""
    part = dv.table(spark, d, "part")
    a, b = part.where("p_size = 1").select(F.col("p_partkey") + 1, F.col("p_type").alias("class")).toDF("k", "class"), part.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("part"))
    return ip.with_members(part.where("p_size >= 48").select(F.col("p_type").alias("class")).distinct(), a.join(b, "k").select("class", "part").distinct())


@query("resolve_fnptr", "SELECT DISTINCT p_partkey AS site, s_suppkey AS target FROM part JOIN supplier ON p_size % 25 = s_nationkey")
def _(spark, d):
    calls = dv.table(spark, d, "part").select(F.col("p_partkey").alias("site"), (F.col("p_size") % 25).alias("fn_type"))
    taken = dv.table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("fn_type"))
    return ip.resolve_pointers(calls, taken)


@query("resolve_stats", RTA + ", cha AS (SELECT DISTINCT site, sub AS target FROM vs JOIN tree ON sup = static_class JOIN concrete ON class = sub) SELECT (SELECT count(*) FROM vs) AS indirect, (SELECT count(DISTINCT site) FROM rta) AS resolved, (SELECT count(*) FROM rta) AS edges_rta, (SELECT count(*) FROM cha) AS edges_cha")
def _(spark, d):
    tree, classes, calls = hierarchy(spark, d)
    cha, rta = ip.resolve_virtual(calls, tree, classes).distinct(), ip.resolve_virtual(calls, tree, classes, made(spark, d)).distinct()
    parts = calls.select(F.lit("s").alias("k"), "site").unionByName(cha.select(F.lit("c").alias("k"), "site")).unionByName(rta.select(F.lit("r").alias("k"), "site"))
    n = lambda k, c=1: F.count(F.when(F.col("k") == k, c))
    return parts.agg(n("s").alias("indirect"), F.countDistinct(F.when(F.col("k") == "r", F.col("site"))).alias("resolved"), n("r").alias("edges_rta"), n("c").alias("edges_cha"))


TU = "WITH " + dv.CG + ", t AS (SELECT src, dst, line, col, tu FROM cg), seen AS (SELECT src AS key, tu, true AS def FROM t UNION ALL SELECT dst, tu, false FROM t), d AS (SELECT DISTINCT src AS key, tu FROM t)"


def units(spark, d):
    return dv.calls(spark, d).select("src", "dst", "line", "col", "tu")


@query("merge_nodes", TU + " SELECT key, bool_or(def) AS def, coalesce(string_agg(DISTINCT tu, ',' ORDER BY tu) FILTER (def), '') AS def_tus, string_agg(DISTINCT tu, ',' ORDER BY tu) AS seen_tus FROM seen GROUP BY key")
def _(spark, d):
    return ip.merge(units(spark, d))[0]


@query("merge_edges_xtu", TU + " SELECT src, dst, line, col, bool_or((dst, tu) NOT IN (SELECT key, tu FROM d)) AND dst IN (SELECT key FROM d) AS xtu FROM t GROUP BY src, dst, line, col")
def _(spark, d):
    return ip.merge(units(spark, d))[1]


@query("merge_unresolved", TU + " SELECT key, string_agg(DISTINCT tu, ',' ORDER BY tu) AS declared_in FROM seen GROUP BY key HAVING NOT bool_or(def)")
def _(spark, d):
    return ip.merge(units(spark, d))[0].where("NOT def").select("key", F.col("seen_tus").alias("declared_in"))


@query("merge_recursion", G + "c AS (SELECT src, dst FROM p UNION SELECT c.src, p.dst FROM c JOIN p ON c.dst = p.src), m AS (SELECT a.src AS fn, min(a.dst) AS label FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT label, count(*) AS members FROM m GROUP BY label")
def _(spark, d):
    return cg.components(*graph(spark, d)).where("cyclic").groupBy("label").agg(F.count(F.lit(1)).alias("members"))


NAMES = "WITH a AS (SELECT p_partkey AS fn, string_split(p_name, ' ')[1] AS base, p_brand AS signature, p_size::BIGINT AS line FROM part), b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '(' || signature || ')' ELSE base END AS n1 FROM a), c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY n1) > 1 THEN n1 || '@L' || line ELSE n1 END AS n2 FROM b) SELECT fn, CASE WHEN count(*) OVER (PARTITION BY n2) > 1 THEN n2 || '#' || row_number() OVER (PARTITION BY n2 ORDER BY line, fn) ELSE n2 END AS name FROM c"


@query("merge_name_collisions", NAMES)
def _(spark, d):
    return ip.unique_names(dv.table(spark, d, "part").select(F.col("p_partkey").alias("fn"), F.split("p_name", " ")[0].alias("base"), F.col("p_brand").alias("signature"), F.col("p_size").cast("long").alias("line")))


MULTI = "WITH " + dv.CG + ", a AS (SELECT src, dst FROM cg WHERE NOT guarded), b AS (SELECT src, dst FROM cg WHERE tu <> 'N'), k AS (SELECT src, dst, count(*) FILTER (w = 1) AS x, count(*) FILTER (w = 2) AS y FROM (SELECT *, 1 AS w FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY src, dst)"


def two_graphs(spark, d):
    """What two builders see: one leaves out guarded calls, the other a unit."""
    c = dv.calls(spark, d)
    return c.where("NOT guarded").select("src", "dst"), c.where("tu <> 'N'").select("src", "dst")


@query("multiset_diff_graphs", MULTI + " SELECT src, dst, least(x, y) AS \"both\", greatest(x - y, 0) AS only_a, greatest(y - x, 0) AS only_b FROM k")
def _(spark, d):
    return ip.multiset_difference(*two_graphs(spark, d), ["src", "dst"])


@query("graph_symmetric_diff", MULTI + " SELECT '+' AS sign, src, dst FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT '-', src, dst FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _(spark, d):
    a, b = two_graphs(spark, d)
    return a.subtract(b).select(F.lit("+").alias("sign"), "src", "dst").unionByName(b.subtract(a).select(F.lit("-").alias("sign"), "src", "dst"))


@query("multiset_intersect_all", MULTI + " SELECT src, dst, least(x, y) AS n FROM k WHERE x > 0 AND y > 0")
def _(spark, d):
    a, b = two_graphs(spark, d)
    return a.intersectAll(b).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("marker_match", "WITH a AS (SELECT user_id AS line, event_type AS kind, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE value >= 50), b AS (SELECT user_id AS line, event_type AS kind, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 0) SELECT coalesce(a.line, b.line) AS line, coalesce(a.kind, b.kind) AS kind, coalesce(a.n, b.n) AS n, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'unexpected' ELSE 'matched' END AS verdict FROM a FULL JOIN b ON a.line = b.line AND a.kind = b.kind AND a.n = b.n")
def _(spark, d):
    e = dv.table(spark, d, "events").select(F.col("user_id").alias("line"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "value")
    return ip.match_one_to_one(e.where("value >= 50"), e.where("id % 2 = 0"), ["line", "kind"])


@query("site_classes", "WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS site, CASE WHEN l_tax = 0 THEN NULL ELSE l_partkey % 120 END AS callee, l_quantity >= 25 AS edge FROM lineitem), g AS (SELECT DISTINCT site FROM x WHERE edge) SELECT class, count(*) AS n FROM (SELECT CASE WHEN callee IS NULL THEN 'missing:indirect' WHEN site IN (SELECT site FROM g) THEN 'resolved' WHEN callee NOT IN (SELECT s_suppkey FROM supplier) THEN 'missing:node' ELSE 'missing:edge' END AS class FROM x) GROUP BY class")
def _(spark, d):
    li = dv.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), F.when(F.col("l_tax") != 0, F.col("l_partkey") % 120).alias("callee"), (F.col("l_quantity") >= 25).alias("edge"))
    fns = dv.table(spark, d, "supplier").select(F.col("s_suppkey").alias("fn"))
    return ip.classify_sites(li.select("site", "callee"), li.where("edge"), fns).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("prefilter_semi", G + "x AS (SELECT 1) SELECT src, dst FROM p WHERE src IN (SELECT fn FROM " + SINKS + ") OR dst IN (SELECT fn FROM " + SINKS + ")")
def _(spark, d):
    n, p = graph(spark, d)
    s = n.where("fn % 17 = 5")
    return p.join(s, p.src == s.fn, "left_semi").unionByName(p.join(s, p.dst == s.fn, "left_semi")).distinct()


@query("status_rollup", "SELECT coalesce(status, 'total') AS status, count(*) AS n, sum(blocks)::BIGINT AS blocks FROM (SELECT CASE WHEN c > 70 THEN 'error:max-visits' WHEN c < 60 THEN 'skip:no-move' ELSE 'ok' END AS status, c AS blocks FROM (SELECT user_id, count(*) AS c FROM events GROUP BY user_id)) GROUP BY ROLLUP (status)")
def _(spark, d):
    c = dv.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("blocks"))
    status = F.when(F.col("blocks") > 70, "error:max-visits").when(F.col("blocks") < 60, "skip:no-move").otherwise("ok")
    return c.withColumn("status", status).rollup("status").agg(F.count(F.lit(1)).alias("n"), F.sum("blocks").alias("blocks")).withColumn("status", F.coalesce("status", F.lit("total")))


@query("call_kind_totals", "WITH kinds(kind) AS (VALUES ('Function'), ('ObjCMethod'), ('Block'), ('Destructor'), ('Constructor'), ('InheritedConstructor'), ('Allocator'), ('Deallocator')), u AS (SELECT CASE event_type WHEN 'click' THEN 'Function' WHEN 'view' THEN 'Constructor' WHEN 'purchase' THEN 'Allocator' WHEN 'error' THEN 'Destructor' ELSE 'Block' END AS kind FROM events) SELECT kinds.kind, count(u.kind) AS n FROM kinds LEFT JOIN u ON u.kind = kinds.kind GROUP BY kinds.kind")
def _(spark, d):
    # The eight kinds of calls.
    kinds = spark.createDataFrame([(k,) for k in ("Function", "ObjCMethod", "Block", "Destructor", "Constructor", "InheritedConstructor", "Allocator", "Deallocator")], "kind string")
    names = {"click": "Function", "view": "Constructor", "purchase": "Allocator", "error": "Destructor"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("event_type")], F.lit("Block"))
    counts = dv.table(spark, d, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("c"))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@query("occurrence_dedupe", "SELECT l_suppkey AS caller, l_partkey % 50 AS callee, l_linenumber::BIGINT AS line, bool_or(l_returnflag = 'R') AS dyn, bool_or(l_linestatus = 'O') AS impl, bool_and(l_tax > 0.04) AS no_rel_call FROM lineitem GROUP BY ALL")
def _(spark, d):
    o = dv.table(spark, d, "lineitem")
    return o.groupBy(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 50).alias("callee"), F.col("l_linenumber").cast("long").alias("line")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("dyn"), F.bool_or(F.col("l_linestatus") == "O").alias("impl"), F.bool_and(F.col("l_tax") > 0.04).alias("no_rel_call"))


@query("text_normalise", "WITH t AS (SELECT p_partkey AS id, rtrim(regexp_replace(replace(p_name || ' ' || p_type || ' ;', chr(10), ' '), ' +', ' ', 'g'), ' ;') AS s FROM part) SELECT id, CASE WHEN length(s) > 24 THEN substr(s, 1, 21) || '...' ELSE s END AS text, CASE WHEN instr(s, ' ') > 0 THEN '\"' || s || '\"' ELSE s END AS quoted FROM t")
def _(spark, d):
    s = F.rtrim(F.regexp_replace(F.translate(F.concat("p_name", F.lit(" "), "p_type", F.lit(" ;")), "\n", " "), " +", " "), F.lit(" ;"))
    t = dv.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s"))
    return t.select("id", F.when(F.length("s") > 24, F.concat(F.substring("s", 1, 21), F.lit("..."))).otherwise(F.col("s")).alias("text"), F.when(F.instr("s", " ") > 0, F.concat(F.lit('"'), "s", F.lit('"'))).otherwise(F.col("s")).alias("quoted"))


@query("incremental_growth", "WITH f AS (SELECT l_orderkey AS fn, min(l_partkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY l_orderkey) SELECT fn, first, row_number() OVER (ORDER BY first, fn) AS size FROM f")
def _(spark, d):
    """How many functions are known when each is first mentioned: sites shrink to one row per function, which are numbered without being gathered."""
    first = units(spark, d).groupBy(F.col("src").alias("fn")).agg(F.min(F.col("line") * 10 + F.col("col")).alias("first"))
    return fx.numbered(first, ["first", "fn"], "size")
