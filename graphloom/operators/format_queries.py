"""Round trips through every text format, formulas, and a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import boolean as bl
from graphloom import registry
from graphloom.operators import callgraph as cg
from graphloom.operators import cfg, checkers
from graphloom.operators import checker_queries  # noqa: F401
from graphloom.operators import views as vw
from graphloom.operators.graph_queries import I, dv, graph
from graphloom.operators.interproc_queries import CTX, units
from graphloom.plans.fixpoint import folder
from graphloom.registry import QUERIES, query
from graphloom.sources import formats as fm
from graphloom.streaming import windows


def cfg_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    blk = dv.blocks(spark, d)
    edges = dv.cfg_edges(blk).select("fn", F.col("s").alias("src"), F.col("d").alias("ordinal"), F.col("d").alias("dst"))
    return blk.select("fn", F.col("b").alias("block"), F.col("v").alias("n_elements"), F.when(F.col("et") == "view", "StmtBranch").alias("term_kind"), (F.col("b") == 1).alias("is_entry"), (F.col("b") == F.col("n")).alias("is_exit"), F.array("et").alias("kinds")), edges


@query("tsv_roundtrip", I + "x AS (SELECT 1) SELECT fn::VARCHAR AS fn, s AS src, d AS dst FROM e")
def _(spark, d):
    blocks, edges = cfg_tables(spark, d)
    path = folder(spark)
    fm.write_tsv(fm.tsv_rows(blocks, edges), path)
    return fm.read_tsv(spark, path)[1].select("fn", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query("tsv_entry_exit", I + "x AS (SELECT 1) SELECT fn::VARCHAR AS fn, b AS block, NOT EXISTS (SELECT 1 FROM e WHERE e.fn = blk.fn AND e.d = blk.b) AS is_entry, NOT EXISTS (SELECT 1 FROM e WHERE e.fn = blk.fn AND e.s = blk.b) AS is_exit FROM blk")
def _(spark, d):
    blocks, edges = cfg_tables(spark, d)
    path = folder(spark)
    fm.write_tsv(fm.tsv_rows(blocks, edges), path)
    return fm.read_tsv(spark, path)[0].select("fn", F.col("block").cast("long").alias("block"), "is_entry", "is_exit")


@query("json_roundtrip", I + "x AS (SELECT 1) SELECT fn::VARCHAR AS fn, s AS src, d AS dst, CASE WHEN d = s + 1 THEN 'T' ELSE 'F' END AS role FROM e")
def _(spark, d):
    blocks, edges = cfg_tables(spark, d)
    path = folder(spark)
    roles = edges.withColumns({"reachable": F.lit(True), "role": F.when(F.col("dst") == F.col("src") + 1, "T").otherwise("F")})
    fm.cfg_documents(blocks, roles).select("json").write.text(path)
    return fm.read_cfg_json(spark, path)[2].select("fn", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "role")


@query("json_elements", I + "x AS (SELECT 1) SELECT fn::VARCHAR AS fn, b AS block, et AS kind FROM blk")
def _(spark, d):
    blocks, edges = cfg_tables(spark, d)
    path = folder(spark)
    fm.cfg_documents(blocks, edges.withColumns({"reachable": F.lit(True), "role": F.lit("")})).select("json").write.text(path)
    return fm.read_cfg_json(spark, path)[1].select("fn", F.col("block").cast("long").alias("block"), "kind")


FILE = "(src - src % 40) // 40"


def by_file(spark, d) -> DataFrame:
    """Sites with the file that holds them, one for each unit of functions: what a document gathers doesn't grow with the table."""
    return units(spark, d).withColumn("file", F.floor(F.col("src") / dv.UNIT).cast("string"))


@query("cg_json_roundtrip", "WITH " + dv.CG + " SELECT DISTINCT (" + FILE + ")::VARCHAR AS file, src::VARCHAR AS \"from\", dst::VARCHAR AS \"to\", line, col FROM cg")
def _(spark, d):
    u = by_file(spark, d).drop("tu").distinct()
    own = u.select("file", F.explode(F.array("src", "dst")).alias("fn")).distinct()
    labels = cg.components(*graph(spark, d))
    nodes = own.join(labels, "fn").select("file", F.col("fn").cast("string").alias("name"), F.lit("def").alias("kind"), F.col("label").cast("int").alias("scc"), F.col("cyclic").alias("recursive"))
    edges = u.select("file", F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), F.lit("call").alias("kind"))
    sccs = own.join(labels, "fn").groupBy("file", F.col("label").cast("int").alias("id")).agg(F.bool_or("cyclic").alias("cyclic"), F.array_sort(F.collect_list(F.col("fn").cast("string"))).alias("members"))
    path = folder(spark)
    fm.call_graph_documents(nodes, edges, sccs).select("json").write.text(path)
    return fm.read_call_graph_json(spark, path)[1].select("file", "from", "to", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))


@query("merge_json_load", "WITH " + dv.CG + ", t AS (SELECT (" + FILE + ") || tu AS tu, src, dst FROM cg), seen AS (SELECT tu, src AS key, true AS def FROM t UNION ALL SELECT tu, dst, false FROM t) SELECT tu, key::VARCHAR AS key, CASE WHEN bool_or(def) THEN 'def' ELSE 'decl' END AS kind FROM seen GROUP BY tu, key")
def _(spark, d):
    u = by_file(spark, d).withColumn("tu", F.concat("file", "tu"))
    seen = u.select("tu", F.col("src").alias("key"), F.lit(True).alias("def")).union(u.select("tu", F.col("dst").alias("key"), F.lit(False).alias("def")))
    nodes = seen.groupBy("tu", "key").agg(F.bool_or("def").alias("def")).select("tu", F.col("key").cast("string").alias("name"), F.col("key").cast("string").alias("key"), F.when(F.col("def"), "def").otherwise("decl").alias("kind"))
    edges = u.select("tu", F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"))
    path = folder(spark)
    fm.merge_documents(nodes, edges).select("json").write.text(path)
    return fm.read_merge_json(spark, path)[0].select("tu", "key", "kind")


@query("dot_roundtrip", "WITH " + dv.CG + " SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, count(*) AS n FROM cg GROUP BY src, dst")
def _(spark, d):
    path = folder(spark)
    fm.dot_documents(by_file(spark, d).withColumnRenamed("file", "graph")).write.parquet(path)
    return fm.read_dot(spark.read.schema("graph string, text string").parquet(path)).select("src", "dst", "n")


@query("record_scan", "SELECT 'metric' AS kind, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def _(spark, d):
    lines = dv.table(spark, d, "supplier").select(F.format_string('metric "%s" nation=%d key=%d', "s_name", "s_nationkey", "s_suppkey").alias("value"))
    return fm.read_records(lines).select("kind", "name", F.col("fields")["nation"].alias("nation"))


@query("page_links", "SELECT page_id, regexp_extract(h, 'href=\"([^\"]*)\"', 1) AS target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS h FROM pages) GROUP BY ALL")
def _(spark, d):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return dv.table(spark, d, "pages").select("page_id", F.explode(hrefs).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("dump_blocks", I + "z AS (SELECT 1) SELECT blk.fn::VARCHAR AS file, b AS block, 1::BIGINT AS elements, string_agg(e.d::VARCHAR, ',' ORDER BY e.d) AS succs FROM blk LEFT JOIN e ON e.fn = blk.fn AND e.s = blk.b GROUP BY blk.fn, b")
def _(spark, d):
    blk = dv.blocks(spark, d)
    dumps = fm.block_dumps(blk.select("fn", "b", F.col("et").alias("kind")), dv.cfg_edges(blk))
    path = folder(spark)
    dumps.write.parquet(path)
    return fm.read_block_dump(spark.read.schema("file string, text string").parquet(path)).select("file", F.col("block").cast("long").alias("block"), "elements", F.array_join(F.transform("succs", lambda x: x.cast("string")), ",").alias("succs"))


@query("dump_pairs", I + "z AS (SELECT 1) SELECT fn::VARCHAR AS file, s AS child, d AS parent FROM e")
def _(spark, d):
    e = dv.cfg_edges(dv.blocks(spark, d))
    pair = F.concat(F.lit("("), F.col("s").cast("string"), F.lit(","), F.col("d").cast("string"), F.lit(")"))
    texts = e.groupBy(F.col("fn").cast("string").alias("file")).agg(F.array_join(F.collect_list(pair), " ").alias("text"))
    return fm.read_pairs(texts).select("file", F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent"))


NAME = "CASE WHEN {0} % 5 = 0 THEN 'operator f' || {0} ELSE 'f' || {0} END"


@query("dump_calls", "WITH " + dv.CG + " SELECT (" + FILE + ")::VARCHAR AS file, " + NAME.format("src") + " AS caller, " + NAME.format("dst") + " AS callee FROM p WHERE dst >= 0")
def _(spark, d):
    """Names hold a space where they can."""
    name = lambda c: F.when(F.col(c) % 5 == 0, F.concat(F.lit("operator f"), F.col(c).cast("string"))).otherwise(F.concat(F.lit("f"), F.col(c).cast("string")))
    n, p = graph(spark, d)
    calls = p.where("dst >= 0").groupBy("src").agg(F.array_join(F.collect_list(name("dst")), " ").alias("to"))
    rows = n.where("fn >= 0").join(calls, F.col("fn") == F.col("src"), "left").select(F.floor(F.col("fn") / dv.UNIT).cast("string").alias("file"), F.concat(F.lit("Function: "), name("fn"), F.lit(" calls: "), F.coalesce("to", F.lit(""))).alias("l"))
    return fm.read_call_dump(rows.groupBy("file").agg(F.array_join(F.collect_list("l"), "\n").alias("text")))


@query("shape_lines", I + "z AS (SELECT 1) SELECT fn::VARCHAR AS fn, s, d FROM e")
def _(spark, d):
    path = folder(spark)
    fm.shape_lines(dv.cfg_edges(dv.blocks(spark, d))).write.text(path)
    return fm.read_shapes(spark.read.text(path))


@query("records_roundtrip", "WITH " + dv.CG + " SELECT 'edge' AS kind, src::VARCHAR AS name, dst::VARCHAR AS \"to\", NULL AS door FROM p UNION ALL SELECT 'node', 'fn ' || fn, NULL, CASE WHEN fn IN (SELECT src FROM cg) THEN 'def' WHEN fn IN (SELECT dst FROM cg) THEN 'callee' ELSE 'block' END FROM nodes")
def _(spark, d):
    n, p = graph(spark, d)
    nodes = vw.provenance(n, dv.call_sites(spark, d)).withColumn("fn", F.concat(F.lit("fn "), F.col("fn").cast("string")))
    path = folder(spark)
    fm.record_lines(p.withColumnRenamed("dst", "to"), "edge", "src", ["to"]).unionByName(fm.record_lines(nodes, "node", "fn", ["door"])).write.text(path)
    return fm.read_records(spark.read.text(path)).select("kind", "name", F.col("fields")["to"].alias("to"), F.col("fields")["door"].alias("door"))


CLASS = "CASE WHEN dst = -1 THEN 'external' WHEN src = dst THEN 'self' ELSE 'resolved' END"


@query("site_json_roundtrip", "WITH " + dv.CG + " SELECT src::VARCHAR AS fn, line, col, dst::VARCHAR AS callee, " + CLASS + " AS class FROM cg")
def _(spark, d):
    path = folder(spark)
    kind = F.when(F.col("dst") == dv.EXTERNAL, "external").when(F.col("src") == F.col("dst"), "self").otherwise("resolved")
    fm.site_documents(dv.call_sites(spark, d).select(F.col("src").alias("fn"), "line", "col", F.col("dst").cast("string").alias("callee"), kind.alias("class"))).select("json").write.text(path)
    return spark.read.schema(fm.SITE_JSON).json(path, mode="FAILFAST").select(F.col("function").alias("fn"), F.explode("sites").alias("s")).select("fn", "s.*")


@query("context_json", "SELECT fn::VARCHAR AS \"function\", string, value FROM (" + CTX[0] + ")")
def _(spark, d):
    """A document for each context, as one function may have any number."""
    path = folder(spark)
    c = QUERIES["ctx_k0"](spark, d)
    c.select(F.to_json(F.struct(F.col("fn").cast("string").alias("function"), "string", "value")).alias("json")).write.text(path)
    return spark.read.schema(fm.CONTEXT_JSON).json(path, mode="FAILFAST")


@query("dot_clusters", I + "z AS (SELECT 1) SELECT (fn // 8)::VARCHAR AS graph, fn::VARCHAR AS cluster, fn || '.' || b AS node FROM blk")
def _(spark, d):
    blk = dv.blocks(spark, d)
    g, node = F.floor(F.col("fn") / 8).cast("string").alias("graph"), lambda c: F.concat_ws(".", F.col("fn").cast("string"), F.col(c).cast("string"))
    edges = dv.cfg_edges(blk).select(g, node("s").alias("src"), node("d").alias("dst"), F.when(F.col("d") == F.col("s") + 1, "T").otherwise("F").alias("label"))
    return fm.read_clusters(fm.clustered_dot(blk.select(g, F.col("fn").alias("cluster"), node("b").alias("node")), edges))


@query("occurrence_scan", "SELECT caller, callee, line, bool_or(dyn) AS dyn, bool_or(impl) AS impl, bool_and(no_rel_call) AS no_rel_call FROM (SELECT l_suppkey AS caller, l_partkey AS callee, l_linenumber::BIGINT AS line, l_returnflag = 'R' AS dyn, l_linestatus = 'O' AS impl, l_tax > 0.04 AS no_rel_call FROM lineitem) GROUP BY ALL")
def _(spark, d):
    """Occurrences as an index has them, written as text and read back; a place that is reported several times is one."""
    path = folder(spark)
    dv.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_returnflag") == "R").alias("dyn"), (F.col("l_linestatus") == "O").alias("impl"), (F.col("l_tax") > 0.04).alias("no_rel_call")).write.csv(path, sep="\t")
    o = spark.read.schema(fm.OCCURRENCES).csv(path, sep="\t", mode="FAILFAST")
    return o.groupBy("caller", "callee", "line").agg(F.bool_or("dyn").alias("dyn"), F.bool_or("impl").alias("impl"), F.bool_and("no_rel_call").alias("no_rel_call"))


def marked_texts(spark, d) -> DataFrame:
    """A file for each user, a line for each event; errors are expected, and the first line states a budget."""
    blk = dv.blocks(spark, d)
    line = F.concat(F.col("et"), F.lit("();"), F.when(F.col("et") == "error", F.lit(" // expect: error")).when(F.col("b") == 1, F.concat(F.lit(" // budget: "), F.col("n").cast("string"))).otherwise(""))
    return blk.groupBy(F.col("fn").cast("string").alias("file")).agg(F.array_sort(F.collect_list(F.struct("b", line.alias("l")))).alias("ls")).select("file", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text"))


@query("marker_scan", I + "z AS (SELECT 1) SELECT fn::VARCHAR AS file, b AS line, 'expect' AS what, 'error' AS kind FROM blk WHERE et = 'error'")
def _(spark, d):
    return fm.read_markers(marked_texts(spark, d)).select("file", F.col("line").cast("long").alias("line"), "what", "kind")


@query("budget_scan", I + "z AS (SELECT 1) SELECT fn::VARCHAR AS file, n AS budget FROM blk WHERE b = 1 AND et <> 'error'")
def _(spark, d):
    return fm.read_budgets(marked_texts(spark, d))


@query("synthetic_totals")
def _(spark, d):
    """Totals of a graph of 3,000 functions with three calls each, which no table holds."""
    p = fm.synthetic_calls(spark, 3000, 3, 1)
    n = spark.range(3000).withColumnRenamed("id", "fn")
    m = cg.metrics(n, p.withColumns({"line": F.lit(0), "col": F.lit(0)}), n.where("fn = 0"))
    return m.agg(F.count(F.lit(1)).alias("functions"), F.sum("out_deg").alias("edges"), F.countDistinct("label").alias("sccs"), F.count(F.when(F.col("dead"), 1)).alias("dead"), F.max(F.when(F.col("recursive"), "inf")).alias("height"))


class MovesOf:
    """The check for uses after moves as a table function: the facts of one function at a time, in any engine that speaks its SQL."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def eval(self, row) -> None:
        self.rows.append((row["fn"], row["kind"], row["a"], row["b"], row["x"]))

    def terminate(self):
        if self.rows:
            found: list[tuple] = checkers.moves_of(cfg.Function(pd.DataFrame(self.rows, columns=["fn", "kind", "a", "b", "x"]).sort_values(["kind", "a", "b"])))
            yield from ((self.rows[0][0], *r) for r in found)


@query("move_check_sql", registry.ORACLES["move_check"])
def _(spark, d):
    """The checker packaged: registered by name, and called from SQL over a view."""
    spark.udtf.register("moves_of", F.udtf(MovesOf, returnType="fn bigint, b bigint, v bigint, verdict string"))
    dv.cfg_facts(spark, d).createOrReplaceTempView("graphloom_facts")
    return spark.sql("SELECT * FROM moves_of(TABLE(graphloom_facts) PARTITION BY fn)")


# Formulas: three clauses of three literals over four names, from a part's key.


def literal(c: int, j: int) -> tuple[str, str]:
    """Name (0 to 3) and sign (1: plain) of a clause's literal, as SQL over the key k that Spark and others read alike."""
    return f"CAST(floor(k / {(c + 1) * (j + 2)}) AS BIGINT) % 4", f"CAST(floor(k / {c * 3 + j + 1}) AS BIGINT) % 2"


HOLDS = " AND ".join("(" + " OR ".join(f"(CAST(floor(a / power(2, {n})) AS BIGINT) % 2 = {s})" for n, s in (literal(c, j) for j in range(3))) + ")" for c in range(5))


def solved(limit: int):
    @F.pandas_udf("status string, steps long")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [bl.solve(bl.parse(t), limit) for t in texts]
        return pd.DataFrame({"status": [a.status for a in found], "steps": [a.steps for a in found]})

    return of


def formulas(spark, d) -> DataFrame:
    lit = lambda c, j: F.expr(f"concat(CASE WHEN {literal(c, j)[1]} = 1 THEN '' ELSE '!' END, 'x', {literal(c, j)[0]})")
    clause = lambda c: F.concat(F.lit("("), F.concat_ws(" | ", *(lit(c, j) for j in range(3))), F.lit(")"))
    return dv.table(spark, d, "part").select(F.col("p_partkey").alias("k")).select("k", F.concat_ws(" & ", *(clause(c) for c in range(5))).alias("formula"))


@query("sat_formulas", "SELECT p_partkey AS k, CASE WHEN EXISTS (SELECT 1 FROM range(16) r(a), (SELECT p_partkey AS k) WHERE " + HOLDS + ") THEN 'Satisfiable' ELSE 'Unsatisfiable' END AS status FROM part")
def _(spark, d):
    return formulas(spark, d).select("k", solved(bl.MAX_STEPS)("formula")["status"].alias("status"))


@query("sat_limited")
def _(spark, d):
    return formulas(spark, d).select("k", solved(2)("formula").alias("a")).select("k", "a.status", "a.steps")


@query("stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return windows.drained(windows.windowed_kinds(windows.arriving(spark, f"{d}/events.parquet*")), folder(spark))
