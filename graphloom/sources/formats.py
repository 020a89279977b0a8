"""Readers and writers of the texts that program graphs are exchanged in: tab-separated blocks, JSON documents, DOT, dumps, records and markers.

Schemas are stated, never inferred. A function, unit or file is one group, and only that is ever gathered in one row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TSV = "fn string, block int, n_elements int, term_kind string, succs string"
CFG_JSON = "function string, entry int, exit int, blocks array<struct<id int, noreturn boolean, label string, loopTarget string, preds array<int>, terminator struct<kind string, stmt string, line int, text string>, succs array<struct<to int, reachable boolean, role string>>, elements array<struct<kind string, class string, text string, line int, detail string>>>>"
CG_JSON = "file string, nodes array<struct<name string, kind string, line int, scc int, po int, rpo int, recursive boolean, noreturn boolean, static boolean, usr string>>, edges array<struct<from string, to string, line int, col int, class string, kind string, back boolean>>, sccs array<struct<id int, cyclic boolean, self boolean, members array<string>>>"
MERGE_JSON = "tus array<string>, nodes array<struct<name string, key string, kind string, usr string, tus array<string>, declFile string, implicit boolean, noreturn boolean, static boolean, recursive boolean, scc int>>, edges array<struct<from string, to string, file string, path string, line int, col int, xtu boolean, back boolean>>, unresolved array<struct<name string, declIn string>>"


class BadDocument(ValueError):
    pass


# Tab-separated blocks.


def tsv_rows(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per block, from blocks (fn, block, n_elements, term_kind) and edges (fn, src, ordinal, dst); dst may be null."""
    out = edges.where("dst IS NOT NULL").groupBy("fn", F.col("src").alias("block")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "dst"))).alias("s"))
    rows = blocks.join(out, ["fn", "block"], "left")
    succs = F.coalesce(F.array_join(F.transform("s", lambda x: x["dst"].cast("string")), ","), F.lit("-"))
    return rows.select(F.col("fn").cast("string").alias("fn"), F.col("block").cast("int").alias("block"), F.col("n_elements").cast("int").alias("n_elements"), F.coalesce("term_kind", F.lit("-")).alias("term_kind"), succs.alias("succs"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="\t")


def read_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and edges. An entry has no predecessor, an exit no successor."""
    rows = spark.read.schema(TSV).csv(path, sep="\t", mode="FAILFAST")
    edges = rows.where("succs <> '-'").select("fn", F.col("block").alias("src"), F.posexplode(F.split("succs", ",")).alias("ordinal", "d")).select("fn", "src", "ordinal", F.col("d").cast("int").alias("dst"))
    led_to = edges.select("fn", F.col("dst").alias("block")).distinct().withColumn("led_to", F.lit(True))
    blocks = rows.join(led_to, ["fn", "block"], "left").select("fn", "block", "n_elements", F.nullif("term_kind", F.lit("-")).alias("term_kind"), F.col("led_to").isNull().alias("is_entry"), (F.col("succs") == "-").alias("is_exit"))
    return blocks, edges


# One JSON document per function.


def cfg_documents(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, json) from blocks (fn, block, is_entry, is_exit, kinds) and edges (fn, src, ordinal, dst, reachable, role)."""
    succs = edges.groupBy("fn", F.col("src").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("dst").cast("int").alias("to"), "reachable", "role"))), lambda x: F.struct(x["to"].alias("to"), x["reachable"].alias("reachable"), x["role"].alias("role"))).alias("succs"))
    preds = edges.where("reachable").groupBy("fn", F.col("dst").alias("block")).agg(F.array_sort(F.collect_list(F.col("src").cast("int"))).alias("preds"))
    b = blocks.join(succs, ["fn", "block"], "left").join(preds, ["fn", "block"], "left")
    one = F.struct(F.col("block").cast("int").alias("id"), F.transform("kinds", lambda k: F.struct(k.alias("kind"))).alias("elements"), F.lit(False).alias("noreturn"), F.coalesce("preds", F.array().cast("array<int>")).alias("preds"), F.coalesce("succs", F.array().cast("array<struct<to int, reachable boolean, role string>>")).alias("succs"))
    doc = b.groupBy("fn").agg(F.array_sort(F.collect_list(one)).alias("blocks"), F.max(F.when(F.col("is_entry"), F.col("block"))).cast("int").alias("entry"), F.max(F.when(F.col("is_exit"), F.col("block"))).cast("int").alias("exit"))
    return doc.select("fn", F.to_json(F.struct("blocks", "entry", "exit", F.col("fn").cast("string").alias("function"))).alias("json"))


def read_cfg_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, elements and edges; a pruned edge keeps its ordinal."""
    b = spark.read.schema(CFG_JSON).json(path, mode="FAILFAST").select(F.col("function").alias("fn"), "entry", "exit", F.explode("blocks").alias("b"))
    blocks = b.select("fn", F.col("b.id").alias("block"), (F.col("b.id") == F.col("entry")).alias("is_entry"), (F.col("b.id") == F.col("exit")).alias("is_exit"), F.size("b.elements").alias("n_elements"), "b.terminator", "b.label", "b.loopTarget", "b.noreturn")
    elements = b.select("fn", F.col("b.id").alias("block"), F.posexplode("b.elements").alias("idx", "e")).select("fn", "block", "idx", "e.*")
    edges = b.select("fn", F.col("b.id").alias("src"), F.posexplode("b.succs").alias("ordinal", "s")).select("fn", "src", "ordinal", F.col("s.to").alias("dst"), "s.reachable", "s.role")
    return blocks, elements, edges


# One JSON document per call graph, and per unit to be merged.


def call_graph_documents(nodes: DataFrame, edges: DataFrame, sccs: DataFrame) -> DataFrame:
    """(file, json), keys in alphabetical order. Each input has `file`; their other columns become the objects' fields."""

    def gather(df: DataFrame, name: str) -> DataFrame:
        fields = sorted(c for c in df.columns if c != "file")
        return df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    docs = gather(nodes, "nodes").join(gather(edges, "edges"), "file", "left").join(gather(sccs, "sccs"), "file", "left")
    return docs.select("file", F.to_json(F.struct("edges", "file", "nodes", "sccs")).alias("json"))


def read_call_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = spark.read.schema(CG_JSON).json(path, mode="FAILFAST")
    return tuple(docs.select("file", F.explode(c).alias("x")).select("file", "x.*") for c in ("nodes", "edges", "sccs"))


def merge_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tu, json) from nodes (tu, name, key, kind) and edges (tu, from, to, line, col)."""
    n = nodes.groupBy("tu").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "name"))).alias("nodes"))
    e = edges.groupBy("tu").agg(F.array_sort(F.collect_list(F.struct("from", "to", "line", "col"))).alias("edges"))
    return n.join(e, "tu", "left").select("tu", F.to_json(F.struct(F.coalesce("edges", F.array().cast("array<struct<from string, to string, line int, col int>>")).alias("edges"), "nodes", F.array("tu").alias("tus"))).alias("json"))


def read_merge_json(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all units, checked: every document has units, nodes and edges; covers one unit; every node has name, key and kind; edges name known nodes."""
    docs = spark.read.schema(MERGE_JSON).json(paths, mode="FAILFAST").select("*", F.input_file_name().alias("_file"))
    lacking = docs.select("_file", F.when(F.col("tus").isNull() | F.col("nodes").isNull() | F.col("edges").isNull(), "no tus, nodes or edges").when(F.size("tus") != 1, "covers several units").when(F.exists("nodes", lambda n: n["name"].isNull() | n["key"].isNull() | n["kind"].isNull()), "a node lacks name, key or kind").when(F.exists("edges", lambda e: e["from"].isNull() | e["to"].isNull() | ~F.array_contains(F.transform("nodes", lambda n: n["name"]), e["from"]) | ~F.array_contains(F.transform("nodes", lambda n: n["name"]), e["to"])), "an edge names an unknown node").alias("why")).where("why IS NOT NULL")
    first = lacking.first()
    if first:
        raise BadDocument(f"{first['_file']}: {first['why']}")
    one = docs.withColumn("tu", F.col("tus")[0])
    nodes = one.select("tu", F.explode("nodes").alias("n")).select("tu", "n.*")
    edges = one.select("tu", F.explode("edges").alias("e")).select("tu", "e.*").withColumn("path", F.coalesce("path", "file"))
    return nodes, edges


# DOT.


def dot_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def dot_id(c: Column) -> Column:
    """Plain if it is a word and no keyword."""
    plain = c.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.lower(c).isin("node", "edge", "graph", "digraph", "subgraph", "strict")
    return F.when(plain, c).otherwise(dot_quote(c))


def dot_documents(edges: DataFrame) -> DataFrame:
    """(graph, text) from edges (graph, src, dst): parallel edges as one, with their number."""
    folded = edges.groupBy("graph", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("  "), dot_id(F.col("src").cast("string")), F.lit(" -> "), dot_id(F.col("dst").cast("string")), F.when(F.col("n") > 1, F.concat(F.lit(' [xlabel="×'), F.col("n").cast("string"), F.lit('"]'))).otherwise(F.lit("")), F.lit(";"))
    g = folded.select("graph", line.alias("line")).groupBy("graph").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    return g.select("graph", F.concat(F.lit("digraph "), dot_id(F.col("graph").cast("string")), F.lit(" {\n"), "lines", F.lit("\n}")).alias("text"))


DOT_EDGE = r'^\s*("(?:[^"\\]|\\.)*"|[\w.-]+)\s*->\s*("(?:[^"\\]|\\.)*"|[\w.-]+)'


def dot_unquote(c: Column) -> Column:
    return F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(F.substr(c, F.lit(2), F.length(c) - 2), r"\\n", "\n"), r"\\(.)", "$1")).otherwise(c)


def read_dot(texts: DataFrame) -> DataFrame:
    """(graph, src, dst, n) from (graph, text)."""
    lines = texts.select("graph", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(DOT_EDGE))
    n = F.regexp_extract("l", "×(\\d+)", 1)
    return lines.select("graph", dot_unquote(F.regexp_extract("l", DOT_EDGE, 1)).alias("src"), dot_unquote(F.regexp_extract("l", DOT_EDGE, 2)).alias("dst"), F.when(n == "", F.lit(1)).otherwise(n.cast("long")).cast("long").alias("n"))


# Dumps, records, markers.


def read_block_dump(texts: DataFrame) -> DataFrame:
    """(file, block, note, elements, terminator, preds, succs) from (file, text) of printed blocks: a header carries down to the next."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("at", "l"))
    header = F.regexp_extract("l", r"^\s*\[B(\d+)", 1)
    below = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines.withColumn("block", F.last(F.nullif(header, F.lit("")).cast("int"), ignorenulls=True).over(below)).where("block IS NOT NULL")
    ids = lambda what: F.max(F.when(F.col("l").rlike(rf"^\s*{what}"), F.transform(F.regexp_extract_all("l", F.lit(r"B(\d+)"), 1), lambda x: x.cast("int"))))
    pick = lambda p: F.max(F.nullif(F.regexp_extract("l", p, 1), F.lit("")))
    return named.groupBy("file", "block").agg(pick(r"^\s*\[B\d+ \((\w+)").alias("note"), F.count(F.when(F.col("l").rlike(r"^\s*\d+: "), 1)).alias("elements"), pick(r"^\s*T: (.*)$").alias("terminator"), ids("Preds").alias("preds"), ids("Succs").alias("succs"))


def read_pairs(texts: DataFrame) -> DataFrame:
    """(file, child, parent) of `(child,parent)` in dominator and control-dependence dumps."""
    pairs = F.regexp_extract_all("text", F.lit(r"\(\d+,\d+\)"), 0)
    return texts.select("file", F.explode(pairs).alias("p")).select("file", F.regexp_extract("p", r"\((\d+),", 1).cast("int").alias("child"), F.regexp_extract("p", r",(\d+)\)", 1).cast("int").alias("parent"))


def read_call_dump(texts: DataFrame) -> DataFrame:
    """(file, caller, callee) of `Function: X calls: A B C` lines, whose names may hold spaces: at each place the longest known name counts."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for file, text in zip(pdf.file, pdf.text, strict=True):
            rows = [line.strip()[len("Function: ") :].partition(" calls:") for line in text.split("\n") if line.strip().startswith("Function: ")]
            known = {a.strip() for a, _, _ in rows}
            most = max((k.count(" ") + 1 for k in known), default=1)
            for caller, _, rest in rows:
                words = rest.split()
                at = 0
                while at < len(words):
                    n = next((n for n in range(most, 0, -1) if " ".join(words[at : at + n]) in known), 1)
                    out.append((file, caller.strip(), " ".join(words[at : at + n])))
                    at += n
        return pd.DataFrame(out, columns=["file", "caller", "callee"])

    return texts.select("file", "text").groupBy("file").applyInPandas(of, "file string, caller string, callee string")


def block_dumps(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, text): the printed blocks of each function, from blocks (fn, b, kind) and edges (fn, s, d); functions are of bounded size."""
    to = edges.groupBy("fn", F.col("s").alias("b")).agg(F.array_sort(F.collect_list("d")).alias("to"))
    succs = F.when(F.col("to").isNotNull(), F.concat(F.lit("\n   Succs ("), F.size("to").cast("string"), F.lit("): "), F.array_join(F.transform("to", lambda d: F.concat(F.lit("B"), d.cast("string"))), " "))).otherwise("")
    text = F.concat(F.lit(" [B"), F.col("b").cast("string"), F.lit("]\n   1: "), "kind", succs)
    own = blocks.join(to, ["fn", "b"], "left").groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("b", text.alias("t")))).alias("ts"))
    return own.select(F.col("fn").cast("string").alias("file"), F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("text"))


def shape_lines(edges: DataFrame) -> DataFrame:
    """(value): one line for each function, `f: 1>2,4 2>3`, from edges (fn, s, d)."""
    per = edges.groupBy("fn", "s").agg(F.array_sort(F.collect_list("d")).alias("to")).groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("s", "to"))).alias("all"))
    one = F.transform("all", lambda x: F.concat(x["s"].cast("string"), F.lit(">"), F.array_join(F.transform(x["to"], lambda d: d.cast("string")), ",")))
    return per.select(F.concat(F.col("fn").cast("string"), F.lit(": "), F.array_join(one, " ")).alias("value"))


def read_shapes(lines: DataFrame) -> DataFrame:
    """(fn, s, d) of such lines."""
    each = lines.select(F.substring_index("value", ":", 1).alias("fn"), F.explode(F.regexp_extract_all("value", F.lit(r"(\d+>[\d,]+)"), 1)).alias("x"))
    return each.select("fn", F.substring_index("x", ">", 1).cast("long").alias("s"), F.explode(F.split(F.substring_index("x", ">", -1), ",")).alias("d")).select("fn", "s", F.col("d").cast("long").alias("d"))


def record_lines(rows: DataFrame, kind: str, name: str, fields: list[str]) -> DataFrame:
    """(value): a text record for each row, `kind name field=value ...`; names with spaces are quoted, null fields left out."""
    text = F.col(name).cast("string")
    quoted = F.when(F.instr(text, " ") > 0, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    return rows.select(F.concat_ws(" ", F.lit(kind), quoted, *(F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in fields)).alias("value"))


def site_documents(sites: DataFrame) -> DataFrame:
    """(fn, json): the call sites of each function with their place, callee and class, in order of source."""
    one = F.struct("line", "col", "callee", "class")
    return sites.groupBy("fn").agg(F.array_sort(F.collect_list(one)).alias("sites")).select("fn", F.to_json(F.struct(F.col("fn").cast("string").alias("function"), "sites")).alias("json"))


SITE_JSON = "function string, sites array<struct<line bigint, col bigint, callee string, class string>>"
CONTEXT_JSON = "function string, string string, value int"


def clustered_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, text): a cluster for each function's blocks, from nodes (graph, cluster, node), and edges (graph, src, dst, label) between them."""
    own = nodes.groupBy("graph", "cluster").agg(F.array_join(F.array_sort(F.collect_list(F.concat(dot_id(F.col("node").cast("string")), F.lit(";")))), " ").alias("ns"))
    line = F.concat(F.lit("  subgraph "), dot_quote(F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))), F.lit(" { "), "ns", F.lit(" }"))
    arrow = F.concat(F.lit("  "), dot_id(F.col("src").cast("string")), F.lit(" -> "), dot_id(F.col("dst").cast("string")), F.when(F.col("label").isNotNull(), F.concat(F.lit(" [label="), dot_id(F.col("label")), F.lit("]"))).otherwise(F.lit("")), F.lit(";"))
    lines = own.select("graph", F.lit(0).alias("k"), line.alias("line")).unionByName(edges.select("graph", F.lit(1).alias("k"), arrow.alias("line")))
    per = lines.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("ls"))
    return per.select("graph", F.concat(F.lit("digraph "), dot_id(F.col("graph").cast("string")), F.lit(" {\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("text"))


def read_clusters(texts: DataFrame) -> DataFrame:
    """(graph, cluster, node) of clusters that stand on a line each."""
    lines = texts.select("graph", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(r"^\s*subgraph "))
    return lines.select("graph", F.regexp_extract("l", r'"cluster_([^"]*)"', 1).alias("cluster"), F.explode(F.regexp_extract_all("l", F.lit(r'("(?:[^"\\\\]|\\\\.)*"|[\w.-]+);'), 1)).alias("n")).select("graph", "cluster", dot_unquote(F.col("n")).alias("node"))


OCCURRENCES = "caller long, callee long, line long, dyn boolean, impl boolean, no_rel_call boolean"


def read_records(lines: DataFrame) -> DataFrame:
    """(kind, name, fields) of lines such as `metric f in=2 out=1`."""
    name = F.regexp_extract("value", r'^\S+\s+("[^"]*"|\S+)', 1)
    pairs = F.regexp_extract_all("value", F.lit(r"\s(\w+=\S+)"), 1)
    return lines.select(F.regexp_extract("value", r"^(\S+)", 1).alias("kind"), F.trim(name, F.lit('"')).alias("name"), F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring_index(p, "=", -1).alias("v")))).alias("fields"))


MARKERS = ("expect-error", "expect", "known-fp", "xfail")


def read_markers(texts: DataFrame) -> DataFrame:
    """(file, line, what, kind) of trailing `// expect: kind` comments; a comment that stands alone marks nothing."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("at", "l"))
    pattern = r"^.*?\S.*?//\s*(" + "|".join(MARKERS) + r"):\s*(.*?)\s*$"
    return lines.where(F.col("l").rlike(pattern) & ~F.col("l").rlike(r"^\s*//")).select("file", (F.col("at") + 1).alias("line"), F.regexp_extract("l", pattern, 1).alias("what"), F.regexp_extract("l", pattern, 2).alias("kind"))


def read_budgets(texts: DataFrame) -> DataFrame:
    """(file, budget) of `// budget: 120` comments; the last of a file counts."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("at", "l"))
    n = F.regexp_extract("l", r"//\s*budget:\s*(\d+)", 1)
    return lines.where(n != "").groupBy("file").agg(F.max_by(n.cast("long"), "at").alias("budget"))


def synthetic_calls(spark: SparkSession, functions: int, fanout: int, seed: int = 1, recursive: float = 0.0) -> DataFrame:
    """(src, dst): each function calls up to fanout others, by a hash of its number, and with a chance itself; any number of functions, with no state between them."""
    picks = F.transform(F.sequence(F.lit(1), F.lit(fanout)), lambda k: F.pmod(F.xxhash64(F.col("id"), k, F.lit(seed)), F.lit(functions)))
    itself = F.when(F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit("itself")), F.lit(1_000_000)) < int(recursive * 1_000_000), F.array("id")).otherwise(F.array().cast("array<bigint>"))
    return spark.range(functions).select(F.col("id").alias("src"), F.explode(F.array_distinct(F.concat(picks, itself))).alias("dst"))
