"""Program graphs derived from the test tables, from all of their rows: a call graph from lineitem, one control-flow graph per user from events.

Call graph: functions are orders, and runs of UNIT orders lie in one unit. Each row of lineitem is a call site (src, dst, line, col, ...): most call
a function a little further on in the unit, few any one in it, which makes cycles, and those of a unit's last function call EXTERNAL, which
is defined nowhere and called from every unit. Exact repetitions are parallel sites. Control-flow graphs: a function is a user, a block one of its
events in order of time; ids ascend with execution, entry is 1 and exit n. Variant "i" has skips and back jumps and is irreducible, variant
"r" has back jumps only; variant "p" is "i" without the edges that are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNIT, EXTERNAL = 40, -1
#: The same in SQL: what each oracle begins with.
CG = f"""cg AS (SELECT l_orderkey AS src, CASE WHEN l_orderkey % {UNIT} = {UNIT - 1} THEN {EXTERNAL} WHEN l_tax = 0 AND l_discount = 0 THEN l_orderkey - l_orderkey % {UNIT} + l_partkey % {UNIT} ELSE least(l_orderkey + 1 + l_partkey % 7, l_orderkey - l_orderkey % {UNIT} + {UNIT - 1}) END AS dst, l_partkey AS line, l_linenumber::BIGINT AS col, l_returnflag AS tu, l_linestatus = 'O' AS guarded FROM lineitem),
p AS (SELECT DISTINCT src, dst FROM cg), nodes AS (SELECT o_orderkey AS fn FROM orders UNION SELECT src FROM cg UNION SELECT dst FROM cg)"""
CFG = """blk AS (SELECT user_id AS fn, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS b, count(*) OVER (PARTITION BY user_id) AS n, event_type AS et, CAST(json_extract(props, '$.k') AS INT) % 8 AS v FROM events),
e AS (SELECT fn, b AS s, b + 1 AS d FROM blk WHERE b < n UNION {skip} SELECT fn, b, greatest(b - 4, 1) FROM blk WHERE et = 'error' AND b > 1)"""
SKIP = "SELECT fn, b, least(b + 3, n) FROM blk WHERE et = 'view' AND b < n UNION"
CFG_I, CFG_R = CFG.format(skip=SKIP), CFG.format(skip="")
#: Where programs begin: the first function of each unit.
ENTRY = f"fn % {UNIT} = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, line, col, tu, guarded), one row per row of lineitem."""
    o, part = F.col("l_orderkey"), F.col("l_partkey")
    base = o - o % UNIT
    dst = F.when(o % UNIT == UNIT - 1, F.lit(EXTERNAL).cast("long")).when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), base + part % UNIT).otherwise(F.least(o + 1 + part % 7, base + UNIT - 1))
    return table(spark, sf_dir, "lineitem").select(o.alias("src"), dst.alias("dst"), part.alias("line"), F.col("l_linenumber").cast("long").alias("col"), F.col("l_returnflag").alias("tu"), (F.col("l_linestatus") == "O").alias("guarded"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("src", "dst", "line", "col")


def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("src", "dst").distinct()


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn): what call_nodes has besides the ends of call sites, and more."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fn"))


def call_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn)"""
    sites = calls(spark, sf_dir)
    return functions(spark, sf_dir).union(sites.select(F.explode(F.array("src", "dst")))).distinct()


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn, b, n, et, v)"""
    own = Window.partitionBy("user_id")
    k = F.get_json_object("props", "$.k").cast("int") % 8
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("fn"), F.row_number().over(own.orderBy("ts")).cast("long").alias("b"), F.count(F.lit(1)).over(own).alias("n"), F.col("event_type").alias("et"), k.alias("v"))


def cfg_edges(blk: DataFrame, variant: str = "i") -> DataFrame:
    """(fn, s, d): one pass over the blocks, each of which gives its own edges."""
    fall = F.when(F.col("b") < F.col("n"), F.col("b") + 1)
    skip = F.when((F.col("et") == "view") & (F.col("b") < F.col("n")), F.least(F.col("b") + 3, F.col("n"))) if variant != "r" else F.lit(None).cast("long")
    back = F.when((F.col("et") == "error") & (F.col("b") > 1), F.greatest(F.col("b") - 4, F.lit(1)))
    each = F.array_distinct(F.array_compact(F.array(fall, skip, back)))
    return blk.select("fn", F.col("b").alias("s"), F.explode(each).alias("d"))


def pruned_edges(blk: DataFrame, variant: str = "i") -> DataFrame:
    """(fn, s, d, reachable): purchases of variable 0 don't return, so that nothing follows them."""
    known = blk.select("fn", F.col("b").alias("s"), ((F.col("et") == "purchase") & (F.coalesce("v", F.lit(1)) == 0)).alias("ends"))
    return cfg_edges(blk, variant).join(known, ["fn", "s"]).select("fn", "s", "d", (~(F.col("ends") & (F.col("d") == F.col("s") + 1))).alias("reachable"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn, block, dst, guarded, upto, n): the blocks of a function are its n calls in order of source. From a block control goes on to any up to upto, the next call that isn't guarded, or n + 1, the exit; a guarded call may be left out."""
    own = Window.partitionBy("src")
    rows = calls(spark, sf_dir).withColumn("block", F.row_number().over(own.orderBy("line", "col", "guarded", "dst")).cast("long")).withColumn("n", F.count(F.lit(1)).over(own))
    behind = own.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    upto = F.coalesce(F.min(F.when(~F.col("guarded"), F.col("block"))).over(behind), F.col("n") + 1)
    return rows.select(F.col("src").alias("fn"), "block", "dst", "guarded", upto.alias("upto"), "n")


def body_edges(body: DataFrame) -> DataFrame:
    """(fn, a, b): control flow between the blocks, from 0, the entry, to n + 1."""
    first = body.groupBy("fn").agg(F.coalesce(F.min(F.when(~F.col("guarded"), F.col("block"))), F.max("n") + 1).alias("upto")).select("fn", F.lit(0).cast("long").alias("block"), "upto")
    return body.select("fn", "block", "upto").unionByName(first).select("fn", F.col("block").alias("a"), F.explode(F.sequence(F.col("block") + 1, F.col("upto"))).alias("b"))


def cfg_facts(spark: SparkSession, sf_dir: str, variant: str = "i") -> DataFrame:
    """(fn, kind, a, b, x): all facts of a function in rows of one shape, so that one shuffle brings them together.

    kind: b block a of n = b and event type x; e edge a to b; u use of variable b in block a; d definition; c test of it.
    """
    blk = blocks(spark, sf_dir)
    goes_on = F.lit(True) if variant != "p" else ~((F.col("et") == "purchase") & (F.coalesce("v", F.lit(1)) == 0))
    fall = F.when((F.col("b") < F.col("n")) & goes_on, F.col("b") + 1)
    skip = F.when((F.col("et") == "view") & (F.col("b") < F.col("n")), F.least(F.col("b") + 3, F.col("n"))) if variant != "r" else F.lit(None).cast("long")
    back = F.when((F.col("et") == "error") & (F.col("b") > 1), F.greatest(F.col("b") - 4, F.lit(1)))
    edge = F.transform(F.array_distinct(F.array_compact(F.array(fall, skip, back))), lambda d: F.struct(F.lit("e").alias("kind"), F.col("b").alias("a"), d.alias("b"), F.lit("").alias("x")))
    block = F.struct(F.lit("b").alias("kind"), F.col("b").alias("a"), F.col("n").alias("b"), F.col("et").alias("x"))
    touch = F.struct(F.when(F.col("et") == "signup", "d").otherwise("u").alias("kind"), F.col("b").alias("a"), F.col("v").cast("long").alias("b"), F.lit("").alias("x"))
    test = F.when((F.col("et") == "view") & F.col("v").isNotNull(), F.array(F.struct(F.lit("c").alias("kind"), F.col("b").alias("a"), F.col("v").cast("long").alias("b"), F.lit("").alias("x")))).otherwise(F.array())
    touches = F.when(F.col("et").isin("signup", "click", "purchase") & F.col("v").isNotNull(), F.array(touch)).otherwise(F.array())
    return blk.select("fn", F.explode(F.concat(F.array(block), edge, touches, test)).alias("f")).select("fn", "f.*")
