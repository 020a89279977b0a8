"""Selections and projections of call graphs and control-flow graphs, all of them expressions over rows or kernels over one function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import digraph as dg
from graphloom.operators.cfg import Function, each
from graphloom.plans import fixpoint as fx

#: The root that calls every function, where one is asked for.
ROOT = -2


def of_function(edges: DataFrame, name: Column) -> DataFrame:
    return edges.where(F.col("src") == name)


def of_unit(sites: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (fn, kind) and edges of one unit: functions that call there, what they call directly, and their calls."""
    own = sites.where(F.col("tu") == unit)
    seen = own.select(F.col("src").alias("fn"), F.lit(True).alias("def")).union(own.select(F.col("dst").alias("fn"), F.lit(False).alias("def")))
    nodes = seen.groupBy("fn").agg(F.when(F.bool_or("def"), "def").otherwise("callee").alias("kind"))
    return nodes, own.select("src", "dst").distinct()


def with_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) and an edge from the root to every node."""
    return edges.select("src", "dst").unionByName(nodes.select(F.lit(ROOT).cast("long").alias("src"), F.col("fn").alias("dst")))


def provenance(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """(fn, door): why a node is there: it calls (def), is called (callee), or neither (block)."""
    ends = sites.select(F.col("src").alias("fn"), F.lit(2).alias("k")).union(sites.select(F.col("dst").alias("fn"), F.lit(1).alias("k"))).union(nodes.select("fn", F.lit(0).alias("k")))
    return ends.groupBy("fn").agg(F.element_at(F.array(*map(F.lit, ("block", "callee", "def"))), F.max("k") + 1).alias("door"))


def node_kinds(nodes: DataFrame, sites: DataFrame, external: int, entry: str) -> DataFrame:
    """(fn, kind): the first that fits of external, declaration (calls nothing), entry, self-recursive and plain."""
    own = sites.groupBy(F.col("src").alias("fn")).agg(F.bool_or(F.col("src") == F.col("dst")).alias("again"))
    kind = F.when(F.col("fn") == external, "external").when(F.col("again").isNull(), "declaration").when(F.expr(entry), "entry").when(F.col("again"), "self-recursive").otherwise("plain")
    return nodes.join(own, "fn", "left").select("fn", kind.alias("kind"))


def node_ranks(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """(fn, by_name, by_source): places of the nodes in order of name and of first mention; those never mentioned come last."""
    first = sites.groupBy(F.col("src").alias("fn")).agg(F.min(F.struct("line", "col")).alias("at"))
    rows = nodes.join(first, "fn", "left").select("fn", F.col("fn").cast("string").alias("name"), F.col("at").isNull().alias("lacks"), F.col("at.line").alias("line"), F.col("at.col").alias("col"))
    return fx.numbered(fx.numbered(rows, ["name"], "by_name"), ["lacks", "line", "col", "fn"], "by_source").select("fn", "by_name", "by_source")


def edge_ranks(sites: DataFrame) -> DataFrame:
    """Distinct call sites with their places among those of their caller, by callee and by source."""
    own = Window.partitionBy("src")
    place = lambda *c: F.row_number().over(own.orderBy(*c)).cast("long")
    return sites.select("src", "dst", "line", "col").distinct().select("*", place("dst", "line", "col").alias("by_callee"), place("line", "col", "dst").alias("by_source"))


def in_groups(blocks: DataFrame, groups: dict[str, list[str]], wanted: list[str]) -> DataFrame:
    """(name, kind, elements, functions) of the kinds in the wanted groups. The groups are a handful of names."""
    spark = blocks.sparkSession
    names = spark.createDataFrame([(g, k) for g in wanted for k in groups[g]], "name string, kind string")
    return blocks.join(F.broadcast(names), blocks.et == names.kind).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("elements"), F.countDistinct("fn").alias("functions"))


def details(blocks: DataFrame) -> DataFrame:
    """(fn, b, detail): what each element does, by its kind."""
    var = F.concat(F.lit("x"), F.coalesce(F.col("v").cast("string"), F.lit("?")))
    text = F.when(F.col("et") == "signup", F.concat(F.lit("init "), var)).when(F.col("et") == "purchase", F.concat(F.lit("give "), var)).when(F.col("et") == "click", F.concat(F.lit("read "), var)).when(F.col("et") == "view", F.concat(F.lit("if "), var)).otherwise(F.concat(F.lit("goto B"), F.greatest(F.col("b") - 4, F.lit(1)).cast("string")))
    return blocks.select("fn", "b", text.alias("detail"))


def terminators(blocks: DataFrame) -> DataFrame:
    """(fn, b, kind, condition, target) of the blocks that end in a branch or a jump."""
    branch = F.col("et") == "view"
    return blocks.where(F.col("et").isin("view", "error")).select("fn", "b", F.when(branch, "if").otherwise("goto").alias("kind"), F.when(branch, F.concat(F.lit("x"), F.col("v").cast("string"))).alias("condition"), F.when(branch, F.least(F.col("b") + 3, "n")).otherwise(F.greatest(F.col("b") - 4, F.lit(1))).alias("target"))


#: How statements come to a block, the strongest first.
REASONS = {"view": "terminator", "error": "label", "click": "element", "purchase": "element"}


def statement_blocks(blocks: DataFrame) -> DataFrame:
    """(fn, stmt, reason, block): the block that holds each statement, or the one that holds the nearest statement around it (here b // 2 is around b); block is null where there is none."""
    reason = F.coalesce(F.create_map(*[F.lit(x) for p in REASONS.items() for x in p])[F.col("et")], F.lit(""))
    facts = blocks.select("fn", reason.alias("kind"), F.col("b").alias("a"), F.floor(F.col("b") / 2).alias("b"))

    def of(_: int, rows) -> list[tuple]:
        own = {int(a): k for k, a in zip(rows.kind, rows.a, strict=True)}
        up = dict(zip(map(int, rows.a), map(int, rows.b), strict=True))
        out = []
        for s in own:
            at = s
            while at and not own[at]:
                at = up[at]
            out.append((_, s, own[s] or ("ancestor" if at else "none"), at or None))
        return out

    found = fx.per_function(facts, of, "fn long, stmt long, reason string, block double")
    return found.withColumn("block", F.when(~F.isnan("block"), F.col("block").cast("long")))


def forced(blocks: DataFrame, elements: list[str], kind: str) -> DataFrame:
    """(fn, before, after, first_block): elements of a function without and with a kind that is forced in, and the first block where one lands."""
    is_ = F.col("et") == kind
    return blocks.groupBy("fn").agg(F.count(F.when(F.col("et").isin(elements), 1)).alias("before"), F.count(F.when(F.col("et").isin(elements) | is_, 1)).alias("after"), F.min(F.when(is_, F.col("b"))).alias("first_block"))


def presets(blocks: DataFrame, options: DataFrame, names: list[str]) -> DataFrame:
    """(kind, a column for each preset): elements of each kind that a scan with the preset's options gives. options: (preset, kind, keep)."""
    counts = blocks.groupBy(F.col("et").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(options.where("keep")), "kind").groupBy("kind").pivot("preset", names).agg(F.sum("n")).na.fill(0)


def edge_totals(edges: DataFrame) -> DataFrame:
    """(fn, total, reachable, pruned) from (fn, s, d, reachable)."""
    return edges.groupBy("fn").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("reachable"), 1)).alias("reachable"), F.count(F.when(~F.col("reachable"), 1)).alias("pruned"))


def dead(facts: DataFrame) -> DataFrame:
    """(fn, b): blocks that no order from the entry holds."""

    def of(f: Function) -> list[tuple]:
        live = dg.levels(f.g, [f.entry])
        return [(b,) for b in f.g if b not in live]

    return each(facts, of, "b long")


#: Kinds of code that isn't reached, by what it begins with.
UNREACHED = {"purchase": "Return", "view": "Break", "error": "LoopIncrement"}


def unreachable_code(facts: DataFrame) -> DataFrame:
    """(fn, b, kind): where code that isn't reached begins: dead blocks that only reached ones, or themselves, precede."""

    def of(f: Function) -> list[tuple]:
        live, before = dg.levels(f.g, [f.entry]), dg.reverse(f.g)
        return [(b, UNREACHED.get(f.kind[b], "Other")) for b in f.g if b not in live and all(p in live or p == b for p in before[b])]

    return each(facts, of, "b long, kind string")


def has_state(facts: DataFrame) -> DataFrame:
    """(fn, b, values): how many variables have a value at each block's beginning; null where no state arrives."""
    from graphloom.operators.cfg import df, instructions

    def of(f: Function) -> list[tuple]:
        code = instructions(f)
        before, _, _ = df.fixpoint(f.g, f.entry, dict.fromkeys(map(str, f.vars), df.TOP), lambda b, s: df.run_constants(s, code.get(b, [])), df.join_constants, max_visits=None)
        return [(b, float(len(before[b])) if b in before else float("nan")) for b in f.g]

    return each(facts, of, "b long, state double").select("fn", "b", F.when(~F.isnan("state"), F.col("state").cast("long")).alias("values"))


def common_dominators(facts: DataFrame) -> DataFrame:
    """(fn, s, d, dom, pdom): of each edge's ends the nearest common dominator, and post-dominator (0: the virtual exit)."""

    def of(f: Function) -> list[tuple]:
        dom, (_, pdom, end) = f.dominators(), f.post()
        nearest = lambda sets, a, b: max(set(sets[a]) & set(sets[b]), key=lambda x: len(sets[x]))
        return [(a, b, nearest(dom, a, b), 0 if (p := nearest(pdom, a, b)) == end else p) for a in f.g for b in f.g[a]]

    return each(facts, of, "s long, d long, dom long, pdom long")


def loop_statements(facts: DataFrame) -> DataFrame:
    """(fn, loops, back_edges): statements that loop, and edges that a depth-first search finds going back."""
    return each(facts, lambda f: [(sum(k == "error" and b > 1 for b, k in f.kind.items()), len(dg.depth_first(f.g, [f.entry])[2]))], "loops long, back_edges long")


def returns_in_loops(facts: DataFrame) -> DataFrame:
    """(fn, b, headers): blocks that return out of loops, with these from the innermost."""

    def of(f: Function) -> list[tuple]:
        loops = dg.natural_loops(f.g, f.dominators())
        around = {b: sorted((len(body), h) for h, body in loops.items() if b in body) for b, k in f.kind.items() if k == "purchase"}
        return [(b, ",".join(str(h) for _, h in hs)) for b, hs in around.items() if hs]

    return each(facts, of, "b long, headers string")


def throws(blocks: DataFrame) -> DataFrame:
    """(fn, b, rethrow, target): where each throw (purchase) goes: to the first handler (error) behind the last try (signup) before it, if that handler lies behind the throw; null: it leaves the function."""
    own = Window.partitionBy("fn").orderBy("b")
    handler = F.min(F.when(F.col("et") == "error", F.col("b"))).over(own.rowsBetween(1, Window.unboundedFollowing))
    tried = F.last(F.when(F.col("et") == "signup", F.struct(F.col("handler"))), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.withColumn("handler", handler).withColumn("target", tried["handler"])
    return rows.where("et = 'purchase'").select("fn", "b", (F.col("v") % 2 == 1).alias("rethrow"), F.when(F.col("target") > F.col("b"), F.col("target")).alias("target"))


def walk(sites: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """(entry, step, depth, fn): calls from each entry in order of source, into callees down to a depth, each before what it calls itself."""
    pairs = sites.groupBy("src", "dst").agg(F.min(F.struct("line", "col")).alias("at"))
    step = fx.written(pairs.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("at", "dst")).alias("k")))
    front = entries.select(F.col("fn").alias("entry"), "fn", F.array().cast("array<int>").alias("path"))
    out = front
    for _ in range(depth):
        front = front.join(step, front.fn == step.src).select("entry", F.col("dst").alias("fn"), F.concat("path", F.array("k")).alias("path"))
        out = out.unionByName(front)
    return out.select("entry", F.row_number().over(Window.partitionBy("entry").orderBy("path")).cast("long").alias("step"), F.size("path").cast("long").alias("depth"), "fn")


def split_outside(text: str) -> tuple[str, str | None]:
    """What stands before and behind the first comma outside brackets; all of a text without one stands before it."""
    open_ = 0
    for k, c in enumerate(text):
        open_ += (c in "<(") - (c in ">)")
        if c == "," and not open_:
            return text[:k], text[k + 1 :]
    return text, None


def split_pairs(texts: Column) -> Column:
    """(a, b) of split_outside."""

    @F.pandas_udf("a string, b string")
    def of(each_: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_outside(t) for t in each_], columns=["a", "b"])

    return of(texts)


def looked_up(wanted: DataFrame, known: DataFrame, canonical: Column) -> DataFrame:
    """(key, fn, found): each key as it is given, else in canonical form, else nothing. known: (key, fn)."""
    as_given = known.select(F.col("key").alias("raw"), F.col("fn").alias("own"))
    formed = known.groupBy(canonical.alias("form")).agg(F.min("fn").alias("like"))
    rows = wanted.select("key").withColumn("form", canonical).join(as_given, F.col("key") == F.col("raw"), "left").join(formed, "form", "left")
    return rows.select("key", F.coalesce("own", "like").alias("fn"), F.when(F.col("own").isNotNull(), "as given").when(F.col("like").isNotNull(), "canonical").otherwise("none").alias("found"))
