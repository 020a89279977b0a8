"""Questions between functions: sinks, call strings, targets of indirect calls, and the merge of several units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import digraph as dg
from graphloom.plans import fixpoint as fx

#: Contexts beyond which call strings are refused.
MAX_CONTEXTS = 5000
class TooManyContexts(Exception):
    pass


def escapes(edges: dict[int, list[int]], last: int, gone: set[int]) -> bool:
    """Does control get from block 0 to the last without the blocks that are gone?"""
    seen, work = {0}, [0]
    while work:
        for b in edges.get(work.pop(), ()):
            if b == last:
                return True
            if b not in seen and b not in gone:
                seen.add(b)
                work.append(b)
    return False


def always_whole(ns: list, es: list, ends: set) -> list[tuple]:
    """Rounds from the sinks over callers: (function, round) of those that always end in one. es: (fn, callee, block, 0) and (fn, fn, a, b) with b > 0 for control flow."""
    flow: dict[int, dict[int, list[int]]] = {}
    called: dict[int, dict[int, set[int]]] = {}
    callers: dict[int, set[int]] = {}
    for fn, callee, a, b in es:
        if b:
            flow.setdefault(fn, {}).setdefault(a, []).append(b)
        else:
            called.setdefault(fn, {}).setdefault(callee, set()).add(a)
            callers.setdefault(callee, set()).add(fn)
    last = {fn: max(b for bs in g.values() for b in bs) for fn, g in flow.items()}
    level, front, n = dict.fromkeys(sorted(ends), 0), set(ends), 0
    while front:
        n += 1
        asked = {c for f in front for c in callers.get(f, ()) if c not in level}
        front = {f for f in asked if not escapes(flow[f], last[f], {b for callee, bs in called[f].items() if callee in level for b in bs})}
        level.update(dict.fromkeys(front, n))
    return list(level.items())


def always(nodes: DataFrame, calls: DataFrame, flow: DataFrame, sinks: DataFrame, small: bool | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(fn, round): functions that always end in a sink, and when that is known: a sink at once; another when control can't get to its exit without the blocks that call such functions.

    calls: (fn, block, dst), flow: (fn, a, b) between blocks, from 0 to the exit, which has the highest number. A graph of checked size takes one
    kernel; of a larger one each round asks only functions that call one just found, each on its own.
    """
    ends = sinks.select("fn").distinct()
    if fx.is_small(flow) if small is None else small:
        es = calls.select(F.col("fn").alias("src"), "dst", F.col("block").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(flow.select(F.col("fn").alias("src"), F.col("fn").alias("dst"), "a", "b"))
        return fx.on_whole(nodes, es, always_whole, "fn long, round long", ends)
    seen = front = fx.written(ends.select("fn", F.lit(0).cast("long").alias("round")))

    def of(fn: int, rows) -> list[tuple]:
        edges: dict[int, list[int]] = {}
        for kind, x, y in zip(rows.kind, rows.a, rows.b, strict=True):
            if kind == "e":
                edges.setdefault(int(x), []).append(int(y))
        gone = {int(x) for kind, x in zip(rows.kind, rows.a, strict=True) if kind == "g"}
        return [] if escapes(edges, max(b for bs in edges.values() for b in bs), gone) else [(fn,)]

    for n in range(1, max_rounds):
        asked = calls.join(front.select(F.col("fn").alias("dst")), "dst", "left_semi").select("fn").distinct().join(seen, "fn", "left_anti")
        gone = calls.join(seen.select(F.col("fn").alias("dst")), "dst", "left_semi").select("fn", F.lit("g").alias("kind"), F.col("block").alias("a"), F.lit(0).cast("long").alias("b"))
        rows = flow.select("fn", F.lit("e").alias("kind"), "a", "b").unionByName(gone).join(asked, "fn", "left_semi")
        front = fx.written(fx.per_function(rows, of, "fn long").withColumn("round", F.lit(n).cast("long")))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def sink_rounds(nodes: DataFrame, calls: DataFrame, flow: DataFrame, sinks: DataFrame, small: bool | None = None) -> DataFrame:
    """(fn, may, always): the round in which each function is known to end in a sink on some way, and on all; null: never."""

    def whole(ns: list, es: list, ends: set) -> list[tuple]:
        callers = dg.graph(ns, [(callee, fn) for fn, callee, _, b in es if not b])
        may, always = dg.levels(callers, sorted(ends)), dict(always_whole(ns, es, ends))
        return [(n, may.get(n, -1), always.get(n, -1)) for n in ns]

    def rounds(nodes: DataFrame, es: DataFrame, ends: DataFrame) -> DataFrame:
        own, ways = es.where("b = 0").select(F.col("src").alias("fn"), F.col("a").alias("block"), "dst"), es.where("b > 0").select(F.col("src").alias("fn"), "a", "b")
        pairs = fx.written(own.select(F.col("fn").alias("src"), "dst").distinct())
        may = fx.levels(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends.select("fn"))
        both = nodes.join(may.withColumnRenamed("level", "may"), "fn", "left").join(always(nodes, own, ways, ends, False).withColumnRenamed("round", "always"), "fn", "left")
        return both.select("fn", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("may", "always")))

    es = calls.select(F.col("fn").alias("src"), "dst", F.col("block").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(flow.where("b > 0").select(F.col("fn").alias("src"), F.col("fn").alias("dst"), "a", "b"))
    found = fx.solved(nodes, es, whole, "fn long, may long, always long", rounds, small, fx.chosen(nodes, sinks).distinct())
    return found.select("fn", *(F.nullif(c, F.lit(-1).cast("long")).alias(c) for c in ("may", "always")))


def sink_levels(rounds: DataFrame) -> DataFrame:
    """(fn, level, iter) from sink_rounds: always, may or none, and the round in which that was settled."""
    level = F.when(F.col("always").isNotNull(), "always").when(F.col("may").isNotNull(), "may").otherwise("none")
    return rounds.select("fn", level.alias("level"), F.coalesce("always", "may", F.lit(0)).cast("long").alias("iter"))


def sink_trace(rounds: DataFrame) -> DataFrame:
    """(fn, pass, value): what is known of each function after each pass that changed it."""
    may = rounds.where("may IS NOT NULL AND (always IS NULL OR always > may)").select("fn", F.col("may").alias("pass"), F.lit("may").alias("value"))
    return may.unionByName(rounds.where("always IS NOT NULL").select("fn", F.col("always").alias("pass"), F.lit("always").alias("value")))


def sink_chains(pairs: DataFrame, distance: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(fn, via, len, chain) from (fn, level), the distances to the nearest sink: the smallest callee that is nearer, and with it the whole chain, built up from the sinks a level at a time."""
    d = fx.written(distance)
    nearer = pairs.join(d.select(F.col("fn").alias("src"), F.col("level").alias("own")), "src").join(d.select(F.col("fn").alias("dst"), "level"), "dst").where("level = own - 1")
    via = fx.written(nearer.groupBy(F.col("src").alias("fn"), F.col("own").alias("len")).agg(F.min("dst").alias("via")))
    front = fx.written(d.where("level = 0").select("fn", F.lit(None).cast("long").alias("via"), F.lit(0).cast("long").alias("len"), F.col("fn").cast("string").alias("chain")))
    out = front
    for n in range(1, max_rounds):
        front = via.where(F.col("len") == n).join(front.select(F.col("fn").alias("via"), "chain"), "via").select("fn", "via", "len", F.concat_ws(">", F.col("fn").cast("string"), "chain").alias("chain"))
        front = fx.written(front)
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def context_edges(contexts: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """(src, src_string, dst, dst_string): which context each call site leads each context to."""
    step = sites.select("src", "dst", site_name().alias("site")).distinct()
    string = F.concat("string", F.array("site"))
    cut = F.when(F.size(string) > k, F.slice(string, F.size(string) - k + 1, k)).otherwise(string) if k else F.array().cast("array<string>")
    return contexts.join(step, contexts.fn == step.src).select("src", F.array_join("string", " ").alias("src_string"), "dst", F.array_join(cut, " ").alias("dst_string"))


def site_name() -> Column:
    return F.concat_ws(":", F.col("src").cast("string"), F.col("line").cast("string"), F.col("col").cast("string"))


def inlined(sites: DataFrame, entries: DataFrame, bodies: DataFrame, depth: int) -> DataFrame:
    """(entry, path, depth, verdict): each call met from the entries, and whether its body is taken in: else the first reason that holds of no body, recursion, arguments that don't fit (fits is false) and no depth left."""
    has = bodies.select(F.col("fn").alias("dst"), F.lit(True).alias("body"))
    step = fx.written(sites.select("src", "dst", "fits").distinct().join(has, "dst", "left"))
    front = entries.select(F.col("fn").alias("entry"), F.array("fn").alias("chain"))
    out = None
    for n in range(depth + 1):
        met = front.join(step, F.element_at("chain", -1) == F.col("src"))
        verdict = F.when(F.col("body").isNull(), "no body").when(F.array_contains("chain", F.col("dst")), "recursion").when(~F.col("fits"), "arguments").when(F.lit(n == depth), "depth").otherwise("inlined")
        met = met.select("entry", F.concat("chain", F.array("dst")).alias("chain"), verdict.alias("verdict"))
        rows = met.select("entry", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("path"), F.lit(n).cast("long").alias("depth"), "verdict")
        out = rows if out is None else out.unionByName(rows)
        front = met.where("verdict = 'inlined'").select("entry", "chain").distinct()
    return out


def resolved(sites: DataFrame, rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """(site, rule, target): the targets that the first rule with any gives each site; a site that none resolves has rule unresolved. rules: name and (site, target), the strongest first."""
    found = None
    for k, (name, targets) in enumerate(rules):
        one = targets.select("site", "target", F.lit(k).alias("k"), F.lit(name).alias("rule"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("site").agg(F.min("k").alias("k"))
    return sites.select("site").distinct().join(found.join(best, ["site", "k"]).distinct(), "site", "left").select("site", F.coalesce("rule", F.lit("unresolved")).alias("rule"), "target")


def contexts(nodes: DataFrame, sites: DataFrame, entries: DataFrame, k: int, limit: int | None = MAX_CONTEXTS) -> DataFrame:
    """(fn, string, value): the at most k latest call sites by which a function is reached, and what its argument may be.

    A set-oriented fixpoint: contexts meet call edges, strings are cut to k, values of equal contexts join (bit 1 zero, bit 2 not zero), and only
    contexts whose value grew are extended. More than limit contexts, if there is one, are refused. The argument of a site is zero, not zero or the caller's own by its column modulo 3.
    """
    step = sites.select("src", "dst", site_name().alias("site"), (F.col("col") % 3).alias("arg")).distinct()
    seen = front = fx.written(entries.select("fn", F.array().cast("array<string>").alias("string"), F.lit(3).alias("value")).distinct())
    known, rounds = seen.count() if limit is not None else 0, 0
    while True:
        if limit is not None and known > limit:
            raise TooManyContexts(f"more than {limit} contexts")
        called = front.join(step, front.fn == step.src)
        string = F.concat("string", F.array("site"))
        cut = F.when(F.size(string) > k, F.slice(string, F.size(string) - k + 1, k)).otherwise(string) if k else F.array().cast("array<string>")
        value = F.when(F.col("arg") == 0, 1).when(F.col("arg") == 1, 2).otherwise(F.col("value"))
        offered = called.select(F.col("dst").alias("fn"), cut.alias("string"), value.alias("value")).groupBy("fn", "string").agg(F.bit_or("value").alias("value"))
        both = offered.join(seen.groupBy("fn", "string").agg(F.bit_or("value").alias("old")), ["fn", "string"], "left").select("fn", "string", "old", F.col("value").bitwiseOR(F.coalesce("old", F.lit(0))).cast("int").alias("value"))
        front = fx.written(both.where("old IS NULL OR old <> value"))
        new, changed = front.agg(F.count(F.when(F.col("old").isNull(), 1)), F.count(F.lit(1))).first()
        known, front, rounds = known + new, front.drop("old"), rounds + 1
        if not changed:
            return seen.groupBy("fn", "string").agg(F.bit_or("value").alias("value"))
        seen = seen.unionByName(front)  # each context comes again only when its value grew, three times at most
        if rounds % 8 == 0:  # files of many rounds as one
            seen = fx.written(seen.groupBy("fn", "string").agg(F.bit_or("value").alias("value")))


def descendants(base: DataFrame) -> DataFrame:
    """(sup, sub) of the reflexive closure of (sub, sup)."""
    own = base.select(F.col("sub").alias("sup"), "sub").union(base.select("sup", F.col("sup").alias("sub"))).distinct()
    deep = fx.closure(base.select(F.col("sup").alias("src"), F.col("sub").alias("dst")))
    return own.union(deep.select(F.col("src").alias("sup"), F.col("dst").alias("sub"))).distinct()


def resolve_pointers(sites: DataFrame, taken: DataFrame) -> DataFrame:
    """Each call through a pointer, with every function of its type whose address is taken: (site, target), each pair once. Pairs can repeat only where a site has several types, so that others, of which there may be very many, aren't compared."""
    typed = sites.groupBy("site").agg(F.collect_set("fn_type").alias("types"))
    to = taken.select("target", "fn_type").distinct()
    pairs = lambda some: typed.where(some).select("site", F.explode("types").alias("fn_type")).join(to, "fn_type").select("site", "target")
    return pairs(F.size("types") == 1).unionByName(pairs(F.size("types") > 1).distinct())


def resolve_virtual(sites: DataFrame, tree: DataFrame, classes: DataFrame, instantiated: DataFrame | None = None) -> DataFrame:
    """Each virtual call with the concrete classes at or below its static one; with instantiated, only those that are ever made."""
    concrete = classes.where("NOT abstract").select(F.col("class").alias("sub"))
    if instantiated is not None:
        concrete = concrete.join(instantiated.select(F.col("class").alias("sub")), "sub", "left_semi")
    return sites.join(tree, sites.static_class == tree.sup).join(concrete, "sub", "left_semi").select("site", F.col("sub").alias("target"))


def with_members(made: DataFrame, members: DataFrame) -> DataFrame:
    """(class): those made, and all that they hold by value, members (class, part), however deep."""
    deep = fx.closure(members.select(F.col("class").alias("src"), F.col("part").alias("dst")))
    return made.select("class").union(deep.join(made.select(F.col("class").alias("src")), "src", "left_semi").select("dst")).distinct()


def merge(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all units by key, from sites with a unit `tu`.

    A function is defined in the units where it calls. (key, def, def_tus, seen_tus) and (src, dst, line, col, xtu): an edge goes across units when its
    callee is defined, and not in one of those that saw the edge.
    """
    seen = sites.select(F.col("src").alias("key"), "tu", F.lit(True).alias("def")).union(sites.select(F.col("dst").alias("key"), "tu", F.lit(False).alias("def")))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    nodes = seen.groupBy("key").agg(F.bool_or("def").alias("def"), names(F.when(F.col("def"), F.col("tu"))).alias("def_tus"), names("tu").alias("seen_tus"))
    defined = sites.select(F.col("src").alias("dst"), "tu").distinct().withColumn("here", F.lit(True))
    anywhere = defined.select("dst").distinct().withColumn("known", F.lit(True))
    across = sites.join(defined, ["dst", "tu"], "left").join(anywhere, "dst", "left")
    edges = across.groupBy("src", "dst", "line", "col").agg((F.bool_or(F.col("here").isNull()) & F.bool_or(F.col("known").isNotNull())).alias("xtu"))
    return nodes, edges


def unique_names(nodes: DataFrame) -> DataFrame:
    """(fn, name) from (fn, base, signature, line): the base name; with its signature if that is not unique; then with its line; then numbered in order of source."""
    n = nodes.withColumn("name", F.col("base"))
    several = lambda rows: rows.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("name", F.lit(True).alias("again"))
    for longer in (F.concat("name", F.lit("("), "signature", F.lit(")")), F.concat("name", F.lit("@L"), F.col("line").cast("string"))):
        n = n.join(several(n), "name", "left").withColumn("name", F.when(F.col("again"), longer).otherwise(F.col("name"))).drop("again")
    counted = fx.numbered(n, ["line", "fn"], "number", ["name"])
    return counted.join(several(n), "name", "left").select("fn", F.when(F.col("again"), F.concat("name", F.lit("#"), F.col("number").cast("string"))).otherwise(F.col("name")).alias("name"))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, both, only_a, only_b): how often each key occurs in common and beyond."""
    counts = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return counts.select(*keys, F.least("x", "y").alias("both"), F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("only_a"), F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("only_b"))


def match_one_to_one(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, verdict): the n-th finding of a key takes the n-th expectation; verdict is matched, unexpected or missing."""
    number = lambda d, c: d.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(c)).cast("long").alias("n"))
    a, b = number(found, "id").withColumn("found", F.lit(True)), number(expected, "id").withColumn("expected", F.lit(True))
    verdict = F.when(F.col("found") & F.col("expected"), "matched").when(F.col("found"), "unexpected").otherwise("missing")
    return a.join(b, [*keys, "n"], "full").select(*keys, "n", verdict.alias("verdict"))


def classify_sites(elements: DataFrame, edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(site, class): resolved if a graph edge has it; else why not: no declaration, no node, or no edge."""
    e = edges.select("site").distinct().withColumn("edge", F.lit(True))
    f = functions.select(F.col("fn").alias("callee")).distinct().withColumn("node", F.lit(True))
    out = elements.join(e, "site", "left").join(f, "callee", "left")
    return out.select("site", F.when(F.col("callee").isNull(), "missing:indirect").when(F.col("edge"), "resolved").when(F.col("node").isNull(), "missing:node").otherwise("missing:edge").alias("class"))
