"""Questions about a call graph: degrees, reach, components, chains, heights and their sums.

Sets and counts are declarative. Global questions take a kernel for the whole graph while its checked size allows, beyond it one for
each share of its pieces, and rounds of joins for a piece that is too large itself; all give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import digraph as dg
from graphloom.plans import fixpoint as fx


def fold(sites: DataFrame) -> DataFrame:
    """Parallel sites as one edge with their number and places."""
    place = F.struct("line", "col")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda s: F.concat_ws(":", s["line"].cast("string"), s["col"].cast("string"))), ",")
    return sites.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_sites"), text.alias("sites"))


def degrees(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct callers and callees, and all call sites. One aggregation by pair, then both ends of each pair into one by function."""
    pairs = sites.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    ends = F.array(F.struct(F.col("src").alias("fn"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("n").alias("s"), F.lit(0).alias("x")), F.struct(F.col("dst").alias("fn"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("s"), F.when(F.col("src") != F.col("dst"), 1).otherwise(0).alias("x")))
    rows = pairs.select(F.explode(ends).alias("e")).select("e.*").unionByName(nodes.select("fn", *(F.lit(0).cast(t).alias(c) for c, t in (("i", "int"), ("o", "int"), ("s", "long"), ("x", "int")))))
    return rows.groupBy("fn").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"), F.sum("s").alias("sites"), F.sum("x").alias("other_callers"))


def reach(nodes: DataFrame, edges: DataFrame, roots: DataFrame | list[int], backwards: bool = False, small: bool | None = None) -> DataFrame:
    """(fn, level) of what the roots reach, themselves at 0."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backwards else edges.select("src", "dst")
    if fx.is_small(e) if small is None else small:
        return fx.on_whole(nodes, e.distinct(), lambda ns, es, own: list(dg.levels(dg.graph(ns, es), sorted(own)).items()), "fn long, level long", fx.chosen(nodes, roots))
    return fx.levels(e, fx.chosen(nodes, roots))


def closure(nodes: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    def whole(ns: list, es: list) -> list[tuple]:
        g = dg.graph(ns, es)
        below: dict = {}
        for members in dg.components(g):  # callees first, so that each set is made once
            own = set(members) if dg.cyclic(g, members) else set()
            for m in members:
                for b in g[m]:
                    own |= below.get(b, set()) | {b}
            below.update(dict.fromkeys(members, own))
        return [(a, b) for a in g for b in below[a]]

    if fx.is_small(edges) if small is None else small:
        return fx.on_whole(nodes, edges.select("src", "dst"), whole, "src long, dst long")
    return fx.closure(edges)


def components(nodes: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    """(fn, label, size, cyclic) of nodes and ends of edges, both of which may repeat: label is the smallest member."""

    def whole(ns: list, es: list) -> list[tuple]:
        g = dg.graph(ns, es)
        return [(m, c[0], len(c), dg.cyclic(g, c)) for c in dg.components(g) for m in c]

    def rounds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        labels = fx.scc_labels(nodes, pairs)
        loops = pairs.where("src = dst").select(F.col("src").alias("fn")).withColumn("loop", F.lit(True))
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        return labels.join(sizes, "label").join(loops, "fn", "left").select("fn", "label", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))

    schema = "fn long, label long, size long, cyclic boolean"
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    if small is None:
        e = fx.written(e)
        n = e.count()
        if n > fx.WHOLE:
            return fx.components(nodes, e, n, lambda ns, es: fx.solved(ns, es.distinct(), whole, schema, rounds))
    elif not small:
        nodes = nodes.select("fn").union(e.select(F.explode(F.array("src", "dst")))).distinct()
    return fx.solved(nodes, e.distinct(), whole, schema, rounds, small is None or small)


def heights(nodes: DataFrame, edges: DataFrame, small: bool | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(fn, height): longest chain of callees; null in a cycle, which counts 1 for its callers."""

    def rounds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        parts = fx.written(components(nodes, pairs, small=False))
        done = fx.written(parts.where("cyclic").select("fn", F.lit(None).cast("long").alias("height")).unionByName(nodes.join(pairs, nodes.fn == pairs.src, "left_anti").select("fn", F.lit(0).cast("long").alias("height"))))
        rest = pairs.join(parts.where("NOT cyclic").select(F.col("fn").alias("src")), "src", "left_semi")
        for _ in range(max_rounds):
            known = rest.join(done.withColumnRenamed("fn", "dst").withColumn("known", F.lit(1)), "dst", "left")
            ready = known.groupBy(F.col("src").alias("fn")).agg(F.count(F.lit(1)).alias("n"), F.sum("known").alias("k"), F.max(F.when(F.col("known") == 1, F.coalesce(F.col("height") + 1, F.lit(1)))).alias("height")).where("n = k").select("fn", "height")
            new = fx.written(ready.join(done, "fn", "left_anti"))
            if new.isEmpty():
                return done.withColumn("height", F.coalesce("height", F.lit(-1)))
            done = done.unionByName(new)
        raise RuntimeError(f"not settled in {max_rounds} rounds")

    whole = lambda ns, es: [(n, -1 if h is None else h) for n, h in dg.heights(dg.graph(ns, es)).items()]
    return fx.solved(nodes, edges.select("src", "dst").distinct(), whole, "fn long, height long", rounds, small).withColumn("height", F.nullif("height", F.lit(-1).cast("long")))


def endless(nodes: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    """(fn, height): heights, but null for all that reach a cycle."""

    def whole(ns: list, es: list) -> list[tuple]:
        g = dg.graph(ns, es)
        out: dict = {}
        for members in dg.components(g):
            below = [-1] if dg.cyclic(g, members) else [out[b] for b in g[members[0]]]
            out.update(dict.fromkeys(members, -1 if -1 in below else max(below, default=-1) + 1))
        return list(out.items())

    def rounds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        cycles = components(nodes, pairs, small=False).where("cyclic").select("fn")
        up = reach(nodes, pairs, cycles, backwards=True, small=False).select("fn", F.lit(-1).cast("long").alias("no"))
        return heights(nodes, pairs, small=False).join(up, "fn", "left").select("fn", F.coalesce("no", "height").alias("height"))

    return fx.solved(nodes, edges.select("src", "dst").distinct(), whole, "fn long, height long", rounds, small).withColumn("height", F.nullif("height", F.lit(-1).cast("long")))


def simple_paths(edges: DataFrame, source: int, target: int, most: int) -> DataFrame:
    """(len, path) of all chains from source to target that repeat no node, of at most so many edges. Only nodes that can still arrive are entered: each has its distance to the target."""
    pairs = fx.written(edges.select("src", "dst").distinct())
    can = reach(pairs.select(F.explode(F.array("src", "dst")).alias("fn")).distinct(), pairs, [target], backwards=True).where(F.col("level") <= most)
    step = fx.written(pairs.join(can.select(F.col("fn").alias("dst"), F.col("level").alias("still")), "dst"))
    front = pairs.sparkSession.createDataFrame([(source, [source])], "at long, path array<long>")
    out = None
    for n in range(1, most + 1):
        front = front.join(step, front.at == step.src).where(~F.array_contains("path", F.col("dst")) & (F.col("still") <= most - n)).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        here = front.where(F.col("at") == target).select(F.lit(n).cast("long").alias("len"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
        out = here if out is None else out.unionByName(here)
        front = front.where(F.col("at") != target)
    return out


def recorded(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges as stored, and how many; columns after src and dst order only sites of one pair, of which one is enough."""
    e = fx.written(edges.select("src", "dst").distinct() if edges.columns[:2] == ["src", "dst"] else edges)
    return e, e.count()


def orders(nodes: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    """(fn, pre, po, rpo): depth first from a root that calls every function, in ascending order; edges in recorded order.

    A large graph is walked piece by piece. A leaf that several pieces call is in the tree of the smallest root of all that lead to it, itself included; the others pass it
    over, and each tree is numbered after all trees of smaller roots. A piece is one task's work.
    """
    e, n = recorded(edges)
    at = e.columns.index("dst")

    def trees(ns: list, es: list, gone: set = frozenset()) -> list[tuple]:
        g = dg.graph([n for n in ns if n not in gone], [(r[0], r[at]) for r in es if r[at] not in gone])
        pre, post, _ = dg.depth_first(g, [n for n in ns if n not in gone])
        place, done, out, tree = {n: k for k, n in enumerate(pre)}, 0, [], []
        for k, n in enumerate(post):  # a tree ends with its root, before which are all of its own
            tree.append(n)
            if place[n] == done:
                out += [(m, n, place[m] - done, j, len(tree)) for j, m in enumerate(tree)]
                done, tree = k + 1, []
        return out

    def leaves(ns: list, es: list) -> list[tuple]:
        callers = {r[0] for r in es}
        return [r[:2] for r in trees(ns, es) if r[0] not in callers]

    schema = "fn long, root long, pre long, po long, size long"
    if small or small is None and n <= fx.WHOLE:
        found = fx.on_whole(nodes, e, trees, schema)
    else:
        pieces = fx.Pieces(nodes, e, n).stored()
        own = fx.written(pieces.run(leaves, "fn long, root long", copies=True, keyed=True))
        first = own.groupBy("fn").agg(F.min("root").alias("first"))
        found = pieces.run(trees, schema, own.join(first, "fn").where("root > first").select("bin", "part", "fn"), copies=True)
    found = fx.written(found)
    sizes = fx.running(found.where("fn = root").select("root", "size"), "root", "size", "before")
    total = found.groupBy().agg(F.count(F.lit(1)).alias("total"))
    both = found.join(sizes.select("root", "before"), "root").crossJoin(F.broadcast(total))
    return both.select("fn", (F.col("before") + F.col("pre")).alias("pre"), (F.col("before") + F.col("po")).alias("po"), (F.col("total") - 1 - F.col("before") - F.col("po")).alias("rpo"))


def back_edges(nodes: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    """(src, dst): edges into a function that is still open in these orders. Leaves are never open, so pieces tell theirs apart; each is one task's work."""
    e, n = recorded(edges)
    at = e.columns.index("dst")
    whole = lambda ns, es: sorted(set(dg.depth_first(dg.graph(ns, [(r[0], r[at]) for r in es]), ns)[2]))
    if small or small is None and n <= fx.WHOLE:
        return fx.on_whole(nodes, e, whole, "src long, dst long")
    return fx.Pieces(nodes, e, n).run(whole, "src long, dst long")


def cycle_chains(nodes: DataFrame, edges: DataFrame, small: bool | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(label, cycle): of each cyclic component the shortest cycle through its smallest member, and of several the first by its members.

    Beyond a checked size: chains grow from each smallest member within its component, a call a round, and of those that meet at a function the first stays.
    """

    def whole(ns: list, es: list) -> list[tuple]:
        g = {n: sorted(b) for n, b in dg.graph(ns, es).items()}
        return [(c[0], ">".join(map(str, dg.shortest_chain(g, c[0], lambda x, t=c[0]: x == t, set(c).__contains__)))) for c in dg.components(g) if dg.cyclic(g, c)]

    def rounds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        parts = fx.written(components(nodes, pairs, small=False).where("cyclic").select("fn", "label"))
        own = lambda c, name: parts.select(F.col("fn").alias(c), F.col("label").alias(name))
        inside = fx.written(pairs.join(own("src", "label"), "src").join(own("dst", "other"), "dst").where("label = other").select("label", "src", "dst"))
        front = fx.written(parts.where("fn = label").select("label", F.col("fn").alias("at"), F.array("fn").alias("path")))
        seen, found = front.select("label", F.lit(None).cast("long").alias("at")), None
        for _ in range(max_rounds):
            step = front.join(inside.withColumnRenamed("src", "at"), ["label", "at"]).select("label", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
            new = fx.written(step.groupBy("label", "at").agg(F.min("path").alias("path")).join(seen, ["label", "at"], "left_anti"))
            here = new.where("at = label")
            found = here if found is None else found.unionByName(here)
            front = fx.written(new.join(found.select("label"), "label", "left_anti"))
            if front.isEmpty():
                return found.select("label", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"))
            seen = seen.unionByName(front.select("label", "at"))
        raise RuntimeError(f"not settled in {max_rounds} rounds")

    return fx.solved(nodes, edges.select("src", "dst").distinct(), whole, "label long, cycle string", rounds, small)


def shortest_cycles(nodes: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    """(label, len): how long these are."""
    return cycle_chains(nodes, edges, small).select("label", (F.size(F.split("cycle", ">")) - 1).cast("long").alias("len"))


def metrics(nodes: DataFrame, sites: DataFrame, entries: DataFrame, small: bool | None = None) -> DataFrame:
    """(fn, label, in_deg, out_deg, sites, height, leaf, root, recursive, dead): dead is what the entries (fn) don't reach. One kernel goes through the graph, or a share of its pieces; a leaf is dead if it is in each piece."""
    d = degrees(nodes, sites)

    def whole(ns: list, es: list, own: set) -> list[tuple]:
        g = dg.graph(ns, es)
        part = {m: (c[0], dg.cyclic(g, c)) for c in dg.components(g) for m in c}
        high, live = dg.heights(g), dg.levels(g, sorted(own))
        return [(n, *part[n], -1 if high[n] is None else high[n], n not in live) for n in g]

    def rounds(nodes: DataFrame, pairs: DataFrame, entries: DataFrame) -> DataFrame:
        parts = components(nodes, pairs, small=False).select("fn", "label", F.col("cyclic").alias("recursive"))
        alive = reach(nodes, pairs, entries, small=False).select("fn", F.lit(False).alias("dead"))
        return parts.join(heights(nodes, pairs, small=False), "fn").join(alive, "fn", "left").select("fn", "label", "recursive", F.coalesce("height", F.lit(-1)).alias("height"), F.coalesce("dead", F.lit(True)).alias("dead"))

    found = fx.solved(nodes, sites.select("src", "dst").distinct(), whole, "fn long, label long, recursive boolean, height long, dead boolean", rounds, small, entries, copies=True)
    found = found.groupBy("fn").agg(F.min("label").alias("label"), F.bool_or("recursive").alias("recursive"), F.nullif(F.max("height"), F.lit(-1).cast("long")).alias("height"), F.bool_and("dead").alias("dead"))
    return d.join(found, "fn").select("fn", "label", "in_deg", "out_deg", "sites", "height", (F.col("out_deg") == 0).alias("leaf"), (F.col("other_callers") == 0).alias("root"), "recursive", "dead")
