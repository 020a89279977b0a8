"""How graph questions run: one kernel per function, one for a whole graph of checked size, one for each share of a larger graph's pieces, or rounds of joins for a piece of any size.

Rounds write their state to the folder in spark.checkpoint.dir, which outlives executors and cuts lineage.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import digraph

#: Edges up to which a whole graph, or a piece of one, goes to one task; it holds some hundred bytes for each. A piece of more is answered in rounds of joins, with the same rows.
WHOLE = 1_000_000
#: Edges of the pieces that a task takes at a time.
SHARE = 100_000
#: Rows up to which a counted table is broadcast.
FEW = 100_000


@functools.cache
def local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="graphloom-")


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which goes when the session ends. Only a local master, whose executors are this machine, may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = local_root()
    path = f"{root.rstrip('/')}/graphloom-{uuid.uuid4().hex}"

    def drop() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(drop)
    return path


def written(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str, keys: list[str] | None = None) -> DataFrame:
    """rows with their number from 1 in the order of the columns, in each group of keys if there are any. Rows are dealt by ranges of the order, each range is numbered, and the ranges before it are added: no range, and no group, is one task's."""
    keys = keys or []
    by = [*keys, *order]
    own = Window.partitionBy("_range").orderBy(*by)
    dealt = written(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")  # one row for each range
    out = dealt.withColumn(name, F.row_number().over(own).cast("long")).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
    if not keys:
        return out
    out = written(out)
    first = out.groupBy(*keys).agg(F.min(name).alias("_first"))
    return out.join(first, keys).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first").select(*rows.columns, name)


def running(rows: DataFrame, order: str, size: str, name: str) -> DataFrame:
    """rows with the sum of size over all rows before them in the order of a column, dealt out as by numbered."""
    dealt = written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(size).alias("_n"))
    before = sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row for each range
    own = F.sum(size).over(Window.partitionBy("_range").orderBy(order)) - F.col(size)
    return dealt.withColumn(name, own).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def per_function(facts: DataFrame, kernel: Callable[[int, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """kernel(fn, facts of fn) gives rows; functions don't depend on one another."""
    names = [c.split()[0] for c in schema.split(", ")]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kernel(int(pdf.fn.iloc[0]), pdf.sort_values(["kind", "a", "b"])), columns=names)

    return facts.groupBy("fn").applyInPandas(of, schema)


def is_small(edges: DataFrame, limit: int | None = None) -> bool:
    limit = WHOLE if limit is None else limit
    return edges.limit(limit + 1).count() <= limit


def chosen(nodes: DataFrame, some: DataFrame | list[int]) -> DataFrame:
    """(fn) of the nodes that are among some: a DataFrame with fn, of any size, or a list."""
    return nodes.where(F.col("fn").isin(some)) if isinstance(some, list) else nodes.join(some.select("fn"), "fn", "left_semi")


def on_whole(nodes: DataFrame, edges: DataFrame, kernel: Callable[..., list[tuple]], schema: str, marked: DataFrame | None = None) -> DataFrame:
    """kernel(nodes, edges) gives rows, with marked (fn), some of the nodes, kernel(nodes, edges, marked). nodes: (fn); edges: (src, dst, ...), taken in the order of all their columns. For graphs of checked size only."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = edges.columns
    own, plain = nodes.select("fn", F.lit(False).alias("mark")), marked is None
    if not plain:
        own = own.unionByName(marked.select("fn", F.lit(True).alias("mark"))).groupBy("fn").agg(F.bool_or("mark").alias("mark"))
    rows = edges.select(F.lit(0).alias("all"), *columns).unionByName(own.select(F.lit(0).alias("all"), F.col("fn").alias("src"), "mark"), allowMissingColumns=True)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        lone = pdf.dst.isna()
        e = pdf[~lone].sort_values(columns)
        marks = [] if plain else [{int(x) for x in pdf[lone & pdf["mark"].eq(True)].src}]
        return pd.DataFrame(kernel(sorted(int(x) for x in pdf[lone].src), [tuple(int(x) for x in r) for r in e[columns].itertuples(index=False)], *marks), columns=names)

    return rows.groupBy("all").applyInPandas(of, schema)


def linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest that undirected edges a - b lead it to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the smallest node that edges between the callers of this task lead their src to, and whether dst is none of these callers."""
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    callers, a = np.unique(t["src"].to_numpy(), return_inverse=True)
    dst = t["dst"].to_numpy()
    b = np.minimum(np.searchsorted(callers, dst), len(callers) - 1)
    here = callers[b] == dst
    root = callers[linked(a[here], b[here], len(callers))[a]]
    yield from t.append_column("root", pa.array(root)).append_column("open", pa.array(~here)).to_batches(max_chunksize=10_000)


def weak_labels(edges: DataFrame, turn: int = 0) -> DataFrame:
    """(fn, piece) for each node of the undirected edges (a, b), which may be many: those connected have the same piece. Each node joins the one of its neighbours and itself that a hash puts first, until one task can hold what is left between them."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if is_small(e):

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
            at = at.reshape(-1, 2)
            return pd.DataFrame({"fn": ids, "piece": ids[linked(at[:, 0], at[:, 1], len(ids))]})

        return e.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(whole, "fn long, piece long")
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
    ends = e.select(F.col("a").alias("fn"), rank("b").alias("r")).unionByName(e.select(F.col("b").alias("fn"), rank("a").alias("r")))
    pick = written(ends.groupBy("fn").agg(F.min("r").alias("r")).select("fn", F.least("r", rank("fn"))["to"].alias("to")))
    left = e.join(pick.select(F.col("fn").alias("a"), F.col("to").alias("x")), "a").join(pick.select(F.col("fn").alias("b"), F.col("to").alias("y")), "b")
    above = weak_labels(left.select(F.col("x").alias("a"), F.col("y").alias("b")), turn + 1)
    return pick.join(above.withColumnRenamed("fn", "to"), "to", "left").select("fn", F.coalesce("piece", "to").alias("piece"))


def once(values: np.ndarray) -> np.ndarray:
    """Each value once, ascending. np.unique hashes, which takes several times as long."""
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


def told_apart(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids that rows (src, dst) name, ascending; the places of src and dst of each distinct edge among them; which ids lie between the least and the greatest src. A row without dst names a node. Repeated rows are held once."""
    held: list = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        src, dst, own = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*held, strict=True)) if held else [np.empty(0, np.int64)] * 3
        ids, at = np.unique(np.concatenate([src, dst, own]), return_inverse=True)
        code = once(at[: len(src)] * len(ids) + at[len(src) : 2 * len(src)])
        a, b = np.divmod(code, max(len(ids), 1))
        first, last = np.searchsorted(ids, [min(x.min() for x in (src, own) if len(x)), max(x.max() for x in (src, own) if len(x))]) if len(ids) else (0, 0)
        place = np.arange(len(ids))
        return ids, a, b, (place >= first) & (place <= last)

    for batch in batches:
        src, dst = batch.column("src").to_numpy(zero_copy_only=False), batch.column("dst")
        edge = np.asarray(dst.is_valid())
        held.append((src[edge], dst.drop_null().to_numpy(zero_copy_only=False), src[~edge]))
        size += len(src)
        if size > 2 * WHOLE:
            ids, a, b, near = merged()
            held, size = [(ids[a], ids[b], ids[near])], 0
    return merged()


def settled_range(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Components of rows (src, dst) whose src lie in a range that no other task has any of.

    kind 0: a node of the range, as if nothing led into the range or back to it; piece is the smallest caller that calls between callers of the range connect it with, null if it calls
    nothing. kind 1: the piece fn calls label, which lies elsewhere. kind 2: the piece fn has more than most edges and is not settled.
    """
    ids, a, b, near = told_apart(batches)
    if not len(ids):
        return
    n = len(ids)
    caller = np.bincount(a, minlength=n) > 0
    x, y = a[caller[b]], b[caller[b]]
    piece = linked(x, y, n)
    large = np.bincount(piece[a], minlength=n) > most
    loop, go = np.zeros(n, bool), (x != y) & ~large[piece[x]]
    loop[x[x == y]] = True
    label = digraph.strong(x[go], y[go], n)
    size = np.bincount(label, minlength=n)[label]
    out = once(piece[a[~near[b]]] * n + b[~near[b]])
    rows = pa.table({"kind": np.zeros(near.sum(), np.int32), "fn": ids[near], "label": ids[label[near]], "size": size[near], "cyclic": ((size > 1) | loop)[near], "piece": pa.array(ids[piece[near]], mask=~caller[near])})
    for kind, fn, to in ((1, ids[out // n], ids[out % n]), (2, ids[large], ids[large])):
        none = [None] * len(fn)
        rows = pa.concat_tables([rows, pa.table({"kind": np.full(len(fn), kind, np.int32), "fn": fn, "label": to, "size": pa.array(none, pa.int64()), "cyclic": pa.array(none, pa.bool_()), "piece": pa.array(none, pa.int64())})])
    yield from rows.to_batches(max_chunksize=50_000)


def few(rows: DataFrame) -> DataFrame:
    """Stored rows, to be broadcast if they are counted to be few."""
    return F.broadcast(rows) if is_small(rows, FEW) else rows


def components(nodes: DataFrame, edges: DataFrame, n: int, rest: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(fn, label, size, cyclic) of nodes and ends of edges, which are stored, n of them, and may repeat.

    Each range of callers is settled by itself, which holds for pieces that call no caller elsewhere and that no caller elsewhere calls; the others, and those
    of more than WHOLE edges, are left to rest(nodes, edges): all their callers and the calls between these.
    """
    most = WHOLE
    rows = edges.select("src", "dst").unionByName(nodes.select(F.col("fn").cast("long").alias("src"), F.lit(None).cast("long").alias("dst")))
    seen = written(rows.repartitionByRange(n // (4 * SHARE) + 1, "src").mapInArrow(lambda batches: settled_range(batches, most), "kind int, fn long, label long, size long, cyclic boolean, piece long"))
    own, calls = seen.where("kind = 0").drop("kind"), seen.where("kind = 1").select(F.col("fn").alias("piece"), F.col("label").alias("fn"))
    far = written(calls.select("fn").distinct())
    found = written(own.select("fn", "piece").join(few(far), "fn", "left_semi"))
    lone = far.join(found, "fn", "left_anti").select("fn", F.col("fn").alias("label"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("cyclic"))
    across = calls.join(few(found.where("piece IS NOT NULL").withColumnRenamed("piece", "other")), "fn").select(F.explode(F.array("piece", "other")).alias("piece"))
    left = written(across.union(seen.where("kind = 2").select("fn")).distinct())
    if left.isEmpty():
        return own.drop("piece").unionByName(lone)
    left = few(left)
    callers = written(own.join(left, "piece", "left_semi").select("fn"))
    members = few(callers)
    between = edges.join(members.withColumnRenamed("fn", "src"), "src", "left_semi").join(members.withColumnRenamed("fn", "dst"), "dst", "left_semi").select("src", "dst")
    return own.join(left, "piece", "left_anti").drop("piece").unionByName(lone).unionByName(rest(callers, between))


class Pieces:
    """A graph dealt out by its pieces: nodes that call something are in one piece if calls between such nodes connect them. A node that calls nothing (a leaf) leads nowhere and so connects none: each piece has its own copy of those it calls, besides the row of the leaf itself.

    bin, part: where an edge goes. Pieces of up to WHOLE edges share bins of some SHARE edges, part 0; each larger one is a part of bin -1.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, n: int) -> None:
        """edges are stored, n of them."""
        self.columns, self.nodes = edges.columns, nodes
        fields = ", ".join(f"{c} long" for c in self.columns)
        placed = written(edges.select(*(F.col(c).cast("long") for c in self.columns)).repartitionByRange(n // SHARE + 1, "src").mapInArrow(rooted, f"{fields}, root long, open boolean"))
        callers = placed.select("src", "root").distinct()
        across = written(placed.where("open").select("root", "dst").distinct().join(callers.select(F.col("src").alias("dst"), F.col("root").alias("other")), "dst").select(F.col("root").alias("a"), F.col("other").alias("b")).distinct())
        sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        piece = F.col("root")
        if not across.isEmpty():
            names = written(weak_labels(across).withColumnRenamed("fn", "root"))
            placed, sizes = placed.join(names, "root", "left"), sizes.join(names, "root", "left")
            piece = F.coalesce("piece", "root")
        large = written(sizes.groupBy(piece.alias("part")).agg(F.sum("n").alias("n")).where(F.col("n") > WHOLE).select("part"))
        self.any_large = not large.isEmpty()
        part = F.lit(None).cast("long")
        if self.any_large:
            placed, part = placed.withColumn("_piece", piece).join(F.broadcast(large.withColumn("_piece", F.col("part"))), "_piece", "left"), F.col("part")
        self.bins = n // SHARE + 1
        self.edges = placed.select(F.when(part.isNull(), F.pmod(F.xxhash64(piece), F.lit(self.bins))).otherwise(-1).alias("bin"), F.coalesce(part, F.lit(0)).cast("long").alias("part"), *self.columns, "open")
        self.leaves = nodes.select("fn").join(callers.select(F.col("src").alias("fn")), "fn", "left_anti").select(F.pmod(F.xxhash64("fn"), F.lit(self.bins)).alias("bin"), F.lit(0).cast("long").alias("part"), "fn")

    def stored(self) -> Pieces:
        self.edges, self.leaves = written(self.edges), written(self.leaves)
        return self

    def places(self, some: DataFrame) -> DataFrame:
        """(bin, part, fn) of each place that some nodes have: their own, and of leaves those of their copies."""
        of = lambda c, rows: rows.select("bin", "part", F.col(c).alias("fn")).join(some.select("fn"), "fn", "left_semi")
        return of("src", self.edges).unionByName(of("dst", self.edges.where("open"))).unionByName(of("fn", self.leaves)).select("bin", "part", "fn").distinct()

    def run(self, kernel: Callable[..., list[tuple]], schema: str, marks: DataFrame | None = None, copies: bool = False, large: bool = True, keyed: bool = False) -> DataFrame:
        """kernel as for on_whole, on each bin and, if large, each large part. marks: (bin, part, fn). First of a row is its node; those of copies are left out unless asked for. keyed: bin and part come with each row."""
        schema = "bin long, part long, " + schema if keyed else schema
        names = [c.split()[0] for c in schema.split(", ")]
        columns, plain = self.columns, marks is None
        lone = lambda rows, kind: rows.select("bin", "part", *(F.col("fn").alias(c) if c == "src" else F.lit(0).cast("long").alias(c) for c in columns), F.lit(kind).alias("_kind"))
        rows = self.edges.select("bin", "part", *columns, F.lit(0).alias("_kind")).unionByName(lone(self.leaves, 1))
        if not plain:
            rows = rows.unionByName(lone(marks, 2))
        if self.any_large and not large:
            rows = rows.where("bin >= 0")

        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            kind = pdf["_kind"]
            e = pdf.loc[kind == 0, columns].sort_values(columns)
            own = sorted({*pdf.loc[kind < 2, "src"].tolist()})
            found = kernel(own, list(zip(*(e[c].tolist() for c in columns), strict=True)), *([] if plain else [set(pdf.loc[kind == 2, "src"].tolist())]))
            inside = set(own)
            key = (int(pdf["bin"].iloc[0]), int(pdf["part"].iloc[0])) if keyed else ()
            return pd.DataFrame([(*key, *r) for r in found if copies or r[0] in inside], columns=names)

        return rows.groupBy("bin", "part").applyInPandas(of, schema)


def solved(nodes: DataFrame, edges: DataFrame, kernel: Callable[..., list[tuple]], schema: str, rounds: Callable[..., DataFrame] | None = None, small: bool | None = None, marked: DataFrame | None = None, copies: bool = False) -> DataFrame:
    """Rows of the kernel of on_whole on the whole graph if it is small, else on its pieces, for questions that a piece answers with its leaves. Of pieces that are too large, rounds(nodes, edges, marked) gives the rows; without it, each takes one task.

    copies: rows of leaves come once for each piece that calls them as well. small: the kernel, or else rounds, for all.
    """
    extra = [] if marked is None else [marked]
    if small is False and rounds is not None:
        return rounds(nodes, edges, *extra)
    if small:
        return on_whole(nodes, edges, kernel, schema, marked)
    edges = written(edges)
    n = edges.count()
    if n <= WHOLE:
        return on_whole(nodes, edges, kernel, schema, marked)
    pieces = Pieces(nodes, edges, n)
    out = pieces.run(kernel, schema, None if marked is None else pieces.places(marked), copies, large=rounds is None)
    if rounds is None or not pieces.any_large:
        return out
    e = written(pieces.edges.where("bin < 0").select(*pieces.columns))
    callers = e.select(F.col("src").alias("fn")).distinct()
    all_ = callers.union(e.select("dst")).distinct()
    found = rounds(all_, e, *(m.select("fn").join(all_, "fn", "left_semi") for m in extra))
    name = schema.split()[0]
    return out.unionByName(found if copies else found.join(callers.withColumnRenamed("fn", name), name, "left_semi").select(*out.columns))


def levels(edges: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(fn, level): rounds of a join with the edges, each node at the round that first reaches it."""
    seen = written(roots.select("fn", F.lit(0).cast("long").alias("level")).distinct())
    front = seen
    for level in range(1, max_rounds):
        new = front.join(edges, front.fn == edges.src).select(F.col("dst").alias("fn")).distinct().join(seen, "fn", "left_anti")
        front = written(new.withColumn("level", F.lit(level).cast("long")))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def closure(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(src, dst) for each chain of one edge or more, semi-naively: only pairs that were new in the last round are extended."""
    step = edges.select("src", "dst").distinct()
    seen = front = written(step)
    for _ in range(max_rounds):
        new = front.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct().join(seen, ["src", "dst"], "left_anti")
        front = written(new)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def scc_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(fn, label): the smallest member of each strongly connected component, by colouring.

    The smallest id that reaches a node colours it; the members of the colour's component are those that reach the node of that id within the
    colour. Components found leave the graph, and the rest is coloured again.
    """
    left, found = written(nodes.select("fn").distinct()), None
    step = written(edges.select("src", "dst").distinct().where("src <> dst"))
    for _ in range(max_rounds):
        colour = written(left.withColumn("c", F.col("fn")))
        while True:
            offered = step.join(colour, step.src == colour.fn).groupBy(F.col("dst").alias("fn")).agg(F.min("c").alias("o"))
            after = written(colour.join(offered, "fn", "left").select("fn", F.least("c", F.coalesce("o", "c")).alias("c")))
            settled = after.join(colour, ["fn", "c"], "left_anti").isEmpty()
            colour = after
            if settled:
                break
        inside = step.join(colour.select(F.col("fn").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("fn").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        members = levels(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("fn = c").select("fn")).select("fn")
        part = written(members.join(colour, "fn").select("fn", F.col("c").alias("label")))
        found = part if found is None else found.unionByName(part)
        left = written(left.join(part, "fn", "left_anti"))
        if left.isEmpty():
            return found
        step = written(step.join(left.select(F.col("fn").alias("src")), "src", "left_semi").join(left.select(F.col("fn").alias("dst")), "dst", "left_semi"))
    raise RuntimeError(f"not settled in {max_rounds} rounds")
