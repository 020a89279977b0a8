"""What the text operators share: tables, the shared folder, sizes, salted joins and connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel turns into arrays at once; it bounds a Python worker's memory whatever the Arrow batch holds.
CHUNK_BYTES = 1 << 20
#: Rows that a kernel gets at once at most, where the session doesn't say.
BATCH_ROWS = 1000
#: Rows of one key above which a join spreads them.
HOT_ROWS = 2000
#: Keys that a join takes for hot, at most.
MOST_HOT = 10_000
#: Rows up to which a counted table of keys is broadcast; they are at most some hundred bytes each.
MOST_BROADCAST = 100_000
#: Bytes that one task of a shuffle of texts gets, about.
TASK_BYTES = 32 << 20


#: What kernels remember from task to task, by the operator that does.
remembered: dict[str, dict] = {}


def memory_of(owner: str | None) -> dict:
    """What the operator remembers in this worker. What others do goes: workers serve all stages, one after another."""
    for other in list(remembered):
        if other != owner:
            del remembered[other]
    return remembered.setdefault(owner, {}) if owner else {}


def give_back() -> None:
    """Freed memory goes back to the system, which allocators don't do by themselves."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(kernel: Callable, owner: str | None = None) -> Callable:
    """A kernel over batches that leaves nothing behind in its worker but what its operator remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of(owner)
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Only a local master, whose executors are this machine, may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = local_root()
    return f"{root.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


@functools.cache
def local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="graphloom-")


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """The folder's rows may be read until the session ends; then it goes."""

    def drop() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            drop_folder(spark, path)

    atexit.register(drop)


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as a table and read back: a lost executor loses nothing of it, and it isn't computed again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, counted: files are compressed, and of joins and the like the optimizer knows no size."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def parts_of(spark: SparkSession, size: int, target: int = TASK_BYTES) -> int:
    """Tasks of about target bytes each for a shuffle of size bytes, one for each core at least: their number grows with the input, what one gets doesn't."""
    return max(spark.sparkContext.defaultParallelism, -(-size // target))


def small_batches(df: DataFrame) -> DataFrame:
    """Texts are long, so that Spark's default number of rows in a batch would hold tens of megabytes in both processes. What a session has set itself stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(name):
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def clean(docs: DataFrame) -> DataFrame:
    """The two columns that the text operators read, whatever else the table has: doc_id long, text (null: empty)."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def tokenizer_file(name: str) -> str:
    """Where a vocabulary file lies on this machine: a path, or the name of a public tokenizer's file, which each worker finds for itself."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def text_chunks(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the rows of a batch that hold about limit bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at = to


def named(columns: list[str]) -> list:
    """The columns by their names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unused(name: str, *frames: DataFrame) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", hot_rows: int = HOT_ROWS, tasks: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Inner or left join of left with right, which has each key once, in so many tasks. Hot keys of left are dealt over as many parts as they need, and their one row of right is repeated for each.

    A key is hot if it has more than hot_rows rows and more than one MOST_HOT-th of all rows. So there are at most MOST_HOT hot keys, whatever the
    data, and their list is broadcast: left's rows learn their part without being brought together by key. The part follows from a row and the
    partition that it comes in, so that equal rows part too, and a repeated task deals alike. counts (key, n) saves counting left's rows, if
    known; a key that it lacks isn't hot.
    """
    keys = [key] if isinstance(key, str) else key
    lacking = functools.reduce(lambda x, y: x | y, (F.col(k).isNull() for k in keys))
    if counts is None:
        counts = left.where(~lacking).groupBy(*keys).agg(F.count(F.lit(1)).alias("n" if "n" not in keys else "n_"))
    n = next(c for c in counts.columns if c not in keys)
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    whole = lambda df: df.repartition(tasks, *keys) if tasks else df
    if (most or 0) <= hot_rows and how == "inner":
        return whole(left).join(whole(right), keys, how)
    share = max(hot_rows, -(-(total or 0) // MOST_HOT))
    parts, part = (unused(c, left, right) for c in ("_parts", "_part"))
    hot = counts.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias(parts))
    draw = F.xxhash64(*named([c for c, t in left.dtypes if "map<" not in t and t != "variant"]), F.spark_partition_id())
    own = F.when(lacking, F.pmod(draw, F.lit(hot_rows))).when(F.col(parts).isNull(), F.lit(0)).otherwise(F.pmod(draw, F.col(parts))).cast("int")
    salted = left.join(F.broadcast(hot), keys, "left").withColumn(part, own).drop(parts)
    spread = right.join(F.broadcast(hot), keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    keys = [*keys, part]
    return whole(salted).join(whole(spread), keys, how).drop(part)


def join_some(left: DataFrame, right: DataFrame, key: str | list[str], how: str, tasks: int | None = None) -> DataFrame:
    """left, left_semi or left_anti join of left with right, which is stored, has each key once, no null keys and, but for left, the keys only. Broadcast if its counted rows are few; else by shuffle, with hot keys dealt out."""
    keys = [key] if isinstance(key, str) else key
    if right.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return left.join(F.broadcast(right), keys, how)
    if how == "left":
        return join_hot(left, right, keys, how, tasks=tasks)
    there = unused("_there", left)
    found = join_hot(left, right.select(*keys, F.lit(True).alias(there)), keys, "left", tasks=tasks)
    return found.where(F.col(there).isNotNull() if how == "left_semi" else F.col(there).isNull()).select(*named(left.columns))


def free_driver(spark: SparkSession) -> None:
    """Plans and compiled classes of what has run go now, and not when the heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of the undirected edges (a, b) the smallest node that it reaches.

    Tasks first shrink their own edges to stars. Then large-star and small-star steps alternate; each is a shuffle of at most as many rows as there
    are edges, a node's neighbours are never gathered in one row (only their minimum is, which combines before the shuffle), and each round is
    written to the shared folder. The largest degree of a round says whether its joins must spread hot nodes. No edges: no rows.
    """
    spark = edges.sparkSession
    e = stored(edges.where("a <> b").select("a", "b").mapInArrow(tidy(local_stars), "a long, b long").distinct())

    def facts() -> tuple:
        degrees = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38)")).alias("h"))
        return tuple(degrees.agg(F.sum("n"), F.sum("h"), F.max("n")).first())

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return join_hot(left, right, "a") if state[2] > HOT_ROWS else left.join(right, "a")

    state = facts()
    if not state[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = meet(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = meet(large, large.groupBy("a").agg(F.min("b").alias("m")))
        small = own.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e, before = stored(small), state
        state = facts()
        if state[:2] == before[:2]:  # the same edges: their number and the sum of their hashes
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    free_driver(spark)
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smallest node that the batch's edges lead it to)."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        stars = [(x, find(x)) for x in parent if find(x) != x]
        yield pa.record_batch({"a": pa.array([a for a, _ in stars], pa.int64()), "b": pa.array([b for _, b in stars], pa.int64())})
