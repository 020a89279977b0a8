"""Near-duplicate components by HyperMinHash signatures, banding and exact confirmation.

A document is its set of distinct runs of some words, three unless asked otherwise. Registers: each of REGISTERS hash functions keeps the smallest value of the
set, and of it the number of leading zeros and the MANTISSA bits that follow. Rows of equal sets are one class, with a number of its own and one row that
stands for it. Bands of some compressed registers put classes into buckets; the share of equal registers, less what unequal sets
agree on by chance, estimates the similarity; pairs that pass are confirmed on the full sets.

A bucket is never expanded into its pairs. First each member is compared with the bucket's smallest (a star). After the components of
the confirmed links are known, only members that are not yet with the smallest are compared with the rest of their bucket, by registers first
and by full sets if these pass, and only links that join components leave the comparison. So a group of n near copies
gives about n rows and not n * n, and no link that the bands and the estimate admit and that joins components is lost. A bucket of more than
MEMBERS such classes, or of more shingles than BLOCK, is not compared within itself but put into buckets by a second band, so that a class is copied once
for each later band at most, however large the bucket; what is still too large then is compared in blocks. The chance that
all this doesn't admit a pair at the threshold itself is below 4e-5 and falls steeply above it.

Defined cases: a text of fewer words than a run is one run; a text without words (or null) has the empty set and no link; a row whose
doc_id is null links with nothing and is kept; rows of one doc_id share a component, with the links of all their texts, in any order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import clean, components, join_hot, join_some, named, parts_of, stored, text_bytes, text_chunks, tidy, unused
from graphloom.llm.textkernel import RADIX, U, mix, shingles, words

REGISTERS, MANTISSA = 168, 10
#: Chance below which no band may admit a pair at the threshold.
MISSED = 4e-5
WIDTH, PERCENT = 3, 85
#: Standard deviations of the estimate that a pair may fall short of the threshold by and still be confirmed exactly.
DEVIATIONS = 4
#: Shingles and members, at most, of what is compared in one task.
BLOCK, MEMBERS = 1 << 20, 1 << 12
_seeds = np.random.RandomState(20).randint(0, 1 << 32, size=(2, REGISTERS), dtype=np.uint64).astype(np.uint32)
FACTOR, SHIFT = _seeds[0] | np.uint32(1), _seeds[1]


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros of 32 bits above MANTISSA bits that follow the first one."""
    part, exponent = np.frexp(least.astype(np.float64))
    zeros = np.where(least == 0, 32, 32 - exponent)
    bits = np.where(least == 0, 0, (part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return ((zeros << MANTISSA) + bits).astype(np.uint16)


def registers(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of registers for each set; the sets lie one after another, and none is empty."""
    high, low = (values >> U(32)).astype(np.uint32), values.astype(np.uint32)
    out = np.empty((len(at) - 1, REGISTERS), dtype=np.uint32)
    h = np.empty_like(low)
    for k in range(REGISTERS):
        np.multiply(low, FACTOR[k], out=h)
        h += high
        h ^= SHIFT[k]
        out[:, k] = np.minimum.reduceat(h, at[:-1])
    return compress(out)


def missed(percent: int, size: int) -> float:
    """Chance that a pair at the threshold shares fewer than two bands of size registers: less than two, as large buckets ask for a second one."""
    n, p = REGISTERS // size, (percent / 100) ** size
    return (1 - p) ** n + n * p * (1 - p) ** (n - 1)


def band_rows(percent: int) -> int:
    """Registers of a band: as many as still admit a pair at the threshold, which makes buckets small."""
    return max(r for r in range(1, REGISTERS) if REGISTERS % r == 0 and (r == 1 or missed(percent, r) < MISSED))


def band_keys(regs: np.ndarray, size: int) -> np.ndarray:
    n = REGISTERS // size
    parts = regs.reshape(len(regs), n, size).astype(U)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=U), parts.shape[:2]).copy()
    for k in range(size):
        key = key * RADIX + parts[:, :, k] + U(1)
    return mix(key).view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely registers of unequal minima of n and m values agree: the integral of both minima's densities times a register's width, 2 ** -MANTISSA of the power of two below the value, on average 1 / (2 ln 2) of the value."""
    return n * m / (n + m) ** 2.0 / (2 * np.log(2)) / (1 << MANTISSA)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    c = chance(n, m)
    return (equal / REGISTERS - c) / (1 - c)


def least_estimate(percent: int) -> float:
    t = percent / 100
    return t - DEVIATIONS * (t * (1 - t) / REGISTERS) ** 0.5


def signatures(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch):
                part = batch.slice(a, b - a)
                values, at = shingles(words(part.column("text"), lower=True), width)
                owner = np.repeat(np.arange(b - a), np.diff(at))
                order = np.lexsort((values, owner))
                values, owner = values[order], owner[order]
                fresh = np.ones(len(values), dtype=bool)
                fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                values = values[fresh]
                n = np.bincount(owner[fresh], minlength=b - a)
                at = np.concatenate([[0], np.cumsum(n)])
                full = np.flatnonzero(n)
                keys, regs = [None] * (b - a), [None] * (b - a)
                if len(full):
                    begins = np.append(at[full], len(values))
                    both = set_keys(values, begins[:-1])
                    rows = registers(values, begins)
                    for k, i in enumerate(full):
                        keys[i], regs[i] = both[k].tobytes(), rows[k].tobytes()
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()), "registers": pa.array(regs, pa.binary())})

    return of


def as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def bands(size: int):
    n = REGISTERS // size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(as_registers(batch.column("registers")), size)
                yield pa.record_batch({"band": pa.array(keys.ravel()), "doc": pa.array(np.repeat(np.asarray(batch.column("doc")), n)), "n": pa.array(np.repeat(np.asarray(batch.column("n")), n))})

    return of


DEEPER = "key long, second int, band long, doc long, n long, root long, asks boolean"


def deeper(size: int):
    """Members of large buckets, once for each band behind the bucket's own: key is of both bands."""
    n = REGISTERS // size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, band = band_keys(as_registers(part.column("registers")), size), np.asarray(part.column("band"))
                row, second = np.nonzero(np.arange(n) > (keys == band[:, None]).argmax(axis=1)[:, None])
                key = mix(band[row].view(U) * RADIX + keys[row, second].view(U))
                yield pa.record_batch({"key": pa.array(key.view(np.int64)), "second": pa.array(second, pa.int32())} | {c: part.column(c).take(pa.array(row)) for c in ("band", "doc", "n", "root", "asks")})

    return of


def set_keys(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """128 bits of each set, of its distinct values."""
    return np.stack([np.add.reduceat(mix(values), begins), np.add.reduceat(mix(values * RADIX), begins)], axis=1)


def sets(width: int):
    """The full sets, as sorted values, and their keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch):
                part = batch.slice(a, b - a)
                values, at = shingles(words(part.column("text"), lower=True), width)
                own = [np.unique(values[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                keys = [set_keys(v, np.zeros(1, np.int64))[0].tobytes() if len(v) else None for v in own]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "set_key": pa.array(keys, pa.binary()), "members": pa.array([v.tobytes() for v in own], pa.binary())})

    return of


def promising(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = as_registers(batch.column("a_registers")), as_registers(batch.column("b_registers"))
                n, m = (np.asarray(batch.column(c), dtype=np.float64) for c in ("a_n", "b_n"))
                batch = batch.select(["a", "b"]).filter(pa.array(estimate((x == y).sum(axis=1), n, m) >= least_estimate(percent)))
            yield batch.select(["a", "b"])

    return of


def linked(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_members"), batch.column("b_members"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return of


def worth_asking(percent: int):
    """Of a block of a bucket, by registers: the members of pairs that pass, lie in different components and hold one member that asks. A pair counts where its first shared band (in a bucket by two bands, its first two) is the bucket's."""
    least, size = least_estimate(percent), band_rows(percent)

    def of(block: pa.Table) -> pa.Table:
        regs, ids, roots = as_registers(block.column("registers").combine_chunks()), *(np.asarray(block.column(c)) for c in ("doc", "root"))
        n, asks, band, second = np.asarray(block.column("n"), dtype=np.float64), np.asarray(block.column("asks")), block.column("band")[0].as_py(), block.column("second")[0].as_py()
        here = int(np.flatnonzero(band_keys(regs[:1], size)[0] == band)[0])
        earlier = [k for k in range(max(here, second)) if k != here]
        keep = np.zeros(len(ids), dtype=bool)
        for i in np.flatnonzero(asks):
            fits = np.flatnonzero((roots != roots[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            equal = regs[fits] == regs[i]
            good = estimate(equal.sum(axis=1), n[i], n[fits]) >= least
            if earlier:
                good &= ~equal.reshape(len(fits), REGISTERS // size, size)[:, earlier].all(axis=2).any(axis=1)
            keep[fits[good]] = True
            keep[i] |= good.any()
        return block.select(["key", "block", "other", "doc", "root", "asks"]).filter(pa.array(keep))

    return of


def connect(percent: int):
    """Of such members with their full sets: links between the components (by their roots) that they join, each pair of them once."""

    def of(block: pa.Table) -> pa.Table:
        roots, asks = (np.asarray(block.column(c)) for c in ("root", "asks"))
        raw = block.column("members").to_pylist()
        n = np.array([len(x) // 8 for x in raw])
        at = np.cumsum(n) - n
        _, values = np.unique(np.frombuffer(b"".join(raw), dtype=np.uint64), return_inverse=True)
        _, parts = np.unique(roots, return_inverse=True)
        links, has = [], np.zeros(len(values) + 1, dtype=np.int32)
        for i in np.flatnonzero(asks):
            mine = values[at[i] : at[i] + n[i]]
            has[mine] = 1
            same = np.add.reduceat(has[values], at)
            has[mine] = 0
            for j in np.flatnonzero((100 * same >= percent * (n + n[i] - same)) & (parts != parts[i])):
                if parts[j] != parts[i]:
                    links.append((min(roots[i], roots[j]), max(roots[i], roots[j])))
                    parts[parts == parts[j]] = parts[i]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return of


def confirm(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), which are stored, that are as similar as asked, by their full sets."""
    with_b = pairs.join(members.select(F.col("doc").alias("b"), F.col("members").alias("b_members")), "b")
    full = join_hot(with_b, members.select(F.col("doc").alias("a"), F.col("members").alias("a_members")), "a", counts=counted(pairs, "a"))
    return full.select("a", "b", "a_members", "b_members").mapInArrow(tidy(linked(percent)), "a long, b long")


def counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def compared(open_: DataFrame, regs: DataFrame, percent: int, block: int, most: int) -> DataFrame:
    """(key, second, band, block, other, doc, root, asks, n): where each member of the buckets is compared. Each asking member meets all others of its bucket in one task."""
    large = (F.col("size") > most) | (F.col("total") > block)
    columns = ["key", "second", "band", "doc", "n", "root", "asks", "size", "total"]
    rows = open_.where(~large).select(F.col("band").alias("key"), F.lit(-1).alias("second"), *columns[2:])
    wide = open_.where(large)
    if not wide.isEmpty():
        signed = wide.select("band", "doc", "n", "root", "asks").join(regs.select("doc", "registers"), "doc")
        pairs = stored(signed.mapInArrow(tidy(deeper(band_rows(percent))), DEEPER))
        worth = stored(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("asks").alias("any")).where("low <> high AND any").drop("low", "high", "any"))
        rows = rows.unionByName(join_hot(pairs, worth, "key", counts=worth.select("key", "size")).select(*columns))
    blocks = F.greatest(F.ceil(F.col("total") / block), F.ceil(F.col("size") / most)).cast("int")
    own, each = F.pmod(F.xxhash64("doc"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    inside = rows.withColumn("block", own).withColumn("other", own)
    asking = rows.where("asks").withColumn("block", own).withColumn("other", each).where("block <> other")
    asked = rows.withColumn("other", own).withColumn("block", each).withColumn("asks", F.lit(False)).where("block <> other")
    return inside.unionByName(asking).unionByName(asked).drop("size", "total")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, width: int = WIDTH, most: int = MEMBERS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest document that links reach, and it is the one kept."""
    d = clean(docs)
    signed = stored(d.mapInArrow(tidy(signatures(width)), "doc_id long, n_shingles long, set_key binary, registers binary").withColumn("row", F.monotonically_increasing_id()))
    nodes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(nodes.groupBy("set_key").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")))
    member = stored(join_hot(nodes.select("doc_id", "set_key"), classes.select("set_key", "node"), "set_key", counts=classes.select("set_key", "n")).select("doc_id", "node").distinct())
    regs = stored(nodes.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("doc"), "doc_id", "set_key", F.col("n_shingles").alias("n"), "registers"))

    rows = regs.mapInArrow(tidy(bands(band_rows(percent))), "band long, doc long, n long")
    buckets = stored(rows.groupBy("band").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("size > 1"))
    hits = stored(join_hot(rows, buckets, "band", counts=buckets.select("band", "size")))
    wanted = stored(regs.join(hits.select("doc").distinct(), "doc", "left_semi").select("doc", "doc_id", "set_key"))
    texts = join_hot(d, wanted.select("doc_id").distinct(), "doc_id", tasks=parts_of(d.sparkSession, text_bytes(d)), counts=counted(nodes, "doc_id"))
    full = texts.mapInArrow(tidy(sets(width)), "doc_id long, set_key binary, members binary").where("set_key IS NOT NULL").dropDuplicates(["doc_id", "set_key"])
    members = stored(full.join(wanted, ["doc_id", "set_key"]).select("doc", "members"))

    def signed_as(side: str) -> DataFrame:
        return regs.select(F.col("doc").alias(side), F.col("n").alias(f"{side}_n"), F.col("registers").alias(f"{side}_registers"))

    star = stored(hits.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct())
    known = join_hot(star.join(signed_as("b"), "b"), signed_as("a"), "a", counts=counted(star, "a")).where(F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"))
    near = stored(known.select("a", "b", "a_n", "b_n", "a_registers", "b_registers").mapInArrow(tidy(promising(percent)), "a long, b long"))
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    of_one_id = join_hot(member.select("doc_id", F.col("node").alias("b")), several.select("doc_id", "a"), "doc_id", counts=several.select("doc_id", "n")).where("a <> b").select("a", "b")
    roots = stored(components(confirm(near, members, percent).unionByName(of_one_id)))

    rooted = hits.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    ends = stored(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("doc") == F.col("leader"), F.col("root"))).alias("lead"), F.count(F.lit(1)).alias("n")).where("low <> high"))
    open_ = stored(join_hot(rooted, ends.select("band", "lead"), "band", counts=ends.select("band", "n")).withColumn("asks", F.col("root") != F.col("lead")))
    rows = compared(open_, regs, percent, block, most).join(regs.select("doc", "registers"), "doc")
    rows = rows.groupBy("key", "block", "other").applyInArrow(worth_asking(percent), "key long, block int, other int, doc long, root long, asks boolean")
    fresh = rows.join(members, "doc").groupBy("key", "block", "other").applyInArrow(connect(percent), "a long, b long")
    above = components(fresh).select(F.col("node").alias("root"), F.col("root").alias("top"))

    of_node = stored(member.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    of_node = stored(join_hot(of_node, above, "root", "left").select("node", "least", F.coalesce("top", "root").alias("root")))
    parts = stored(of_node.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of_node = join_hot(of_node.select("node", "root"), parts.select("root", "component_id"), "root", counts=parts.select("root", "n")).select("node", "component_id")
    of_doc = join_hot(member, of_node, "node", counts=classes.select("node", "n")).select("doc_id", "component_id").distinct()
    out = join_hot(signed.select("doc_id", "n_shingles"), of_doc, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each component stays: that of its smallest doc_id, of several such rows the first in the order of their texts. Rows without doc_id stay."""
    own, id_ = named(docs.columns), unused("_id", docs)
    docs = docs.withColumn(id_, F.col("doc_id").cast("long"))
    rank = unused("_rank", docs)
    kept = stored(near_duplicates(docs, percent, width=width).where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias(rank)))
    one = join_hot(docs, kept.where(F.col(rank) == 1).select(id_), id_, tasks=parts_of(docs.sparkSession, text_bytes(docs)), counts=kept).select(*own)
    several = join_some(docs, kept.where(F.col(rank) > 1).select(id_), id_, "left_semi")
    first = several.withColumn(rank, F.row_number().over(Window.partitionBy(id_).orderBy("text", *own))).where(F.col(rank) == 1).select(*own)
    return one.unionByName(first).unionByName(docs.where(F.col(id_).isNull()).select(*own))
