"""Substring deduplication by Rabin-Karp values of every window of consecutive words, confirmed by a second value.

Documents are dealt into groups by a hash of id and text. What a group holds goes out in two rounds, sorted and packed, to buckets by range of value.
First each group hashes all its windows and sends the leading bits of each value, once; a bucket tells groups which of their values another
group holds too. Only windows whose value is repeated, in the group or elsewhere, then get a second value of 64 bits, by another rule over
other fingerprints of their words, and go out again, once for each pair of values with the smallest document that has it, so that a passage in a third of all
documents is one entry per group, not per document. A bucket finds the smallest document of each pair over all
groups and tells every other group that holds it. The groups then mark the windows, and overlapping marked windows merge into
maximal intervals of words, which are removed.

Leading bits: eight more than the number of windows has, so that few unequal ones meet; these go no further than the second round.

Defined cases: a null text has no words; a text of fewer words than a window loses none; a null doc_id neither removes nor
loses words; rows of equal doc_id don't remove from one another; columns other than doc_id and text are ignored. Only rows that agree in both
doc_id and text are bound to lie in one group. Windows are taken for equal if 128 bits are; the halves are found by different rules, and two
different windows agree in both with a chance of about 2**-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import clean, give_back, memory_of, parts_of, small_batches, text_bytes, text_chunks, unused
from graphloom.llm.textkernel import K1, U, Words, mix, run_starts, runs, words

WINDOW = 50
#: Bytes of text that make one group, and bytes of text whose windows make one bucket.
GROUP_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
SHORT = "bucket int, g int, n int, value_bytes binary, value_width int"
FULL = SHORT + ", check_bytes binary, id_bytes binary, id_width int, id_base long"
TOLD = "g int, known binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
#: What the words of a window are multiplied by for its second value, by their place: odd numbers of a Mersenne-twister draw.
_draw = np.random.RandomState(50).randint(0, 1 << 32, size=(2, 4096), dtype=np.uint64)
FACTORS = _draw[0] << U(32) | _draw[1] | U(1)


def pack(values: np.ndarray) -> tuple[bytes, int]:
    """Unsigned integers in as few bytes each as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def second_values(w: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """Of the windows that begin at these words: the sum of other fingerprints of their words, each multiplied by an odd number of its place."""
    h, out = w.fingerprints(K1), np.zeros(len(starts), dtype=U)
    for k in range(window):
        out += h[starts + k] * FACTORS[k % len(FACTORS)] + U(k)
    return mix(out)


class Windows:
    """All windows of a group, whose texts lie in order of doc_id and text: value, the row that holds it, and whether the row has an id."""

    def __init__(self, group: pa.Table, window: int) -> None:
        self.group, self.window = group.sort_by([("doc_id", "ascending"), ("text", "ascending")]), window
        ids = self.group.column("doc_id").combine_chunks()
        self.ids, self.there = np.asarray(ids.fill_null(0), dtype=np.int64), np.asarray(ids.is_valid())
        values, rows = [], []
        for a, w in self.chunks():
            starts = run_starts(w.of, window)
            values.append(runs(w.fingerprints(), window)[starts])
            rows.append(w.owner()[starts] + a)
        self.values = np.concatenate(values) if values else np.zeros(0, U)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def chunks(self):
        for a, b in text_chunks(self.group):
            yield a, words(self.group.column("text").slice(a, b - a))

    def repeated(self, known: np.ndarray, bits: int) -> np.ndarray:
        """Windows of rows with an id whose value's leading bits are known, or occur in the group again."""
        short = self.values >> U(64 - bits)
        order = np.argsort(short)
        same = short[order][1:] == short[order][:-1]
        again = np.zeros(len(short), dtype=bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        return np.flatnonzero((again | among(short, known)) & self.there[self.rows])

    def second(self, which: np.ndarray) -> np.ndarray:
        """Second values of the chosen windows, which are in order."""
        out, done, at = np.zeros(len(which), dtype=U), 0, 0
        for _, w in self.chunks():
            starts = run_starts(w.of, self.window)
            to = int(np.searchsorted(which, at + len(starts)))
            out[done:to] = second_values(w, starts[which[done:to] - at], self.window)
            done, at = to, at + len(starts)
        return out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """known is sorted."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def firsts(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the values, and where in it each begins."""
    order = np.lexsort(values[::-1]) if len(values) > 1 else np.argsort(values[0], kind="stable")
    if not len(order):
        return order, np.zeros(0, np.int64)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([v[order][1:] != v[order][:-1] for v in values], axis=0)
    return order, np.flatnonzero(fresh)


def packets(g: int, value: np.ndarray, bits: int, buckets: int, more: Callable[[int, int], dict], schema: pa.Schema) -> pa.Table:
    """Sorted values by bucket, as differences; only buckets that hold some."""
    high = value >> U(bits - 32) if bits > 32 else value << U(32 - bits)
    ends = np.searchsorted(high * U(buckets) >> U(32), np.arange(buckets + 1))
    out = []
    for bucket in np.flatnonzero(np.diff(ends)):
        a, b = int(ends[bucket]), int(ends[bucket + 1])
        raw, width = pack(np.diff(value[a:b], prepend=U(0)))
        out.append({"bucket": int(bucket), "g": g, "n": b - a, "value_bytes": raw, "value_width": width} | more(a, b))
    return pa.Table.from_pylist(out, schema=schema)


SHORT_SCHEMA = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("value_bytes", pa.binary()), ("value_width", pa.int32())])
FULL_SCHEMA = pa.schema([*SHORT_SCHEMA, ("check_bytes", pa.binary()), ("id_bytes", pa.binary()), ("id_width", pa.int32()), ("id_base", pa.int64())])


def send_short(column: str, bits: int, buckets: int, window: int):
    def of_group(group: pa.Table) -> pa.Table:
        memory_of(None)
        w = Windows(group, window)
        short = np.unique(w.values[w.there[w.rows]] >> U(64 - bits))
        out = packets(group.column(column)[0].as_py(), short, bits, buckets, lambda a, b: {}, SHORT_SCHEMA)
        give_back()
        return out

    return of_group


def held(bucket: pa.Table) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """The values of all packets, the packet of each, and the packets."""
    packed = bucket.to_pylist()
    values = np.concatenate([np.cumsum(unpack(r["value_bytes"], r["value_width"]), dtype=U) for r in packed])
    return values, np.repeat(np.arange(len(packed)), [r["n"] for r in packed]), packed


def by_packet(packed: list[dict], whose: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """For each packet's group what it is told, in one go over all."""
    order = np.lexsort((*columns[::-1], whose))
    whose, columns = whose[order], [c[order] for c in columns]
    at = np.flatnonzero(np.diff(whose, prepend=-1))
    ends = np.append(at[1:], len(whose))
    rows = np.stack(columns, axis=1) if len(order) else np.zeros((0, len(columns)), U)
    return pa.table({"g": pa.array([packed[int(whose[a])]["g"] for a in at], pa.int32()), "known": pa.array([rows[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})


def meet_short(bucket: pa.Table) -> pa.Table:
    """For each group the values that another group has too."""
    values, whose, packed = held(bucket)
    order, first = firsts(values)
    several = order[np.repeat(np.diff(np.append(first, len(values))), np.diff(np.append(first, len(values)))) > 1]
    return by_packet(packed, whose[several], values[several])


def told(rows: pa.Table, columns: int) -> np.ndarray:
    parts = rows.column("known").to_pylist()
    return np.concatenate([np.frombuffer(x, dtype=U).reshape(-1, columns) for x in parts]) if parts else np.zeros((0, columns), U)


def send_full(column: str, bits: int, buckets: int, window: int):
    def of_group(group: pa.Table, known: pa.Table) -> pa.Table:
        memory_of(None)
        if not group.num_rows:
            return FULL_SCHEMA.empty_table()
        w = Windows(group, window)
        which = w.repeated(np.sort(told(known, 1)[:, 0]), bits)
        value, check, ids = w.values[which], w.second(which), w.ids[w.rows[which]]
        order, first = firsts(value, check)  # stable, and rows are in order of id: the first has the smallest
        value, check, least = value[order[first]], check[order[first]], ids[order[first]]

        def more(a: int, b: int) -> dict:
            base = int(least[a:b].min())
            raw, width = pack((least[a:b] - base).view(U))
            return {"check_bytes": check[a:b].tobytes(), "id_bytes": raw, "id_width": width, "id_base": base}

        out = packets(group.column(column)[0].as_py(), value, 64, buckets, more, FULL_SCHEMA)
        give_back()
        return out

    return of_group


def meet_full(bucket: pa.Table) -> pa.Table:
    """For each group the pairs of values that a smaller document of another group has."""
    values, whose, packed = held(bucket)
    checks = np.concatenate([np.frombuffer(r["check_bytes"], dtype=U) for r in packed])
    ids = np.concatenate([unpack(r["id_bytes"], r["id_width"]).view(np.int64) + r["id_base"] for r in packed])
    order, first = firsts(values, checks)
    size = np.diff(np.append(first, len(values)))
    less = order[ids[order] != np.repeat(np.minimum.reduceat(ids[order], first), size)]
    return by_packet(packed, whose[less], values[less], checks[less])


def marks(w: Windows, known: np.ndarray) -> np.ndarray:
    """Which windows a smaller document has: of the group, or of those that it was told of."""
    out = np.zeros(len(w.values), dtype=bool)
    known = known[np.lexsort((known[:, 1], known[:, 0]))]
    which = w.repeated(known[:, 0], 64)
    if len(which):
        value, check, ids = w.values[which], w.second(which), w.ids[w.rows[which]]
        order, first = firsts(value, check)
        size = np.diff(np.append(first, len(order)))
        later = np.zeros(len(which), dtype=bool)
        later[order] = ids[order] > np.repeat(ids[order[first]], size)
        if len(known):
            own, own_check, elsewhere = value[order[first]], check[order[first]], np.zeros(len(first), dtype=bool)
            left, at = np.arange(len(first)), np.searchsorted(known[:, 0], own)
            while len(left):  # equal values with several second ones lie side by side
                left = left[at[left] < len(known)]
                left = left[known[at[left], 0] == own[left]]
                elsewhere[left] |= known[at[left], 1] == own_check[left]
                at[left] += 1
            later[order] |= np.repeat(elsewhere, size)
        out[which] = later
    return out


def remove(window: int, texts: bool):
    def of_group(group: pa.Table, known: pa.Table) -> pa.Table:
        memory_of(None)
        windows = Windows(group, window)
        group, repeated = windows.group, marks(windows, told(known, 2))
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        done = 0
        for _, w in windows.chunks():
            starts = run_starts(w.of, window)
            marked = starts[repeated[done : done + len(starts)]]
            done += len(starts)
            edge = np.zeros(len(w.starts) + 1, dtype=np.int32)
            edge[marked] += 1
            edge[marked + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            lost = np.concatenate([[0], np.cumsum(gone)])[w.of]
            out["n_words"] += w.counts.tolist()
            out["n_removed"] += np.diff(lost).tolist()
            joined, ends = kept_words(w, ~gone)
            view = memoryview(joined)
            out["kept_sha256"] += [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            if texts:
                out["kept_text"] += kept_texts(w, gone)
        give_back()
        if not texts:
            out["kept_text"] = [None] * group.num_rows
        return pa.table({"doc_id": group.column("doc_id"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept_text": pa.array(out["kept_text"], pa.string())})

    return of_group


def kept_words(w, kept: np.ndarray) -> tuple[bytes, list[int]]:
    """The kept words of all texts, joined by one space within a text, and where each text's begin."""
    data = w.data.copy()
    held = np.zeros(len(data) + 1, dtype=np.int8)
    held[w.starts[kept]] += 1
    held[w.ends[kept]] -= 1
    held = np.cumsum(held[:-1], dtype=np.int8).astype(bool)
    before = np.concatenate([[0], np.cumsum(kept)])
    later = np.flatnonzero(kept & (before[:-1] > np.repeat(before[w.of[:-1]], w.counts)))
    data[w.starts[later] - 1] = 0x20
    held[w.starts[later] - 1] = True
    return data[held].tobytes(), np.concatenate([[0], np.cumsum(held)])[w.docs].tolist()


def kept_texts(w, gone: np.ndarray) -> list[str]:
    """The texts without their removed intervals and the white space behind these; all else stays as it is."""
    held = np.ones(len(w.data), dtype=bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        while a < b:  # an interval that runs over the end of a text is one in each
            stop = min(b, int(w.of[np.searchsorted(w.of, a, "right")]))
            inside = stop == b and b < w.of[np.searchsorted(w.of, a, "right")]
            held[w.starts[a] : w.starts[stop] if inside else w.ends[stop - 1]] = False
            a = stop
    data, ends = w.data[held].tobytes(), np.concatenate([[0], np.cumsum(held)])[w.docs]
    return [data[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)]


def replace_texts(column: str, window: int):
    """The group's rows with all their columns, and the kept texts in place of the texts."""
    digests = remove(window, True)

    def of_group(group: pa.Table, known: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        kept = digests(group, known).column("kept_text")
        group = group.set_column(group.column_names.index("text"), "text", kept.cast(group.schema.field("text").type))
        if "n_chars" in group.column_names:
            n = pa.array([len(t) for t in kept.to_pylist()], pa.int64())
            group = group.set_column(group.column_names.index("n_chars"), "n_chars", n.cast(group.schema.field("n_chars").type))
        return group.drop_columns(column)

    return of_group


def exchanged(docs: DataFrame, window: int, group_bytes: int, kernel: Callable, schema) -> DataFrame:
    """What kernel(column) makes of each group of docs (doc_id long, text, ...) and of the pairs of values that it is told of. column holds a group's number."""
    spark, column = docs.sparkSession, unused("_group", docs)
    size = text_bytes(docs)
    groups, buckets, tasks = parts_of(spark, size, group_bytes), parts_of(spark, size, BUCKET_BYTES), parts_of(spark, size)
    bits = min(64, max(32, size.bit_length() + 8))
    dealt = docs.withColumn(column, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(tasks, column)
    of = lambda rows: dealt.groupBy(column).cogroup(rows.repartition(tasks, "g").groupBy("g"))
    short = dealt.groupBy(column).applyInArrow(send_short(column, bits, buckets, window), SHORT).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(meet_short, TOLD)
    full = of(short).applyInArrow(send_full(column, bits, buckets, window), FULL).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(meet_full, TOLD)
    return of(full).applyInArrow(kernel(column), schema)


def cut_repeats(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, without the repeated intervals of their texts; n_chars, if there, follows the text."""
    full = small_batches(docs).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce("text", F.lit(""))})
    return exchanged(full, window, group_bytes, lambda column: replace_texts(column, window), full.schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each word that a window covers which also starts in a document of smaller doc_id is removed.

    kept_sha256 is of the kept words joined by one space; kept_text, only with texts, is the text without the removed intervals.
    """
    return exchanged(clean(docs), window, group_bytes, lambda column: remove(window, texts), RESULT)
