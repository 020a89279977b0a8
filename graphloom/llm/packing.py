"""Best-fit packing of tokenized documents into sequences by minimum bin slack.

Pieces of full length are sequences of their own. Of the others only the number of each length matters, so a histogram with at most as many
entries as a sequence has tokens holds the whole problem, however many documents there are. For the longest length that is left, dynamic
programming over a bitset of reachable sums finds the fullest bin that contains it; that combination is taken as often as the
counts allow before the next is sought, so there are about as many searches as lengths. The piece that is n-th of its length then finds its bin
and place by n alone.

Defined cases: a null or empty text is one piece that holds the end id only; rows of equal doc_id are separate documents; an empty table has
no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import clean, memory_of, stored, text_chunks, tidy, tokenizer_file

CAPACITY, END_ID = 2048, 0
#: Bytes of words and their ids that a worker remembers, about; longer words than this are not remembered.
REMEMBERED, LONGEST = 96 << 20, 64
#: What a remembered entry takes beside its own bytes.
ENTRY = 200
PUNCTUATION = string.punctuation.encode()
#: Letters whose bytes in UTF-8 are all that occur behind the first, and all first ones.
LETTERS = [chr(c) for c in [*range(0x80, 0x800, 0x20), *range(0x80, 0xC0), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x10000)]]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class WordIds:
    """ids of texts as the tokenizer gives them, word by word. It drops white space and joins nothing over it, so words can be encoded alone, and once.

    ASCII punctuation behind a last letter or digit is encoded apart from what stands before it, as the tokenizer does. What then is only
    lower-case letters in normal form passes its normalizer and its splitting unchanged, and goes to its model at once; ASCII letters are put in lower case first.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.known, self.held, self.long = Tokenizer.from_file(path), {b"": b""}, 0, []
        self.model = self.tokenizer.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {b: byte_level.pre_tokenize_str(chr(b))[0][0][-1] for b in range(0x80)} | {b: byte_level.pre_tokenize_str(x)[0][0][k] for x in LETTERS for k, b in enumerate(x.encode())}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, core: bytes) -> bytes:
        if core.isascii():
            if not core.isalpha():
                return self.ids(core.decode())
            seen = core.decode()
        else:
            text = core.decode()
            if not text.isalpha() or text != text.lower() or not is_normalized("NFC", text):
                return self.ids(text)
            seen = "".join(map(self.visible.get, core, repeat("")))
            if len(seen) != len(core):
                return self.ids(text)
        return np.array([t.id for t in self.model.tokenize(seen)], dtype="<u4").tobytes()

    def keep(self, w: bytes, ids: bytes) -> bytes:
        self.known[w] = ids
        if len(w) > LONGEST:
            self.long.append(w)
        else:
            self.held += ENTRY + len(w) + len(ids)
        return ids

    def learn(self, new: set[bytes]) -> None:
        known = self.known
        for w in new:
            core = w.rstrip(PUNCTUATION)
            if len(core) < len(w) and (not core or b"<|" in w or not core.decode().lower()[-1].isalnum()):
                self.keep(w, self.ids(w.decode()))
                continue
            tail = w[len(core) :]
            if core.isascii():
                core = core.lower() if b"<|" not in w else core
            parts = [known[x] if x in known else self.keep(x, self.encode(x)) for x in (core, tail)]
            if w not in known:
                self.keep(w, b"".join(parts))

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.held > REMEMBERED:
            self.known, self.held = {b"": b""}, 0
        split = [t.split() for t in texts]
        self.learn(set().union(*split).difference(self.known))
        get = self.known.__getitem__
        out = [b"".join(map(get, ws)) for ws in split]
        for w in self.long:
            del self.known[w]
        self.long = []
        return out


def words_of(path: str) -> WordIds:
    memory = memory_of("packing")
    if path not in memory:
        memory[path] = WordIds(tokenizer_file(path))
    return memory[path]


def cut(path: str, capacity: int):
    """Pieces, and which of its length each is in its task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part, end = {}, TaskContext.get().partitionId(), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for a, b in text_chunks(batch):
                rows: list[tuple] = []
                texts = [x.as_buffer().to_pybytes() for x in batch.column("text").slice(a, b - a)]
                for doc_id, ids in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), words_of(path).of(texts), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        nth = counts.get(length, 0)
                        counts[length] = nth + 1
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), part, nth))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return of


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill a bin best that holds one of the longest; lengths come from long to short, and the first that complete a sum make it up."""
    longest = max(counts)
    room, reach = capacity - longest, 1
    mask, steps = (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, take = counts[length] - (length == longest), 1
        while left > 0 and take * length <= room:  # in lots of 1, 2, 4 ... so that any number up to the count can be made
            lot = min(take, left)
            after = (reach | reach << (lot * length)) & mask
            if after != reach:
                steps.append((length, lot, reach))
                reach = after
            left, take = left - lot, take * 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {longest: 1}
    for length, lot, before in reversed(steps):
        if not before >> at & 1:
            at -= lot * length
            found[length] = found.get(length, 0) + lot
    return found


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first nth, how many a bin, first bin, offset of the first) in ascending order for each length, and the number of bins."""
    counts = {k: v for k, v in counts.items() if v}
    used, rows, bins = dict.fromkeys(counts, 0), [], 0
    while counts:
        found = fullest(counts, capacity)
        times = min(counts[k] // n for k, n in found.items())
        offset = 0
        for length, n in found.items():
            rows.append((length, used[length], n, bins, offset))
            used[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
            offset += length * n
        bins += times
    return rows, bins


def place(rows: list[tuple[int, int, int, int, int]]):
    """Sequence and offset of each piece from its length and which of its length it is over all tasks."""
    by: dict[int, np.ndarray] = {}
    for length in {r[0] for r in rows}:
        by[length] = np.array([r[1:] for r in rows if r[0] == length], dtype=np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (np.asarray(batch.column(c)) for c in ("length", "nth"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                which = np.flatnonzero(length == one)
                first, n, bin_, at = by[int(one)][np.searchsorted(by[int(one)][:, 0], nth[which], "right") - 1].T
                sequence[which] = bin_ + (nth[which] - first) // n
                offset[which] = at + (nth[which] - first) % n * one
            yield pa.record_batch({c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return of


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset). What the driver gets is one count for each length, capacity at most. tokenizer: a file that workers can read, or the name of a public one."""
    pieces = stored(clean(docs).mapInArrow(tidy(cut(tokenizer, capacity), "packing"), PIECES))
    of_part = pieces.where(F.col("length") < capacity).groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    rows, bins = plan({r.length: r.n for r in of_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = of_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    some = pieces.where(F.col("length") < capacity).join(before, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "part")
    packed = some.mapInArrow(tidy(place(rows), "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
