"""Quality rules at the level of hosts, over rules at the level of documents.

Each document gets the base figures and its base verdict. For each host the base failures are counted; the rates are shrunk towards a beta prior
whose mean and strength are the moments of all hosts' rates, so that a host of few documents isn't judged by them alone; and a host whose shrunk rate exceeds a
limit rejects the rest of its documents too.

Defined cases: a null or empty text has no words and fails; a null host is judged by the documents' own rules alone; rows of equal doc_id are
judged each on its own; an empty table gives none; other columns are ignored, whatever their names. Moments are sums of whole numbers, so that a host
at the limit is judged alike in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from graphloom.llm.common import join_some, named, small_batches, stored, text_chunks, tidy, unused
from graphloom.llm.textkernel import K1, U, mix, run_starts, runs, words

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 50, 50, 3
#: A host is rejected when more than this share of its documents is expected to fail.
MAX_FAILURE_RATE = 0.8
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Parts of one that rates are counted in, so that their sums don't depend on an order.
UNIT = 10**12
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
WHITE = b" \t\n\x0b\x0c\r"
FIGURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(w, width: int) -> np.ndarray:
    """How many words of each text lie in runs of width words that the text has twice or more."""
    starts = run_starts(w.of, width)
    covered = np.zeros(len(w.starts) + 1, dtype=bool)
    if len(starts):
        value = runs(w.fingerprints(), width)[starts]
        key = mix(value + w.owner()[starts].astype(U) * K1)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        for k in range(width):
            covered[starts[again] + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[w.of])


def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_chunks(batch):
            part = batch.slice(a, b - a)
            w = words(part.column("text"))
            inside = np.zeros(len(w.data) + 1, dtype=np.int8)
            inside[w.starts] += 1
            inside[w.ends] -= 1
            letters = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & (w.data & 0xC0 != 0x80)
            of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.docs])  # noqa: B023, E731
            raw, dup = w.data.tobytes(), []
            for x, y in zip(w.docs[:-1], w.docs[1:], strict=True):
                lines = [line for line in raw[x:y].split(b"\n") if line.strip(WHITE)]
                dup.append(len(lines) - len(set(lines)))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "host": part.column("host"), "n_words": pa.array(w.counts), "word_chars": pa.array(of(letters)), "n_symbols": pa.array(of(SYMBOL[w.data])), "n_dup_lines": pa.array(dup, pa.int64()), "n_repeat_words": pa.array(repeated_words(w, REPEAT_WIDTH))})


def host_verdicts(failures: DataFrame, max_rate: float) -> DataFrame:
    """(host, shrunk_rate, host_rejected) from (host, n, failed): the rate under a beta prior fitted to all hosts by moments. The variance that counts of so few documents would show anyway is taken off first."""
    in_units = lambda x: F.round(x * UNIT).cast("decimal(38, 0)")
    mean_of = lambda x: F.sum(in_units(x)).cast("double") / F.count(F.lit(1)) / UNIT
    rate = F.col("failed") / F.col("n")
    prior = failures.agg(mean_of(rate).alias("mean"), mean_of(rate * rate).alias("square"), mean_of(1 / F.col("n")).alias("noise"))
    between = F.col("square") - F.col("mean") * F.col("mean") - F.col("mean") * (1 - F.col("mean")) * F.col("noise")
    strength = F.when(between > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.col("mean") * (1 - F.col("mean")) / between - 1))).otherwise(F.lit(STRONGEST))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return failures.crossJoin(F.broadcast(prior.select("mean", strength.alias("strength")))).select("host", shrunk.alias("shrunk_rate"), (shrunk > max_rate).alias("host_rejected"))


def measured(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Figures and base verdict of each document, stored; and the verdict on each host."""
    d = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("host"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    base = stored(d.mapInArrow(tidy(figures), FIGURES)).withColumn("base_failed", failed)
    return base, base.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))


def failing(w) -> np.ndarray:
    return (w.counts < MIN_WORDS) | (100 * repeated_words(w, REPEAT_WIDTH) > MAX_REPEAT_PERCENT * w.counts)


def keep_good(docs: DataFrame, max_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """The rows of docs, with all their columns, that pass the base rules and whose host isn't rejected. Texts are cut into words once; the base verdict stays with its row."""
    host, bad = unused("_host", docs), unused("_failed", docs)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch):
                part = batch.slice(a, b - a)
                failed = failing(words(part.column("text")))
                kept = pa.array([None if f else t for f, t in zip(failed, part.column("text").to_pylist(), strict=True)], part.schema.field("text").type)
                yield part.set_column(part.schema.get_field_index("text"), "text", kept).append_column(bad, pa.array(failed))

    rows = small_batches(docs).withColumn(host, F.col("source").cast("string"))
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), StructField(bad, BooleanType())])
    judged = stored(rows.mapInArrow(tidy(of), schema))
    failures = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(bad).cast("long")).alias("failed"))
    rejected = stored(host_verdicts(failures, max_rate).where("host_rejected").select(F.col("host").alias(host)))
    return join_some(judged.where(~F.col(bad)), rejected, host, "left_anti").select(*named(docs.columns))


def judge(docs: DataFrame, max_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)"""
    base, failures = measured(docs)
    hosts = stored(host_verdicts(failures, max_rate).where("host_rejected").select("host", "host_rejected"))
    judged = join_some(base, hosts, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))
