"""Toxicity by averaged subword vectors and a linear softmax over them, trained together in numpy.

A word is the bag of itself and of its character 3- to 5-grams between boundary marks, each hashed to a bucket with a vector; a document is
the mean vector of all its words' subwords; a softmax layer gives its class. Vectors and layer are learned together by Adam on the cross entropy.
A misspelling that was never seen shares most n-grams, hence most of its vector, with what was. Because mean and layer are linear, a trained
model is one number per bucket and an intercept: its size is fixed, and scoring a text is one pass over its words.

Defined cases: a null or empty text scores as the intercept says; labelled rows whose text or label is null aren't learned from; of repeated
labels of a document the larger counts, of repeated rows of one the text that is first in order; without labelled rows, or with one class only, the score is the
share of toxic rows (0 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import clean, give_back, small_batches, text_chunks, tidy
from graphloom.llm.textkernel import K1, K2, U, mix, run_starts, runs, words

BUCKETS, DIMENSIONS, GRAMS = 1 << 17, 4, (3, 4, 5)
#: Labelled documents to learn from at most: those whose ids have the smallest hash.
MOST_LABELLED = 3000
EPOCHS, RATE, DECAY, SCALE = 90, 0.08, 0.5, 30.0
#: Buckets that fewer of the texts' words fall in aren't learned, as they would only recall single texts.
FEWEST = 10
THRESHOLD = 0.3
#: Words whose subwords are found together.
BLOCK = 1 << 15
HELD_OUT = 2


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of the words, and where each word's begin."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n + 1)])
    raw = np.full(int(at[-1]), 0x0A, dtype=np.uint8)
    spot = np.arange(int(n.sum()))
    before = np.repeat(np.cumsum(n) - n, n)
    raw[spot - before + np.repeat(at[:-1], n)] = data[spot - before + np.repeat(starts, n)]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4").astype(U)
    stops = np.flatnonzero(points == 0x0A)
    of = np.concatenate([[0], stops + 1])  # a word's characters and its line end, which marks its end and the next one's beginning
    marked = mix(np.concatenate([[0x0A], points]).astype(U) * K1 + U(1))
    of_marked = np.stack([of[:-1], of[1:] + 1], axis=1)  # with both marks
    counts = [np.maximum(of_marked[:, 1] - of_marked[:, 0] - g + 1, 0) for g in GRAMS]
    total = 1 + sum(counts)
    out_at = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(int(out_at[-1]), dtype=U)
    whole = np.add.reduceat(marked[1:] * (np.arange(len(points), dtype=U) - np.repeat(of[:-1], np.diff(of)).astype(U) + U(1)) * K2, of[:-1]) if len(n) else np.zeros(0, U)
    out[out_at[:-1]] = mix(whole)
    filled = out_at[:-1] + 1
    for g, k in zip(GRAMS, counts, strict=True):
        m = int(k.sum())
        within = np.arange(m) - np.repeat(np.cumsum(k) - k, k)
        if m:
            out[np.repeat(filled, k) + within] = runs(marked, g)[np.repeat(of_marked[:, 0], k) + within] + U(g)
        filled = filled + k
    return (out % U(BUCKETS)).astype(np.int32), out_at


@dataclass
class Bag:
    """Distinct words of some texts: first the subwords of each, then which words (and how often) each text has."""

    buckets: np.ndarray
    word_at: np.ndarray
    text: np.ndarray
    word: np.ndarray
    count: np.ndarray


def bag(texts: pa.Array) -> Bag:
    w = words(texts, lower=True)
    _, first, which = np.unique(w.fingerprints(), return_index=True, return_inverse=True)
    parts = [subwords(w.data, w.starts[first[k : k + BLOCK]], w.ends[first[k : k + BLOCK]]) for k in range(0, len(first), BLOCK)]
    buckets = np.concatenate([b for b, _ in parts]) if parts else np.zeros(0, dtype=np.int32)
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))]) if parts else np.zeros(1, dtype=np.int64)
    pair, count = np.unique(w.owner() * max(1, len(first)) + which, return_counts=True)
    return Bag(buckets, at, pair // max(1, len(first)), pair % max(1, len(first)), count)


def bag_of_many(texts: list[str], at_once: int = 256) -> Bag:
    """The same for many texts, a few at a time: words are numbered as they first occur."""
    chunks = [(k, pa.array(texts[k : k + at_once], pa.large_string())) for k in range(0, len(texts), at_once)]
    every = np.unique(np.concatenate([np.unique(words(c, lower=True).fingerprints()) for _, c in chunks])) if chunks else np.zeros(0, dtype=U)
    number = np.full(len(every), -1, dtype=np.int32)
    n, buckets, sizes, text, word, count = 0, [], [], [], [], []
    for k, c in chunks:
        w = words(c, lower=True)
        own, first, which = np.unique(w.fingerprints(), return_index=True, return_inverse=True)
        place = np.searchsorted(every, own)
        new = np.flatnonzero(number[place] < 0)
        number[place[new]] = np.arange(n, n + len(new), dtype=np.int32)
        n += len(new)
        b, at = subwords(w.data, w.starts[first[new]], w.ends[first[new]])
        buckets.append(b)
        sizes.append(np.diff(at))
        pair, m = np.unique(w.owner() * max(1, len(own)) + which, return_counts=True)
        text.append((pair // max(1, len(own)) + k).astype(np.int32))
        word.append(number[place[pair % max(1, len(own))]] if len(own) else np.zeros(0, dtype=np.int32))
        count.append(m.astype(np.int32))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return Bag(join(buckets), np.concatenate([[0], np.cumsum(join(sizes))]).astype(np.int64), join(text), join(word), join(count))


@dataclass
class Model:
    weight: np.ndarray
    intercept: float

    def score(self, texts: pa.Array) -> np.ndarray:
        b = bag(texts)
        n = np.diff(b.word_at)
        of_word = np.add.reduceat(self.weight[b.buckets], b.word_at[:-1]) if len(n) else np.zeros(0)
        total = np.bincount(b.text, of_word[b.word] * b.count, minlength=len(texts))
        size = np.bincount(b.text, n[b.word] * b.count, minlength=len(texts))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(total / np.maximum(size, 1) + self.intercept)))


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    """Full-batch Adam at a rate that falls to zero. Means are taken from the mean over all documents, which all share, and scaled, so that a few words in a long text can weigh."""
    rate = float(toxic.mean()) if len(toxic) else 0.0
    if rate in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), np.inf if rate else -np.inf)
    b = bag_of_many(texts)
    n, per_word = len(texts), np.diff(b.word_at)
    size = np.maximum(np.bincount(b.text, per_word[b.word] * b.count, minlength=n), 1)
    share = SCALE * b.count / size[b.text]
    seen, of_texts = np.zeros(BUCKETS), np.bincount(b.word, minlength=len(per_word))
    for k in range(0, len(per_word), BLOCK):
        seen += np.bincount(b.buckets[b.word_at[k] : b.word_at[min(k + BLOCK, len(per_word))]], np.repeat(of_texts[k : k + BLOCK], per_word[k : k + BLOCK]), minlength=BUCKETS)
    used = np.flatnonzero(seen >= min(FEWEST, max(2, n // 100)))
    if not len(used):
        return Model(np.zeros(BUCKETS), float(np.log(rate / (1 - rate))))
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    local = place[b.buckets]
    b.buckets = np.zeros(0, dtype=np.int32)
    word_of = np.repeat(np.arange(len(per_word), dtype=np.int32), per_word)[local >= 0]
    local = local[local >= 0]
    word_at = np.flatnonzero(np.diff(word_of, prepend=-1))  # of words that have a learned subword
    spelled = word_of[word_at]
    order = np.argsort(local, kind="stable").astype(np.int32)
    bucket_at, word_of = np.searchsorted(local[order], np.arange(len(used))), word_of[order]
    del order
    rng = np.random.default_rng(seed)
    vectors, layer, bias = rng.uniform(-0.05, 0.05, (DIMENSIONS, len(used))) / DIMENSIONS, rng.normal(0, 1, (DIMENSIONS, 2)), np.log([1 - rate, rate])
    target = np.stack([1 - toxic, toxic], axis=1).astype(float)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, layer, bias)]

    def means() -> np.ndarray:
        out = np.empty((n, DIMENSIONS))
        for k, v in enumerate(vectors):
            of_word = np.zeros(len(per_word))
            of_word[spelled] = np.add.reduceat(v[local], word_at)
            out[:, k] = np.bincount(b.text, of_word[b.word] * share, minlength=n)
        return out

    for epoch in range(1, EPOCHS + 1):
        mean = means()
        mean -= mean.mean(axis=0)
        logits = mean @ layer + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) / n
        to_mean = error @ layer.T
        to_mean -= to_mean.mean(axis=0)
        to_vectors = np.stack([np.add.reduceat(np.bincount(b.word, to_mean[b.text, k] * share, minlength=len(per_word))[word_of], bucket_at) for k in range(DIMENSIONS)])
        slopes = (to_vectors + DECAY / n * vectors, mean.T @ error, error.sum(axis=0))
        for param, slope, (m, v) in zip((vectors, layer, bias), slopes, state, strict=True):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            param -= RATE * (1 - (epoch - 1) / EPOCHS) * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    towards, middle = layer[:, 1] - layer[:, 0], means().mean(axis=0)  # the middle of the vectors as they are now
    weight = np.zeros(BUCKETS)
    weight[used] = SCALE * (towards @ vectors)
    return Model(weight, float(bias[1] - bias[0] - middle @ towards))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model of labels.toxic, from rows that aren't held out. The driver gets `most` texts at most, one of each document; labels of documents that aren't there, or have no text, don't count towards them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = known.join(there.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = small_batches(there).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    model = fit([r.text for r in rows], np.array([r.toxic for r in rows], dtype=float))
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch):
                part = batch.slice(a, b - a)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(model.score(part.column("text")))})

    scored = clean(docs).mapInArrow(tidy(of), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below THRESHOLD."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(part.column("text").fill_null("")) < THRESHOLD))

    return small_batches(docs).mapInArrow(tidy(of), docs.schema)
