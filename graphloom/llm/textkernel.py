"""Arrays of the words of many texts at once: where they lie, 64-bit fingerprints of words and of runs of words.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 these bytes stand for themselves only, so words of
the bytes are the words `[^\\x20\\x09-\\x0D]+` of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
#: Odd multipliers of 64 bits, of the golden ratio and of a Mersenne-twister draw; any odd ones would do.
K1, K2, RADIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA3B195354A39B70D)
TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * K2
    h = (h ^ (h >> U(29))) * K1
    return h ^ (h >> U(32))


@dataclass
class Words:
    """data: the texts' bytes. docs: where each text begins, and the end. starts, ends: of each word. of: the first word of each text, and the number of words."""

    data: np.ndarray
    docs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.docs) - 1), self.counts)

    def fingerprints(self, seed: np.uint64 = U(0)) -> np.ndarray:
        """64 bits of each word, over eight bytes at a time; equal for equal words. Each seed makes others."""
        n = self.ends - self.starts
        h = n.astype(U) * K1 + seed
        data = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(shape=len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
        left, at, which = n, self.starts, slice(None)
        while len(at):
            part = (h[which] ^ (eight[at] & TAIL[np.minimum(left, 8)])) * K2
            h[which] = (part ^ (part >> U(31))) * K1
            more = np.flatnonzero(left > 8)
            which = more if isinstance(which, slice) else which[more]
            left, at = left[more] - 8, at[more] + 8
        return mix(h)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and len(texts) + 1 offsets. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """lower: A-Z become a-z, and no other letter changes."""
    data, docs = buffers(texts)
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[docs] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, docs, starts, ends, np.searchsorted(starts, docs))


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp value, modulo 2**64, of each run of width fingerprints: the sum of h[i + k] * RADIX ** (width - 1 - k), mixed.

    A run of m + k is the run of m shifted by RADIX ** k plus the run of k behind it, so that the values of all runs come
    from those of half the width, and no table of powers grows with the text.
    """
    if len(h) < width:
        return np.zeros(0, dtype=U)
    value, have, power = None, 0, 1
    doubled, size = h, 1
    while True:
        if width & size:
            if value is None:
                value, have = doubled, size
            else:
                n = len(h) - have - size + 1
                value = doubled[:n] * U(pow(int(RADIX), have, 1 << 64)) + value[size : size + n]
                have += size
        if size * 2 > width:
            break
        n = len(doubled) - size
        doubled = doubled[:n] * U(pow(int(RADIX), size, 1 << 64)) + doubled[size:]
        size *= 2
    return mix(value)


def run_starts(of: np.ndarray, width: int) -> np.ndarray:
    """Which words a run of width words of one text starts at."""
    n = np.maximum(np.diff(of) - width + 1, 0)
    total = int(n.sum())
    return np.arange(total) + np.repeat(of[:-1] - (np.cumsum(n) - n), n)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the runs of width words of each text, and where each text's begin. A text of fewer words has one, of all its words; one without words has none."""
    h = w.fingerprints()
    counts = w.counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(at[-1]), dtype=U)
    long = counts >= width
    keep = np.repeat(long, n)
    out[keep] = runs(h, width)[run_starts(w.of, width)] if keep.any() else 0
    for k in range(1, width):
        for_k = np.flatnonzero(counts == k)
        if len(for_k):
            value = np.zeros(len(for_k), dtype=U)
            for j in range(k):
                value = value * RADIX + h[w.of[for_k] + j]
            out[at[for_k]] = mix(value + U(k * int(K1) % (1 << 64)))
    return out, at
