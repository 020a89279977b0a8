"""Media columns: bytes as lossless WebP images, written and read in numpy.

The reader takes any lossless still image: prefix codes in several groups, back-references, colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. Where an image has one group of codes and no cache, nothing is read symbol by symbol: tables give, for every
bit position of a stretch at once, what a pixel that began there would be and where the next would begin; links over eight pixels come from
links over one by doubling; and only every eighth pixel is then followed one by one.

The writer stores one byte per pixel as grey (subtract green, then a palette, of which up to eight indices share a pixel), runs as back-references,
and the rest under a canonical code of its own.

Defined cases: a null or empty text is 64 zero bytes; payloads too large for one image become several, one file after another; equal texts give equal files;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import clean, stored, tidy

UNIT = 64
#: Bytes of payload in one image at most, and bits of a stream that are looked at together.
MOST_IN_IMAGE, STRETCH = 1 << 24, 1 << 20
#: A run of equal bytes at least this long becomes a back-reference.
SHORTEST_RUN = 8
# Fixed values of the format: the order in which lengths of length codes are written, and the sizes of the five alphabets.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREEN, CHANNEL, DISTANCE = 256 + 24, 256, 40
CACHE_FACTOR = 0x1E35A7BD
#: Short distances lead to neighbours in the plane, by their distance there, then the column's, to the left first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


EIGHT = np.arange(8, dtype=np.uint32)


class Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.bytes = np.frombuffer(data + bytes(32), dtype=np.uint8)
        self.at, self.end = 0, 8 * len(data)
        self.four = np.ndarray(shape=len(data) + 28, dtype="<u4", buffer=self.bytes, strides=(1,))

    def read(self, n: int) -> int:
        value = int.from_bytes(self.bytes[self.at >> 3 : (self.at + n + 7) >> 3].tobytes(), "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return value

    def peek15(self) -> int:
        return int(self.four[self.at >> 3]) >> (self.at & 7) & 0x7FFF

    def wide(self, at: np.ndarray) -> np.ndarray:
        """At least 25 bits from each position."""
        return self.four[np.minimum(at >> 3, len(self.four) - 1)] >> (at & 7).astype(np.uint32)

    def windows(self, begin: int, n: int, most: int) -> np.ndarray:
        """As many bits as a code word has at most, from each of n positions after begin, which is that of a byte."""
        out = self.four[begin >> 3 : (begin >> 3) + (n + 7 >> 3), None] >> EIGHT
        out &= np.uint32((1 << most) - 1)
        return out.ravel()[:n].astype(np.intp)


class Code:
    """A canonical prefix code as a table over as many bits as its longest word has: the symbol, and how many bits it takes."""

    def __init__(self, lengths: dict[int, int]) -> None:
        self.only = next(iter(lengths)) if len(lengths) == 1 else None
        self.most = 0 if self.only is not None else max(lengths.values(), default=0)
        if self.only is None and sum(1 << (self.most - n) for n in lengths.values()) != 1 << self.most or not lengths:
            raise ValueError("a prefix code isn't complete")
        self.symbol, self.bits = np.full(1 << self.most, self.only or 0, dtype=np.intp), np.zeros(1 << self.most, dtype=np.intp)
        if self.only is None:
            for symbol, (code, n) in canonical(lengths).items():
                self.symbol[code :: 1 << n], self.bits[code :: 1 << n] = symbol, n

    def read(self, bits: Bits) -> int:
        window = bits.peek15() & ((1 << self.most) - 1)
        bits.at += int(self.bits[window])
        return int(self.symbol[window])

    def over(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The tables over more bits."""
        if self.only is not None:
            return np.full(1 << most, self.only), np.zeros(1 << most, dtype=np.intp)
        times = 1 << (most - self.most)
        return (self.symbol, self.bits) if times == 1 else (np.tile(self.symbol, times), np.tile(self.bits, times))


REVERSED = [int(f"{k:08b}"[::-1], 2) for k in range(256)]


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Each symbol's bits, the first one lowest, and their number."""
    out, code, before = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        out[symbol] = ((REVERSED[code & 255] << 8 | REVERSED[code >> 8]) >> (16 - n), n)
        code, before = code + 1, n
    return out


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        return Code({bits.read(n): 1 for n in (8 if wide else 1, *[8] * two)})
    lengths: dict[int, int] = {}
    of = {LENGTH_ORDER[k]: n for k in range(4 + bits.read(4)) if (n := bits.read(3))}
    table = Code(of)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        n = table.read(bits)
        if n < 16:
            if n:
                lengths[at] = before = n
            at += 1
        else:
            value, times = (before, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
            if at + times > size:
                raise ValueError("code lengths run over their alphabet")
            if value:
                lengths.update(dict.fromkeys(range(at, at + times), value))
            at += times
    return Code(lengths)


def extra(prefix: int) -> tuple[int, int]:
    """A prefix's lowest value less one, and how many bits add to it."""
    return (prefix, 0) if prefix < 4 else ((2 + (prefix & 1)) << (prefix - 2 >> 1), prefix - 2 >> 1)


EXTRA = np.array([extra(k) for k in range(DISTANCE)])


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def copy(out: np.ndarray, at: int, back: int, n: int) -> None:
    if back > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    if back >= n:
        out[at : at + n] = out[at - back : at - back + n]
    else:
        out[at : at + n] = np.resize(out[at - back : at], n)


def pixels_at_once(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    green, red, blue, alpha, far = codes
    out = np.empty(total, dtype=np.uint32)
    if all(c.only is not None for c in codes[:4]) and green.only < 256:
        out[:] = alpha.only << 24 | red.only << 16 | green.only << 8 | blue.only
        return out
    most = max(c.most for c in codes)
    green_symbol, green_bits = green.over(most)
    rest = [(c, shift, *c.over(most)) for c, shift in ((red, 16), (blue, 0), (alpha, 24)) if c.only is None]
    plain = sum(c.only << shift for c, shift in ((red, 16), (blue, 0), (alpha, 24)) if c.only is not None)
    special = green_symbol >= 256
    refers = bool(special.any())
    if refers:
        far_symbol, far_bits = far.over(most)
    done = 0
    while done < total:
        base = bits.at & ~7
        n = min(STRETCH, bits.end - base + 136)
        window = bits.windows(base, n, most)
        n = len(window)
        last = n - 1
        after = np.arange(n)
        after += green_bits.take(window)
        for _, _, _, c_bits in rest:
            np.minimum(after, last, out=after)
            after += c_bits.take(window.take(after))
        if refers:
            refs = np.flatnonzero(special.take(window))
            at = window.take(refs)
            far_at = np.minimum(refs + green_bits.take(at) + EXTRA[green_symbol.take(at) - 256, 1], last)
            end = window[far_at]
            after[refs] = far_at + far_bits[end] + EXTRA[far_symbol[end], 1]
        np.minimum(after, last, out=after)
        two = after.take(after)
        four = two.take(two)
        eight = memoryview(four.take(four))
        # a pixel takes 73 bits at most; what begins behind the limit is left to the next stretch, unless this is the last
        p, limit, some = bits.at - base, last if base + n >= bits.end else n - 1024, []
        for _ in range((total - done + 7) // 8):
            if p >= limit:
                break
            some.append(p)
            p = eight[p]
        # each eighth pixel, and the seven behind it
        starts = np.empty((len(some), 8), dtype=np.intp)
        starts[:, 0] = some
        starts[:, 4] = four.take(starts[:, 0])
        starts[:, 2::4] = two.take(starts[:, ::4])
        starts[:, 1::2] = after.take(starts[:, ::2])
        starts = starts.ravel()
        found = green_symbol.take(window.take(starts))
        ref = np.flatnonzero(found >= 256) if refers else []
        size = np.ones(len(starts), dtype=np.int64)
        if len(ref):
            s = starts[ref]
            at = s + green_bits[window[s]]
            low, more = EXTRA[found[ref] - 256].T
            size[ref] = low + (bits.wide(at + base) & ((1 << more) - 1)) + 1
        ends = np.cumsum(size)
        keep = int(np.searchsorted(ends, total - done)) + 1  # the stretch may hold more than the image
        starts, found, ends, size = starts[:keep], found[:keep], ends[:keep], size[:keep]
        value = found.astype(np.uint32) << np.uint32(8) | np.uint32(plain)
        if rest:
            p = starts + green_bits[window[starts]]
            for _, shift, c_symbol, c_bits in rest:
                p = np.minimum(p, last)
                value |= c_symbol[window[p]].astype(np.uint32) << np.uint32(shift)
                p = p + c_bits[window[p]]
        if len(ref):
            ref = ref[ref < keep]
        if len(ref):
            literal = found < 256
            out[done + ends[literal] - 1] = value[literal]
            s = starts[ref]
            at = s + green_bits[window[s]] + EXTRA[found[ref] - 256, 1]
            low, more = EXTRA[far_symbol[window[at]]].T
            code = low + (bits.wide(at + far_bits[window[at]] + base) & ((1 << more) - 1)) + 1
            for end, length, c in zip((done + ends[ref]).tolist(), size[ref].tolist(), code.tolist(), strict=True):
                copy(out, end - length, distance(c, width), length)
        else:
            out[done : done + len(value)] = value
        bits.at = base + int(after[starts[-1]])
        done += int(ends[-1])
        if bits.at > bits.end or done > total:
            raise ValueError("the stream ends too early")
    return out


def pixels_one_by_one(bits: Bits, groups: list[list[Code]], which: np.ndarray | None, block: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    total, at = width * height, 0
    out, cache, filled = np.zeros(total, dtype=np.uint32), [0] * (1 << cache_bits if cache_bits else 0), 0

    def remember(to: int) -> int:
        for v in out[filled:to].tolist():
            cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        return to

    while at < total:
        green, red, blue, alpha, far = groups[int(which[at // width >> block, at % width >> block])] if which is not None else groups[0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < GREEN:
            low, more = extra(s - 256)
            n = low + bits.read(more) + 1
            low, more = extra(far.read(bits))
            copy(out, at, distance(low + bits.read(more) + 1, width), n)
            at += n
        else:
            filled = remember(at)
            out[at] = cache[s - GREEN]
            at += 1
    if bits.at > bits.end:
        raise ValueError("the stream ends too early")
    return out


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    which, block, n = None, 0, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        shape = (height + (1 << block) - 1) >> block, (width + (1 << block) - 1) >> block
        which = (read_image(bits, shape[1], shape[0], False) >> 8 & 0xFFFF).reshape(shape)
        n = int(which.max()) + 1
    sizes = (GREEN + (1 << cache_bits if cache_bits else 0), CHANNEL, CHANNEL, CHANNEL, DISTANCE)
    groups = [[read_code(bits, size) for size in sizes] for _ in range(n)]
    if which is None and not cache_bits:
        return pixels_at_once(bits, groups[0], width, width * height)
    return pixels_one_by_one(bits, groups, which, block, cache_bits, width, height)


def channels(argb: np.ndarray) -> np.ndarray:
    """Bytes blue, green, red, alpha of each pixel."""
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) // 2


def predicted(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    if mode == 11:
        p = left + top - top_left
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = average(left, top)
        d = a - top_left
        return np.clip(a + (np.abs(d) // 2) * np.sign(d), 0, 255)
    return {0: BLACK, 1: left, 2: top, 3: top_right, 4: top_left, 5: average(average(left, top_right), top), 6: average(left, top_left), 7: average(left, top), 8: average(top_left, top), 9: average(top, top_right), 10: average(average(left, top_left), average(top, top_right))}.get(mode, BLACK)


BLACK = np.array([0, 0, 0, 255], dtype=np.int64)


def undo_predictor(image: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = image.shape
    out = channels(image).astype(np.int64)
    for y in range(height):
        for x in range(width):
            if not y:
                guess = out[0, x - 1] if x else BLACK
            elif not x:
                guess = out[y - 1, 0]
            else:  # beyond the right edge lies the row's own first pixel
                guess = predicted(int(modes[y >> block, x >> block]), out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], out[y - 1, x + 1] if x + 1 < width else out[y, 0])
            out[y, x] = (out[y, x] + guess) & 255
    return out.astype(np.uint8).view("<u4")[..., 0]


def crossed(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32) >> 5


def undo_cross_colour(image: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = image.shape
    c = channels(image).copy()
    f = channels(factors)[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    green = c[..., 1]
    red = (c[..., 2] + crossed(f[..., 0], green)).astype(np.uint8)
    c[..., 0] = (c[..., 0] + crossed(f[..., 1], green) + crossed(f[..., 2], red)).astype(np.uint8)
    c[..., 2] = red
    return c.view("<u4")[..., 0]


def undo_subtract_green(image: np.ndarray) -> np.ndarray:
    c = channels(image).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return c.view("<u4")[..., 0]


def undo_palette(image: np.ndarray, colours: np.ndarray, share: int, width: int) -> np.ndarray:
    index = image >> 8 & 255
    if share:
        each = 8 >> share
        index = (index[..., None] >> (np.arange(1 << share, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(image.shape[0], -1)[:, :width]
    return np.append(colours, np.zeros(256, dtype=np.uint32))[index]


def shared_bits(colours: int) -> int:
    """How often an index halves its pixel: indices of few colours share one."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(file: bytes) -> np.ndarray:
    """The pixels, ARGB in 32 bits, of a lossless WebP file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(file[21 : 20 + struct.unpack("<I", file[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("the version isn't known")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is given twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            shape = (height + (1 << block) - 1) >> block, (now + (1 << block) - 1) >> block
            data = read_image(bits, shape[1], shape[0], False).reshape(shape)
            undo.append((lambda i, d=data >> 8 & 255, b=block: undo_predictor(i, d, b)) if kind == 0 else (lambda i, d=data, b=block: undo_cross_colour(i, d, b)))
        elif kind == 2:
            undo.append(undo_subtract_green)
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(channels(read_image(bits, n, 1, False)), axis=0, dtype=np.uint8).view("<u4")[:, 0]
            undo.append(lambda i, c=colours, s=shared_bits(n), w=now: undo_palette(i, c, s, w))
            now = (now + (1 << shared_bits(n)) - 1) >> shared_bits(n)
    image = read_image(bits, now, height, True).reshape(height, now)
    for f in reversed(undo):
        image = f(image)
    return image


class Writer:
    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Huffman's lengths, of counts halved until no length exceeds the most."""
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        length = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                length[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(length.values()) <= most:
            return length
        counts = {s: n + 1 >> 1 for s, n in counts.items()}


def put_code(w: Writer, counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """Writes a code for the symbols counted, and returns each one's bits and their number."""
    symbols = sorted(counts) or [0]
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(int(symbols[0] > 1), 1)
        w.put(symbols[0], 8 if symbols[0] > 1 else 1)
        for s in symbols[1:]:
            w.put(s, 8)
        return {s: (k, len(symbols) - 1) for k, s in enumerate(symbols)}
    length = code_lengths(counts if len(symbols) > 1 else counts | {0: 1}, 15)
    tokens, at = [], 0
    for s in sorted(length):
        gap = s - at
        while gap:
            if gap < 3:
                tokens.append((0, 0, 0))
                gap -= 1
            else:
                n = min(gap, 138)
                tokens.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
                gap -= n
        tokens.append((length[s], 0, 0))
        at = s + 1
    of: dict[int, int] = {}
    for t, _, _ in tokens:
        of[t] = of.get(t, 0) + 1
    short = code_lengths(of, 7) if len(of) > 1 else {next(iter(of)): 1}
    last = max(k for k, t in enumerate(LENGTH_ORDER) if t in short)
    w.put(0, 1)
    w.put(max(4, last + 1) - 4, 4)
    for t in LENGTH_ORDER[: max(4, last + 1)]:
        w.put(short.get(t, 0), 3)
    w.put(1, 1)
    w.put(4, 3)
    w.put(len(tokens) - 2, 10)
    codes = canonical(short) if len(of) > 1 else {next(iter(of)): (0, 0)}
    for t, more, n in tokens:
        w.put(*codes[t])
        w.put(more, n)
    return canonical(length)


def joined(first: int, n_first: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bits of a writer, then codes of given lengths, two of which fit in 64 bits."""
    if len(codes) % 2:
        codes, lengths = np.append(codes, np.uint64(0)), np.append(lengths, 0)
    pair = codes[::2] | codes[1::2] << lengths[::2].astype(np.uint64)
    size = lengths[::2] + lengths[1::2]
    at = np.cumsum(size) - size + n_first
    total = n_first + int(size.sum())
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    if len(pair):
        groups = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[groups]] |= np.bitwise_or.reduceat(pair << shift, groups)
        over = np.where(shift > 0, pair >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        words[word[groups] + 1] |= np.bitwise_or.reduceat(over, groups)
    head = np.frombuffer(first.to_bytes(8 * ((n_first + 63) // 64), "little"), dtype="<u8")
    words[: len(head)] |= head
    return words.tobytes()[: total + 7 >> 3]


def encode(payload: bytes) -> bytes:
    """A file of one grey image whose pixels are the payload's bytes, in rows of a multiple of UNIT."""
    data = np.frombuffer(payload, dtype=np.uint8)
    width = UNIT
    while len(data) // width > 1 << 14 or len(data) % width:
        width += UNIT
    height = len(data) // width
    w = Writer()
    for value, n in ((width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (1, 1), (2, 2), (1, 1), (3, 2)):
        w.put(value, n)
    counts = np.bincount(data, minlength=256)
    colours = np.flatnonzero(counts)
    steps = np.diff(colours, prepend=0)
    w.put(len(colours) - 1, 8)
    w.put(0, 1)
    step_counts: dict[int, int] = {}
    for s in steps.tolist():
        step_counts[s] = step_counts.get(s, 0) + 1
    green, red, blue = put_code(w, step_counts, GREEN), put_code(w, {0: 1}, CHANNEL), put_code(w, {0: 1}, CHANNEL)
    alpha = put_code(w, {255: 1} | ({0: 1} if len(colours) > 1 else {}), CHANNEL)
    put_code(w, {0: 1}, DISTANCE)
    for k, s in enumerate(steps.tolist()):
        for code in (green[s], red[0], blue[0], alpha[0 if k else 255]):
            w.put(*code)
    w.put(0, 3)  # no more transforms, no cache, one group
    place = np.zeros(256, dtype=np.uint8)
    place[colours] = np.arange(len(colours))
    index, share = place[data], shared_bits(len(colours))
    if share:
        each = 8 >> share
        index = np.bitwise_or.reduce(index.reshape(-1, 1 << share) << (np.arange(1 << share, dtype=np.uint8) * np.uint8(each)), axis=1)
    symbols, more, n_more = index.astype(np.int64), None, None
    edge = np.flatnonzero(np.diff(index)) + 1
    begin = np.concatenate([[0], edge])
    size = np.diff(np.append(begin, len(index)))
    long = np.flatnonzero(size > SHORTEST_RUN)
    if len(long):
        keep, more, n_more = np.ones(len(index), dtype=bool), np.zeros(len(index), dtype=np.uint64), np.zeros(len(index), dtype=np.int64)
        for a, n in zip(begin[long].tolist(), size[long].tolist(), strict=True):
            keep[a + 1 : a + n] = False
            for at in range(a + 1, a + n, 4096):
                d = min(4096, a + n - at) - 1
                top = d.bit_length() - 1
                prefix, bits = (d, 0) if d < 4 else (2 * top + (d >> top - 1 & 1), top - 1)
                keep[at], symbols[at], more[at], n_more[at] = True, 256 + prefix, d & ((1 << bits) - 1), bits
        symbols, more, n_more = symbols[keep], more[keep], n_more[keep]
    used = np.bincount(symbols, minlength=GREEN)
    code = put_code(w, {int(s): int(used[s]) for s in np.flatnonzero(used)}, GREEN)
    for alphabet, symbol in ((CHANNEL, 0), (CHANNEL, 0), (CHANNEL, 0), (DISTANCE, 1)):  # the second distance: the pixel to the left
        put_code(w, {symbol: 1}, alphabet)
    table, bits = np.zeros(GREEN, dtype=np.uint64), np.zeros(GREEN, dtype=np.int64)
    for s, (c, n) in code.items():
        table[s], bits[s] = c, n
    codes, lengths = table[symbols], bits[symbols]
    if more is not None:
        codes, lengths = codes | more << lengths.astype(np.uint64), lengths + n_more
    body = b"\x2f" + joined(w.value, w.n, codes, lengths)
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk


def store(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of UNIT, as one file or as several in a row."""
    payload = text + bytes(-len(text) % UNIT or (0 if text else UNIT))
    return b"".join(encode(payload[a : a + MOST_IN_IMAGE]) for a in range(0, len(payload), MOST_IN_IMAGE))


def pixel_arrays(media: bytes) -> list[np.ndarray]:
    """Samples of each file in the stored bytes: a row of pixels for each row of the array."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append((decode(media[at : at + size]) >> 8).astype(np.uint8))
        at += size
    return out


def feature(samples: np.ndarray) -> str:
    """Mean, spread, number of levels and the shares, in thousandths, of eight ranges of levels."""
    counts = np.bincount(samples, minlength=256)
    n, levels = len(samples), np.arange(256)
    total, squares = int((counts * levels).sum()), int((counts * levels * levels).sum())
    return f"mean={total * 1000 // n};spread={(squares * n - total * total) * 1000 // (n * n)};levels={int((counts > 0).sum())};ranges={','.join(str(int(c) * 1000 // n) for c in counts.reshape(8, 32).sum(axis=1))}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a stored image."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [t.encode() for t in part.column("text").to_pylist()]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array([store(t) for t in texts], pa.binary())})

    return clean(docs).mapInArrow(tidy(of), "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, stored_bytes in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                stored_bytes = stored_bytes.as_py()
                samples = np.concatenate([p.ravel() for p in pixel_arrays(stored_bytes)])
                payload = samples.tobytes()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored_bytes), hashlib.sha256(stored_bytes).hexdigest(), feature(samples)))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    return media.mapInArrow(tidy(of), RESULT)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every text as an image in the shared folder and reads the stored images back."""
    return features(stored(media_column(docs)))
