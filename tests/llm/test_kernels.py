"""Kernels against libraries, definitions and round trips, without Spark."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import chat_format, html_extract, minhash_dedup, packing, quality_rules, substring_dedup, textkernel, toxicity, warc, webp
from graphloom.llm.common import tokenizer_file
from graphloom.llm.queries import PIECE_BPE, WORD_BPE
from graphloom.llm.sentencepiece_codec import Codec

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b中😀.,A", max_size=40)), max_size=6)
ODD = ["", " ", "  a", "a  b ", "a\nb\t c", "　x", "ﬁ é", "é", "<s>", "<unk>▁a▁ b", "\x00z", "中文 😀", "<|endoftext|> a<|startoftext|>b <|END", "a\x1cb!\x1c! \xa0x y", "İ. I! ſ", "don't I'LL 's o'RE", "#" * 300, "a" * 3000, "x<|endoftext|>,", "ª. º²,", "ǅ Ǆ ß ẞ", "é. ́", "1²3½ ③", " " * 70, "\n\n\n", "é!!! É'S", "ΑΣ Σ."]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_runs(texts):
    w = textkernel.words(pa.array(texts, pa.string()))
    split = [WORD.findall(t or "") for t in texts]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == [x for ws in split for x in ws]
    assert w.counts.tolist() == [len(ws) for ws in split]
    h = w.fingerprints()
    flat = [x for ws in split for x in ws]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat, strict=True)))
    for width in (1, 2, 3, 5):
        value = [sum(int(h[i + k]) * pow(int(textkernel.RADIX), width - 1 - k, 1 << 64) for k in range(width)) % (1 << 64) for i in range(len(h) - width + 1)]
        assert (textkernel.mix(np.array(value, dtype=np.uint64)) == textkernel.runs(h, width)).all()
    s, at = textkernel.shingles(w, 3)
    sets = [{tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set() for ws in split]
    assert [len(set(s[a:b].tolist())) for a, b in zip(at[:-1], at[1:], strict=True)] == [len(x) for x in sets]


@pytest.fixture(scope="module")
def codec():
    return Codec(tokenizer_file(PIECE_BPE))


def test_sentencepiece_as_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_BPE))
    r = random.Random(5)
    texts = ODD + ["".join(r.choice(" ▁aeinrst.,\n\t0123éñ中😀\x00#%AB-") for _ in range(r.randint(0, 40))) for _ in range(2000)] + [c * k for c in " a.-=" for k in range(1, 60)]
    for t in texts:
        ids = library.encode(t)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == library.decode(ids), t
        raw, decoded = codec.both(t)
        assert raw == ",".join(map(str, ids)).encode() and decoded.decode() == library.decode(ids)
    for _ in range(500):
        ids = [r.choice([r.randrange(3, 32000), r.randrange(3, 259)]) for _ in range(r.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_prefix_table_gives_every_prefix(codec):
    for word in ("▁authentic", "▁thaned", "ungsch", "▁▁▁the"):
        last = codec.table(word)
        for k in range(1, len(word) + 1):
            assert codec.piece[last[k][0]] == codec.merged(word[:k])[0][-1]


def test_pairs_by_definition(codec):
    r = random.Random(2)
    pieces = [i for i in range(259, 32000) if codec.piece[i] in codec.halves or len(codec.piece[i]) == 1]
    for _ in range(4000):
        a, b = r.choice(pieces), r.choice(pieces)
        assert codec.compatible(a, b) == (codec.merged(codec.piece[a] + codec.piece[b])[0] == [codec.piece[a], codec.piece[b]])


def test_word_ids_as_the_library():
    library = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    own = packing.WordIds(tokenizer_file(WORD_BPE))
    r = random.Random(6)
    texts = ODD + ["".join(r.choice(" aeINrst.,\n'!#123éÉñ中😀\x01<|>") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    got = own.of([t.encode() for t in texts])
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def brute_bins(lengths, capacity):
    best = [len(lengths)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                put(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 16, 30])
    lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
    counts = {n: lengths.count(n) for n in lengths}
    rows, bins = packing.plan(dict(counts), capacity)
    assert bins <= brute_bins(lengths, capacity) + 1
    found = packing.fullest(dict(counts), capacity)
    full = sum(k * n for k, n in found.items())
    reach = {0}
    for n in lengths[1:]:
        reach |= {x + n for x in reach if x + n <= capacity - lengths[0]}
    assert full == lengths[0] + max(reach) and all(n <= counts[k] for k, n in found.items())
    assert packing.plan({}, capacity) == ([], 0)


@pytest.mark.parametrize("seed", range(30))
def test_webp_round_trips(seed):
    r = random.Random(seed)
    n = r.choice([1, 2, 3, 4, 5, 16, 17, 60, 256])
    for size in (0, 1, 63, 64, 65, r.randint(66, 9000)):
        text = bytes(r.choice([r.randrange(n), 0]) if r.random() < 0.7 else 7 for _ in range(size))
        media = webp.store(text)
        samples = np.concatenate([p.ravel() for p in webp.pixel_arrays(media)]).tobytes()
        assert samples == text + bytes(-size % 64 or (0 if size else 64))
    assert media[:4] == b"RIFF" and int.from_bytes(media[4:8], "little") == len(media) - 8


class Rich:
    """A writer of what the operator's own doesn't need: all transforms, a colour cache, several groups and references to rows above."""

    def __init__(self):
        self.w = webp.Writer()

    def codes(self, counted, sizes):
        return [webp.put_code(self.w, c, s) for c, s in zip(counted, sizes, strict=True)]

    def plain(self, image, main=False, cache=0, which=None, block=2):
        height, width = image.shape
        flat = [int(v) for v in image.ravel()]
        tokens, at, held = [], 0, {}
        while at < len(flat):
            n = 0
            while main and at >= width and at + n < len(flat) and n < 4096 and flat[at + n] == flat[at + n - width]:
                n += 1
            key = (webp.CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache) if cache else None
            if n >= 3 and (which is None or True):
                tokens.append(("ref", n, at))
                step = n
            elif cache and held.get(key) == flat[at]:
                tokens.append(("cache", key, at))
                step = 1
            else:
                tokens.append(("literal", flat[at], at))
                step = 1
            for v in flat[at : at + step]:
                if cache:
                    held[(webp.CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache)] = v
            at += step
        self.w.put(1 if cache else 0, 1)
        if cache:
            self.w.put(cache, 4)
        groups = 1
        if main:
            self.w.put(1 if which is not None else 0, 1)
            if which is not None:
                self.w.put(block - 2, 3)
                self.plain(which.astype(np.uint32) << 8)
                groups = int(which.max()) + 1
        of = lambda at: int(which[at // width >> block, at % width >> block]) if which is not None else 0
        counted = [[{} for _ in range(5)] for _ in range(groups)]

        def prefix(value):
            d = value - 1
            if d < 4:
                return d, 0, 0
            top = d.bit_length() - 1
            return 2 * top + (d >> top - 1 & 1), d & ((1 << top - 1) - 1), top - 1

        for kind, v, at in tokens:
            c = counted[of(at)]
            if kind == "literal":
                for k, s in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                    c[k][s] = c[k].get(s, 0) + 1
            elif kind == "cache":
                c[0][280 + v] = c[0].get(280 + v, 0) + 1
            else:
                p = prefix(v)[0] + 256
                c[0][p] = c[0].get(p, 0) + 1
                p = prefix(1)[0]  # the pixel above is the first of the near ones
                c[4][p] = c[4].get(p, 0) + 1
        codes = [self.codes(c, (280 + (1 << cache if cache else 0), 256, 256, 256, 40)) for c in counted]
        for kind, v, at in tokens:
            g = codes[of(at)]
            if kind == "literal":
                for k, s in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                    self.w.put(*g[k][s])
            elif kind == "cache":
                self.w.put(*g[0][280 + v])
            else:
                p, more, n = prefix(v)
                self.w.put(*g[0][256 + p])
                self.w.put(more, n)
                self.w.put(*g[4][prefix(1)[0]])

    def file(self, width, height):
        w = webp.Writer()
        for v, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            w.put(v, n)
        w.put(self.w.value, self.w.n)
        body = b"\x2f" + w.value.to_bytes((w.n + 7) // 8, "little")
        chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)
        return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def pictures(seed):
    r = np.random.default_rng(seed)
    height, width = int(r.integers(1, 30)), int(r.integers(1, 40))
    image = r.integers(0, 1 << 32, (height, width), dtype=np.uint32)
    smooth = (np.add.outer(np.arange(height), np.arange(width)) * 0x01030507 % (1 << 32)).astype(np.uint32)
    rows = np.repeat(r.integers(0, 1 << 32, (1, width), dtype=np.uint32), height, axis=0)
    few = r.choice(r.integers(0, 1 << 32, 5, dtype=np.uint32), (height, width))
    return [image, smooth, rows, few, few & np.uint32(0xFF)]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("cache,grouped", [(0, False), (4, False), (0, True), (3, True)])
def test_webp_reads_cache_groups_and_references(seed, cache, grouped):
    for image in pictures(seed):
        height, width = image.shape
        rich = Rich()
        rich.w.put(0, 1)
        which = np.random.default_rng(seed).integers(0, 3, ((height + 3) >> 2, (width + 3) >> 2)) if grouped else None
        rich.plain(image, main=True, cache=cache, which=which)
        assert (webp.decode(rich.file(width, height)) == image).all()


def forward_predictor(image, modes, block):
    c = webp.channels(image).astype(np.int64)
    out = np.empty_like(c)
    height, width = image.shape
    for y in range(height):
        for x in range(width):
            if not y:
                guess = c[0, x - 1] if x else webp.BLACK
            elif not x:
                guess = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                guess = webp.predicted(int(modes[y >> block, x >> block]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], right)
            out[y, x] = c[y, x] - guess & 255
    return out.astype(np.uint8).view("<u4")[..., 0]


@pytest.mark.parametrize("seed", range(6))
def test_webp_undoes_transforms(seed):
    for image in pictures(seed)[:3]:
        height, width = image.shape
        shape = (height + 3) >> 2, (width + 3) >> 2
        r = np.random.default_rng(seed)
        modes, factors = r.integers(0, 14, shape).astype(np.uint32), r.integers(0, 1 << 24, shape).astype(np.uint32)
        rich = Rich()
        now = image.copy()
        rich.w.put(1, 1), rich.w.put(2, 2)  # subtract green
        c = webp.channels(now).copy()
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
        now = c.view("<u4")[..., 0]
        rich.w.put(1, 1), rich.w.put(0, 2), rich.w.put(0, 3)  # predictor
        rich.plain(modes << 8)
        now = forward_predictor(now, modes, 2)
        rich.w.put(1, 1), rich.w.put(1, 2), rich.w.put(0, 3)  # cross colour
        rich.plain(factors)
        c, f = webp.channels(now).copy(), webp.channels(factors)[np.arange(height)[:, None] >> 2, np.arange(width)[None, :] >> 2]
        red = c[..., 2].copy()
        c[..., 0] = (c[..., 0] - webp.crossed(f[..., 1], c[..., 1]) - webp.crossed(f[..., 2], red)).astype(np.uint8)
        c[..., 2] = (red - webp.crossed(f[..., 0], c[..., 1])).astype(np.uint8)
        now = c.view("<u4")[..., 0]
        rich.w.put(0, 1)
        rich.plain(now, main=True)
        assert (webp.decode(rich.file(width, height)) == image).all()


def test_webp_of_another_encoder():
    """The one transparent pixel by which browsers are asked whether they read lossless WebP."""
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[0]]


def test_webp_refuses():
    for raw in (b"", b"RIFF\0\0\0\0WEBPVP8 ", webp.store(b"abc" * 50)[:40]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(raw)
    assert len(webp.NEAR) == 120 and webp.distance(1, 10) == 10 and webp.distance(2, 10) == 1 and webp.distance(121, 10) == 1


def test_html():
    page = """<html><body class="has-sidebar"><header class="site-header"><a href=/>Home</a> News</header><div id="cookie-notice"><p>We use cookies to make this site better for all.</p></div>
<main><article><h1>Title of it</h1><p>Some <b>bold</b> text &amp; more &lt;tag&gt;&nbsp;x<br>next line of it.</p><div class="advert">Buy now, the best product in the world for you</div><ul><li>one<li>two <a href="a>b">link</a></ul>
<aside><p>Aside words that are long and go on and on for a while.</p></aside><form><label>Name</label><input name=q><button>Send</button></form><script>var t = "</p>";</script><!-- <p>gone</p> -->
<section class="comments"><article class="comment"><p>I think that this is a great article, thanks a lot!</p></article></section><p>Last one.</article></main><footer>&copy; me</footer>"""
    assert html_extract.main_text(page) == "Title of it\nSome bold text & more <tag> x next line of it.\none\ntwo link\nLast one."
    assert html_extract.main_text("") == html_extract.main_text("  ") == html_extract.main_text("<p") == ""
    assert html_extract.main_text("a < b &amp and <p>x <3 y") == "a < b & and\nx <3 y"


LONG = "This paragraph is long enough to be read as running text, and it goes on a little so that nobody takes it for a label of some kind."


def test_html_by_names_and_without_articles():
    """Pages of several kinds against their text as read by hand."""
    named = f"""<body><div class="navbar"><a href=/>Home</a> <a href=/n>News</a></div><article class="post"><h1 class="entry-header">Head</h1><p class="social-security">Benefits rise.</p>
<div class="notice-period">Three months.</div><p id="search-algorithms">They search.</p><header><h2>Part one</h2></header><p>{LONG}</p><p>Short one.</p><p><a href=/s>Source</a></p><p>{LONG}</p>
<div class="post-share"><a href=/f>Share</a> <a href=/t>Send</a></div><div class="ad-300x250">Buy this now and be glad.</div><div class="entry-footer">Filed under things</div></article>
<div id="comments"><article class="comment"><p>{LONG}</p></article></div><div class="sidebar-left"><p>{LONG}</p></div></body>"""
    assert html_extract.main_text(named) == f"Head\nBenefits rise.\nThree months.\nThey search.\nPart one\n{LONG}\nShort one.\nSource\n{LONG}"
    plain = f"""<div><a href=/a>One</a></div><div><a href=/b>Two</a></div><div><a href=/c>Three</a></div><div>A headline of some words</div><div>{LONG}</div><div>Short.</div><div>{LONG}</div>
<div><a href=/x>More of this</a></div><div><a href=/y>And that</a></div><div><a href=/z>Contact</a></div>"""
    assert html_extract.main_text(plain) == f"A headline of some words\n{LONG}\nShort.\n{LONG}"
    table = f"""<table><tr><td><a href=/1>A</a><td><a href=/2>B</a></table><font size=5>Title in a font</font><p>{LONG}<p>{LONG}<hr><p>A short end before links.<ul><li><a href=/3>C</a><li><a href=/4>D</a><li><a href=/5>E</a></ul>"""
    assert html_extract.main_text(table) == f"Title in a font\n{LONG}\n{LONG}\nA short end before links."
    legal = f"""<div class="notice"><p>{LONG * 4}</p><p>{LONG * 4}</p></div><div class="notice">We use cookies here.</div>"""
    assert html_extract.main_text(legal) == f"{LONG * 4}\n{LONG * 4}"
    assert html_extract.main_text(f"<nav><p>{LONG * 9}</p></nav><main><p>Only this.</p></main>") == "Only this."


def path_of(x):
    node, path = html_extract.TREE, []
    while node.feature >= 0:
        path.append(html_extract.FEATURES[node.feature])
        node = node.low if x[node.feature] <= node.at else node.high
    return path


def test_html_tree_weighs_words_links_and_neighbours():
    """Every page of the table, left out in turn, is told from the others; and place alone decides nothing."""
    lines = html_extract.LABELLED.strip().split("\n")
    pages = [[tuple(map(float, b.split())) for b in line.split("|")] for line in lines]
    rows = [(html_extract.with_neighbours([b[:3] for b in page]), [b[3] for b in page]) for page in pages]
    right = n = 0
    for out in range(len(rows)):
        tree = html_extract.grow(np.array([x for k, (xs, _) in enumerate(rows) if k != out for x in xs]), np.array([y for k, (_, ys) in enumerate(rows) if k != out for y in ys]))
        right += sum(tree.says(x) == bool(y) for x, y in zip(*rows[out], strict=True))
        n += len(rows[out][1])
    assert n < 200 and right / n > 0.85
    paths = [path_of(x) for xs, _ in rows for x in xs]
    assert {f for p in paths for f in p} >= {"place", "words", "links", "links_before"} and not any(set(p) == {"place"} for p in paths)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "x\n\\y<|", ""]), st.text(alphabet="<|\\>im_ndstar\n é", max_size=20)), max_size=5))
def test_chat_is_read_back(turns):
    d = chat_format.Digest(1, chat_format.CHATML)
    formatted = "".join(d.add(role, text) for role, text in turns)
    assert chat_format.read_back(formatted, chat_format.CHATML) == turns
    assert formatted.count("<|im_start|>") == len(turns)
    assert d.row()[2] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert d.row()[4] == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()
    assert d.reader.chars == len(formatted)


def test_chat_machine():
    def refused(*roles):
        d = chat_format.Digest(1, chat_format.CHATML)
        for r in roles:
            d.add(r, "")
        return d.refused

    assert refused("system", "user", "assistant", "user", "assistant", "tool", "assistant") is None
    assert refused("assistant") == 0 and refused("user", "user") == 1 and refused("user", "assistant", "narrator") == 2


def test_warc_records():
    payload = "<p>é</p>".encode() * 20
    digest = hashlib.sha256(payload).hexdigest()
    assert warc.parse(warc.record(5, "http://x/\r\né", payload, digest, None)) == (5, len(payload), digest, "response", None)
    assert warc.parse(warc.record(6, None, payload, digest, 5)) == (6, len(payload), digest, "revisit", 5)
    assert warc.parse(warc.record(None, None, b"", hashlib.sha256(b"").hexdigest(), None))[1] == 0
    with pytest.raises(ValueError):
        warc.parse(warc.record(5, None, payload, "0" * 64, None))
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 40, 10), ("b", 0, 5), ("b", 5, 200), ("b", 205, 5)]
    assert list(warc.coalesced(iter(ranges), 10, 100)) == [ranges[:2], ranges[2:3], ranges[3:4], ranges[4:5], ranges[5:]]


def test_minhash_estimates():
    r = np.random.default_rng(4)
    for j in (0.0, 0.5, 0.85, 0.95):
        found = []
        for _ in range(60):
            n = int(r.integers(50, 400))
            same = int(n * 2 * j / (1 + j))
            pool = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:same], pool[n : 2 * n - same]])
            regs = minhash_dedup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            true = same / (2 * n - same)
            found.append(float(minhash_dedup.estimate((regs[0] == regs[1]).sum(), np.float64(n), np.float64(n))) - true)
        assert abs(np.mean(found)) < 0.02 and np.std(found) < 0.06
    assert minhash_dedup.compress(np.array([0, 1, 1 << 31, (1 << 32) - 1], dtype=np.uint32)).tolist() == [32 << 10, 31 << 10, 0, 1023]


def test_packed_numbers():
    for values in ([], [0], [1, 255], [256, 5, 1 << 40], [(1 << 64) - 1, 0]):
        v = np.array(values, dtype=np.uint64)
        raw, width = substring_dedup.pack(v)
        assert (substring_dedup.unpack(raw, width) == v).all()


def test_quality_figures():
    text = "a b c a b c #$ é\nline one\nline one\n \n \nx"
    got = next(quality_rules.figures([pa.record_batch({"doc_id": pa.array([1, 2], pa.int64()), "host": pa.array(["h", None]), "text": pa.array([text, None])})])).to_pylist()
    assert got[0] | {} == {"doc_id": 1, "host": "h", "n_words": 13, "word_chars": 24, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 6}
    assert {k: v for k, v in got[1].items() if k not in ("doc_id", "host")} == dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), 0)


def test_toxicity_shares_ngrams():
    r = random.Random(1)
    clean = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(3)) for _ in range(300)]
    bad = ["scoundrel", "nitwit", "blockhead"]
    texts, labels = [], []
    for k in range(400):
        ws = [r.choice(clean) for _ in range(40)]
        if k % 5 == 0:
            for at in r.sample(range(40), 2):
                ws[at] = r.choice(bad)
        texts.append(" ".join(ws))
        labels.append(k % 5 == 0)
    m = toxicity.fit(texts, np.array(labels, dtype=float))
    plain = " ".join(clean[:39])
    score = lambda t: float(m.score(pa.array([t]))[0])
    assert score(plain) < 0.05 and all(score(f"{plain} {w} {w}") > 0.5 for w in bad)
    assert all(score(f"{plain} {w} {w}") > toxicity.THRESHOLD for w in ("scoundrell", "nitwitt", "blockheadd"))  # never seen
    assert 0 <= score("") <= 1 and m.score(pa.array([None, "x"], pa.string())).shape == (2,)
    one = toxicity.bag_of_many(texts, at_once=7)
    whole = toxicity.bag_of_many(texts)
    assert sorted(one.buckets) == sorted(whole.buckets) and one.count.sum() == whole.count.sum()
    assert toxicity.fit(["a"], np.array([0.0])).score(pa.array(["a"]))[0] < 1e-9
