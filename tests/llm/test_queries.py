"""Queries against SQL and brute force, and each operator on tables with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import chat_format, common, html_extract, minhash_dedup, packing, quality_rules, sentencepiece_codec, substring_dedup, toxicity, warc, webp
from graphloom.llm.common import tokenizer_file
from graphloom.llm.queries import ORACLES, PIECE_BPE, QUERIES, WORD_BPE

SF = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = {int(re.match(r"op(\d+)_", n)[1]): n for n in QUERIES}
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    r = random.Random(9)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(70))
    long = " ".join(f"v{r.randrange(400)}" for _ in range(30_000))
    rows = [(1, passage), (2, f"start {passage} end"), (3, None), (4, ""), (5, " \n\t"), (6, long), (7, long), (8, "one"), (9, "one two"), (9, "one two"), (10, "One TWO"), (None, passage), (None, None), (11, f"{passage}\n{passage}"), (12, "x" * 70_000), (13, "a a a a " * 30), (14, "é中😀 \x00 <|endoftext|> ▁ ok"), (15, passage.replace("w", "W")), (16, passage + " more")]
    return spark.createDataFrame([(a, b, None, None if k % 3 else "s", None, "k", k, "h", 0, "band") for k, (a, b) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, host string, g int, `group` string, _part int, band string")


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    same_rows(spark, duck, name)


def test_all_are_there():
    assert sorted(NAMES) == list(range(1, 11)) and len(QUERIES) == 10


# Substring dedup.


def brute_repeats(rows, window=50):
    first, out = {}, collections.Counter()
    split = [(d, WORD.findall(t)) for d, t in rows]
    for d, ws in split:
        if d is not None:
            for k in range(len(ws) - window + 1):
                key = tuple(ws[k : k + window])
                first[key] = min(first.get(key, d), d)
    for d, ws in split:
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if d is not None and first[tuple(ws[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        out[(d, len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone, strict=True) if not g)))] += 1
    return out


def test_substring(odd, none):
    got = substring_dedup.remove_repeats(odd, group_bytes=256).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(texts_of(odd))
    assert substring_dedup.remove_repeats(none).collect() == []
    clashing = odd.withColumns({"_group": F.lit(1), "_dealt_to": F.lit(2)})
    assert substring_dedup.cut_repeats(clashing).columns == clashing.columns
    cut = substring_dedup.cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    texts = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    assert texts[2] == "start end" and texts[11] == "" and texts[7] == "" and texts[1] == dict(texts_of(odd))[1] and texts[16] == "more"


# Near duplicates.


def shingles(text, width=3):
    ws = WORD.findall(text.translate(LOW))
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))) if ws else frozenset()


def brute_near(rows, width=3, percent=85):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def test_near_duplicates(spark, odd, none):
    root = brute_near(texts_of(odd))
    for r in minhash_dedup.near_duplicates(odd).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert minhash_dedup.near_duplicates(none).collect() == []
    kept = minhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({d for d in root if root[d] == d})


def test_near_duplicate_chains_in_blocks(spark):
    """A group where most are linked through others only, over many blocks of its bucket."""
    r = random.Random(3)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for d in range(120):
        ws = list(base)
        for _ in range(r.randint(0, 5)):
            ws[r.randrange(len(ws))] = f"z{r.randrange(10**6)}"
        rows.append((d, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = brute_near(rows)
    assert 1 < len(set(root.values())) < 100
    for block, most in ((minhash_dedup.BLOCK, minhash_dedup.MEMBERS), (1500, 3)):
        assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, block=block, most=most).collect()} == root


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one document with several texts have the links of each, whatever their order."""
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(w.replace("w", "v") for w in words)
    rows = [(5, a), (5, b), (1, a + " end"), (2, b + " end"), (7, "alone " * 3), (7, b + " end")]
    for order in ((0, 1, 2, 3), (1, 0, 3, 2), (2, 1, 3, 0)):
        docs = spark.createDataFrame([rows[k] for k in order] + rows[4:], "doc_id long, text string").coalesce(1)
        got = minhash_dedup.near_duplicates(docs).collect()
        assert len(got) == 6 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (5, 1), (7, 1)}
        if order[0] == 0:
            assert [tuple(r) for r in minhash_dedup.keep_one(docs).collect()] == [(1, a + " end")]
    twice = spark.createDataFrame([(3, b), (3, a), (3, a)], "doc_id long, text string")
    assert [tuple(r) for r in minhash_dedup.keep_one(twice).collect()] == [(3, b)]


def test_one_id_with_very_many_texts(spark):
    """A third of all rows has one doc_id: its texts are dealt out, and nothing is lost."""
    r = random.Random(12)
    shared = " ".join(f"s{k}" for k in range(55))
    rows = [(7, f"{' '.join(f'x{r.randrange(50)}' for _ in range(r.randrange(8)))} {shared if k % 50 == 0 else k}") for k in range(100_000)]
    rows += [(k, shared) for k in (3, 9)] + [(None, shared)] * 3 + [(10 + k, f"own {k} {shared if k % 97 == 0 else ''}") for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = substring_dedup.remove_repeats(docs, group_bytes=1 << 18).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_near_duplicates_by_five_words(spark):
    """Copies with a contiguous run of other words, of which some are linked by runs of five words and 0.8 and not by three and 0.85."""
    base = [f"w{k}" for k in range(100)]
    rows = []
    for g in range(12):
        ws = [f"g{g}{w}" for w in base]
        rows += [(10 * g + k, " ".join(ws[:40] + [f"x{g}_{k}_{j}" for j in range(n)] + ws[40:])) for k, n in enumerate((0, g + 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def root(width, percent):
        sets = {d: {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} for d, t in rows for ws in [t.split()]}
        return {d: d - d % 10 if 100 * len(s & sets[d - d % 10]) >= percent * len(s | sets[d - d % 10]) else d for d, s in sets.items()}

    assert root(5, 80) != root(3, 85) != {d: d for d, _ in rows} and len(set(root(5, 80).values())) > 12
    for width, percent in ((5, 80), (3, 85)):
        got = minhash_dedup.near_duplicates(docs, percent, width=width).collect()
        assert {r.doc_id: r.component_id for r in got} == root(width, percent)
        assert {r.doc_id for r in minhash_dedup.keep_one(docs, percent, width).collect()} == set(root(width, percent).values())
    assert (minhash_dedup.band_rows(85), minhash_dedup.band_rows(80)) == (6, 4)


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_join_hot(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(3000)], "key long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(5)], "key long, w long")
    plain = sorted(map(tuple, left.join(right, "key").collect()))
    assert sorted(map(tuple, common.join_hot(left, right, "key", hot_rows=50).collect())) == plain


# Quality rules.


def test_quality(odd, none):
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.judge(odd, max_rate=0.99).collect()}
    for d, t in texts_of(odd):
        ws = WORD.findall(t)
        runs = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        covered = {i + k for i in range(len(ws) - 2) if runs[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        assert (d, len(ws), len(covered), failed, not failed) in got
    assert quality_rules.judge(none).collect() == []
    clashing = odd.withColumns({"_host": F.lit(1), "_failed": F.lit(True), "_rejected_host": F.lit("s")})
    assert quality_rules.keep_good(clashing, max_rate=0.99).columns == clashing.columns
    kept = quality_rules.keep_good(odd, max_rate=0.99)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in quality_rules.judge(odd, max_rate=0.99).collect())


def test_bad_hosts_reject_and_small_ones_do_not(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(k, good if k % 10 == 0 else bad, "junk") for k in range(200)] + [(1000 + k, good, "fine") for k in range(200)] + [(2000, bad, "tiny"), (2001, good, None)] + [(3000 + k, good if k % 50 else bad, f"h{k % 4}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert not any(k < 200 for k in kept) and all(1000 + k in kept for k in range(200)) and 2001 in kept
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept


# Tokens.


def test_sentencepiece(spark, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_BPE))
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sentencepiece_codec.encode_decode(docs, PIECE_BPE, ids=True).collect()
        seen = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got)
        want = collections.Counter()
        for d, t in texts_of(docs):
            ids = library.encode(t)
            want[(d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), tuple(ids))] += 1
        assert seen == want
    assert sentencepiece_codec.encode_decode(none, PIECE_BPE).collect() == []


def check_packing(rows, docs, path):
    library = Tokenizer.from_file(tokenizer_file(path))
    want, got = collections.Counter(), collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    for d, t in docs:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[(d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += 1
    assert got == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 2


def test_packing(spark, odd, none):
    path = WORD_BPE
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        check_packing(packing.pack(docs, path).collect(), texts_of(docs), path)
    assert packing.pack(none, path).collect() == []


# Media, pages, archives, chats, toxicity.


def test_media(odd, none):
    rows = webp.round_trip(odd).collect()
    want = collections.Counter()
    for d, t in texts_of(odd):
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[(d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    same = collections.defaultdict(set)
    for r in rows:
        same[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())
    assert webp.round_trip(none).collect() == []


@pytest.fixture(scope="module")
def odd_pages(spark):
    page = "<html><body><nav><a href=/>x</a></nav><article><p>" + "some words here " * 20 + "</p></article></body></html>"
    rows = [(5, "http://a/", page), (2, None, page), (9, "u", page), (None, "v", page), (3, "w", None), (4, "", ""), (6, "z", "tiny"), (7, "z", "tiny"), (2, "again", page), (8, "http://x/é \r\n", "<p>" + "long " * 40_000)]
    return spark.createDataFrame([(a, b, c, "d", 1, "f") for a, b, c in rows], "page_id long, url string, html string, digest string, `first` int, file string")


def test_pages(spark, odd_pages):
    got = html_extract.extract(odd_pages).collect()
    assert {r.text for r in got if r.page_id in (5, 2, 9, None)} == {("some words here " * 20).strip()}
    assert {r.page_id: r.n_chars for r in got if r.page_id in (3, 4)} == {3: 0, 4: 0} and len(got) == 10
    assert html_extract.extract(spark.createDataFrame([], odd_pages.schema)).collect() == []
    import html as entities

    for r, h in zip(*(sorted(df.collect(), key=lambda r: r.page_id) for df in (html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")), spark.read.parquet(f"{SF}/pages.parquet"))), strict=True):
        article = re.search(r"<article>(.*)</article>", h.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)


def test_archives(spark, odd_pages):
    got = sorted((tuple(r) for r in warc.archive(odd_pages).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kinds = [(r[0], r[3], r[4]) for r in got]
    assert kinds == [(2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 2), (6, "response", None), (7, "response", None), (8, "response", None), (9, "revisit", 2), (None, "response", None)]
    assert warc.archive(spark.createDataFrame([], odd_pages.schema)).collect() == []


def test_index_reads_the_chosen_records(spark, odd_pages):
    folder = common.shared_folder(spark)
    index = warc.write(odd_pages, folder)
    assert {"file", "offset", "length", "url", "payload_digest"} <= set(index.columns)
    assert sorted(r.page_id for r in warc.read(index.where("page_id IN (6, 8)"), folder).collect()) == [6, 8]


def test_chats(spark):
    rows = [(1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, 0, None, "x"), (None, None, "assistant", "y"), (3, 1, "assistant", "late"), (3, 0, "user", "early"), (3, 1, "assistant", "late")]
    chats = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\na<|im_end|>\nassistant\n\nassistant\nb\n") and not got[1].valid and got[1].refused_turn == 2
    assert got[2].turns_sha256 == sha("\nx\n") and got[None].loss_sha256 == sha("y") and got[3].loss_sha256 == sha("latelate") and got[3].loss_chars == 8
    parts = chat_format.segments(chats).where("conv_id = 3").collect()
    assert "".join(r.text for r in sorted(parts, key=lambda r: (r.turn, r.segment)) if r.loss) == "latelate"
    assert chat_format.digests(spark.createDataFrame([], chats.schema)).collect() == []


def test_toxicity_held_out(spark, odd, none):
    d = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    hits = sum(p and t for p, t in held)
    assert hits / sum(t for _, t in held) > 0.85 and hits / sum(p for p, _ in held) > 0.85
    assert len(toxicity.score(odd, model).collect()) == odd.count() and toxicity.score(none, model).collect() == []
    nothing = toxicity.train(none, spark.createDataFrame([], labels.schema))
    assert all(r.score == 0 for r in toxicity.score(odd, nothing).collect())
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_toxicity_by_a_plain_forward_pass(spark):
    """Scores are the mean over all subwords of all words through the layer, one by one in plain Python."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for d, t in texts_of(docs)[:60]:
        weights = []
        for w in WORD.findall(t.translate(LOW)):
            raw = np.frombuffer(w.encode(), dtype=np.uint8)
            buckets, _ = toxicity.subwords(raw, np.array([0]), np.array([len(raw)]))
            marked = f"<{w}>"
            assert len(buckets) == 1 + sum(max(0, len(marked) - g + 1) for g in toxicity.GRAMS)
            weights += [float(model.weight[b]) for b in buckets]
        z = (sum(weights) / len(weights) if weights else 0.0) + model.intercept
        assert abs(got[d] - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_learns_from_rows_that_are_there(spark):
    """Labels of documents that are absent, or held out, or repeated don't use up the sample."""
    text = lambda bad: " ".join(["plain", "words", "here"] * 12 + ["scoundrel"] * 3 * bad)
    there = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2]
    docs = spark.createDataFrame([(k, text(k % 3 == 0)) for k in there for _ in range(2)] + [(None, "x"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in there] + [(k, 0) for k in range(10_000, 30_000)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels, most=len(there))).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id in there and r.doc_id != 5)


# The pipeline.


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if not scores[r.doc_id]}
    good = {}
    for d, t in rows.items():
        ws = WORD.findall(t)
        runs = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        covered = {i + k for i in range(len(ws) - 2) if runs[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        if len(ws) >= 50 and 100 * len(covered) <= 50 * len(ws):
            good[d] = t
    root = brute_near(list(good.items()), 5, 80)
    one = {d: t for d, t in good.items() if root[d] == d}
    now = common.stored(docs)
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = common.stored(stage(spark, now, SF))
        assert now.dtypes == docs.dtypes
        counts.append({r.doc_id for r in now.collect()})
        if k == 0:
            assert counts[0] == set(rows)
    assert counts[1:] == [set(good), set(one), set(one)]
    want = brute_repeats(list(one.items()))
    kept = collections.Counter()
    for r in now.collect():
        ws, before = WORD.findall(r.text), WORD.findall(one[r.doc_id])
        kept[(r.doc_id, len(before), len(before) - len(ws), sha(" ".join(ws)))] += 1
        assert r.n_chars == len(r.text)
    assert kept == want
    check_packing(corpus_pipeline.run(spark, SF).collect(), texts_of(now), WORD_BPE)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near copies", "repeated passages", "packing"]
