"""SentencePiece encoding and decoding with a merge-type (BPE) model, by a table of prefixes.

Merging pairs greedily gives every prefix of a word a unique last piece, and the pieces of the prefix before it are again that prefix's
own. So one pass suffices: an automaton names the pieces that end at each position, and the one belongs there that the model leaves beside the
last piece of the prefix before it, which a test of the two alone decides. The ids are read off the table backwards.

No piece goes on from another character to a space mark, so a text falls into words (spaces and what follows them) that are encoded alone, and once. Characters that
are no pieces of their own end a word as well and become one id for each byte.

Defined cases: a null or empty text has no ids and decodes to the empty text; a space mark in the text is the same as a space; rows
of equal doc_id are separate; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import clean, memory_of, text_chunks, tidy, tokenizer_file

MARK = "▁"
WORDS = re.compile(r" *[^ \n]+| +|\n")
#: The same, but letters end where punctuation begins, for models whose pieces never have the one before the other.
FINER_WORDS = re.compile(r" *[A-Za-z0-9À-ÖØ-öø-ÿ]+(?=[!-/:-@[-`{-~])| *[^ \n]+| +|\n")
LETTER_PUNCTUATION = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ][!-/:-@[-`{-~]")
#: Bytes of words, ids and decoded words that a worker remembers, about; longer words than this are not remembered.
REMEMBERED, LONGEST = 96 << 20, 64
#: What a remembered entry takes beside its own bytes.
ENTRY = 250
#: Texts that a normalizer other than the identity, or other handling of spaces, would change.
PROBES = ("\uff21\ufb01", "  a  b ", "e\u0301\u2460", "A\tb\u00a0c", "\u00adx\u200b")


class Codec:
    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a space mark behind another character, so words can't be encoded alone")
        self.words = WORDS if any(map(LETTER_PUNCTUATION.search, self.id)) else FINER_WORDS
        self.score = {self.piece[i]: model.get_score(i) for i in plain}
        self.byte = {int(self.piece[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no piece for some byte")
        self.raw = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() if p in self.id else b"" for i, p in enumerate(self.piece)]
        self.is_byte = [model.is_byte(i) for i in range(size)]
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            parts, halves = self.merged(p)
            if parts == [p]:  # others never come out of merging
                self.automaton.add_word(p, (i, len(p)))
                self.halves[p] = halves
        self.automaton.make_automaton()
        self.characters = {p for p in self.id if len(p) == 1}
        self.beside: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0
        for text in PROBES:
            if self.encode(text) != model.encode(text):
                raise ValueError("the model normalizes texts before it merges, so its ids can't be had from the texts alone")

    def merged(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The definition: of the neighbours whose union is a piece, the leftmost of the best score merge, until none are left. Also the last two that merged."""
        parts, halves = list(text), ("", "")
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts, halves
            halves = (parts[at], parts[at + 1])
            parts[at : at + 2] = [halves[0] + halves[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Do the two pieces stay as they are side by side?

        On either side of the border stood, before each piece was complete, its inner half, the half of that and so on. Back in time, each two
        that stood there together must not be halves of a piece that merges before either is used up. Runs of space marks have one score
        for all lengths, so that time doesn't order them; there the definition decides.
        """
        key = (left, right)
        if key not in self.beside:
            if len(self.beside) > REMEMBERED // ENTRY:
                self.beside.clear()
            a, b = self.piece[left], self.piece[right]
            self.beside[key] = self.merged(a + b)[0] == [a, b] if MARK + MARK in a + b else not self.joins(a, b)
        return self.beside[key]

    def joins(self, a: str, b: str) -> bool:
        score, halves = self.score, self.halves
        a_until = b_until = float("-inf")  # the score at which each is used up: time runs from the best score to the worst
        while True:
            s = score.get(a + b)
            if s is not None and s > a_until and s >= b_until:
                return True
            if len(a) == 1 and len(b) == 1:
                return False
            if len(b) == 1 or len(a) > 1 and score[a] < score[b]:  # what came last is undone first
                a_until, a = score[a], halves[a][1]
            else:
                b_until, b = score[b], halves[b][0]

    def table(self, run: str) -> list[tuple[int, int]]:
        """Of each prefix of the run, the last piece and its length."""
        last: list = [None] * (len(run) + 1)
        for end, (piece, length) in self.automaton.iter(run):
            end += 1
            if last[end] is None:
                before = last[end - length]
                if length == end or before is not None and self.compatible(before[0], piece):
                    last[end] = (piece, length)
        return last

    def encode_run(self, run: str) -> list[int]:
        """Ids of a run of characters that are all pieces."""
        last, at, out = self.table(run), len(run), []
        while at:
            piece, length = last[at]
            out.append(piece)
            at -= length
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        if self.characters.issuperset(word):
            return self.encode_run(word)
        out: list[int] = []
        at = 0
        for k, c in enumerate(word):
            if c not in self.id:
                out += self.encode_run(word[at:k]) if k > at else []
                out += [self.byte[b] for b in c.encode()]
                at = k + 1
        return out + (self.encode_run(word[at:]) if at < len(word) else [])

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split(text) for i in self.encode_word(w.replace(" ", MARK))]

    def split(self, text: str) -> list[str]:
        return self.words.findall(" " + text.replace(MARK, " ")) if text else []

    def decode(self, ids: list[int]) -> str:
        """Pieces in a row, with spaces for their marks but one at the very beginning; bytes that aren't UTF-8 become one U+FFFD each."""
        out, at = [], 0
        while at < len(ids):
            stop = at
            while stop < len(ids) and self.is_byte[ids[stop]] == self.is_byte[ids[at]]:
                stop += 1
            raw = b"".join(self.raw[i] for i in ids[at:stop])
            out.append(raw.decode() if not self.is_byte[ids[at]] else decode_bytes(raw))
            at = stop
        text = "".join(out)
        return text[1:] if ids and self.piece[ids[0]].startswith(MARK) else text

    def both(self, text: str) -> tuple[bytes, bytes]:
        """Decimal ids joined by commas, and what they decode to, in UTF-8."""
        if not text:
            return b"", b""
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        split, long = self.split(text), []
        for w in set(split).difference(self.known):
            ids = self.encode_word(w.replace(" ", MARK))
            self.known[w] = pair = (",".join(map(str, ids)).encode(), b"".join([self.raw[i] for i in ids]))
            if len(w) > LONGEST:
                long.append(w)
            else:
                self.held += ENTRY + len(w) + len(pair[0]) + len(pair[1])
        found = list(map(self.known.__getitem__, split))
        for w in long:
            del self.known[w]
        return b",".join([a for a, _ in found]), b"".join([b for _, b in found])[1:]


def decode_bytes(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        n = 1 if raw[at] < 0x80 else 2 if raw[at] >> 5 == 6 else 3 if raw[at] >> 4 == 14 else 4 if raw[at] >> 3 == 30 else 1
        try:
            out.append(raw[at : at + n].decode())
            at += n
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def codec(path: str) -> Codec:
    memory = memory_of("sentencepiece")
    if path not in memory:
        memory[path] = Codec(tokenizer_file(path))
    return memory[path]


def encode_decode(docs: DataFrame, model: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text; with ids also the ids themselves. model: a file that workers can read, or the name of a public one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = codec(model)
            for a, b in text_chunks(batch):
                part = batch.slice(a, b - a)
                pairs = [c.both(t) for t in part.column("text").to_pylist()]
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array([x.count(b",") + 1 if x else 0 for x, _ in pairs], pa.int64())}
                columns |= {"ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x, _ in pairs]), "decoded_sha256": pa.array([hashlib.sha256(y).hexdigest() for _, y in pairs])}
                if ids:
                    columns["ids"] = pa.array([[int(i) for i in x.split(b",")] if x else [] for x, _ in pairs], pa.list_(pa.int32()))
                yield pa.record_batch(columns)

    return clean(docs).mapInArrow(tidy(of, "sentencepiece"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
