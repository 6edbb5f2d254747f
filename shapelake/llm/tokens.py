"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6).

Method: a streaming transducer with bounded lookahead. From the merge list come the vocabulary and its
longest token, L bytes. A byte string's encoding is the one sequence of tokens whose neighbours are all
compatible, that is, whose pairs encode to themselves. So each prefix has exactly one last token, found
from earlier prefixes less than L bytes back. Any token still to come begins at one of the last L ends;
a token on the chains of all of them can't change any more, and is emitted. L is thus the lookahead that
suffices; what waits is what the open chains don't share yet, a window that does not grow with the text.
Decoding runs tokens through an incremental machine from bytes to text.

The tokenizer's file is a parameter; it is read on the driver and sent to the workers (its size is the
vocabulary's, whatever the corpus). Encoding is a projection: no shuffle, whole texts, Arrow batches.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published pattern that cuts text before the merges apply. The character class of white space is
# spelled out, as libraries differ on the separators U+001C to U+001F.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"
CACHE_ENTRIES = 1 << 17
CUT_AT_ONCE = 1 << 16  # letters of a text whose pieces are cut in one call; longer texts are cut piece by piece


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes for themselves, the others for
    the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Utf8Stream:
    """Incremental machine from bytes to text: keeps the bytes of an unfinished character, and gives
    U+FFFD for what can't become one."""

    def __init__(self):
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes, last: bool = False) -> str:
        return self._machine.decode(data, last)


class Transducer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: bytes):
        model = json.loads(content)["model"]
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in vocab.items()}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        reachable = set(self.single.values()) | {t for _, t in self.merges.values()}
        self.lookahead = max(self.length[i] for i in reachable)
        self._auto = ahocorasick.Automaton()
        for i in reachable:
            self._auto.add_word(self.bytes_of[i].decode("latin-1"), i)
        self._auto.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(SPLIT)

    def merged(self, data: bytes) -> list[int]:
        """The merge list applied to a short string, by definition: best rank first, leftmost first."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 30, 0))[0] for p in zip(ids[:-1], ids[1:], strict=True)), default=1 << 30)
            if best == 1 << 30:
                break
            out, i = [], 0
            while i < len(ids):
                m = self.merges.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if m and m[0] == best:
                    out.append(m[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens can be neighbours: together they encode to themselves."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= 4 * CACHE_ENTRIES:
                self._fits.clear()
            known = self._fits[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Tokens of one piece given as chunks of Latin-1 text (a letter per byte), emitted once stable.

        Of each end within the window the last token is kept. When the window has grown by L, the chains of
        the last L ends are followed back to where they meet, and all before is emitted and forgotten.
        """
        size, span = self.length, self.lookahead
        last: dict[int, int] = {0: -1}  # end -> last token of the prefix that ends there
        base = at = 0  # emitted up to base; read up to at
        it = None
        grown = 0
        for chunk in chunks:
            if it is None:
                it = self._auto.iter(chunk)
            else:
                it.set(chunk, False)
            for end, token in it:
                e = end + 1
                start = e - size[token]
                if e in last or start < base:
                    continue
                before = last.get(start)
                if before is not None and (before == -1 or self.fits(before, token)):
                    last[e] = token
            at += len(chunk)
            grown += len(chunk)
            if grown >= 4 * span:
                grown = 0
                meet = self._meet(last, base, at)
                if meet > base:
                    yield self._back(last, base, meet)
                    keep = last[meet]
                    last = {e: t for e, t in last.items() if e > meet}
                    last[meet] = keep
                    base = meet
        if at > base:
            yield self._back(last, base, at)

    def _meet(self, last: dict[int, int], base: int, at: int) -> int:
        """The last end that is on the chains of all open ends."""
        ends = {e for e in range(max(base, at - self.lookahead + 1), at + 1) if e in last}
        while len(ends) > 1:
            far = max(ends)
            ends.discard(far)
            ends.add(far - self.length[last[far]] if far > base else base)
        return ends.pop()

    def _back(self, last: dict[int, int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(last[end])
            end -= self.length[out[-1]]
        return out[::-1]

    def _short(self, piece: str) -> tuple[int, ...]:
        """Tokens of a short piece; those that recur are remembered (a bounded number)."""
        out = tuple(t for part in self.stream((piece.encode("utf-8").decode("latin-1"),)) for t in part)
        if len(self._cache) >= CACHE_ENTRIES:
            self._cache.clear()
        self._cache[piece] = out
        return out

    def _chunks(self, piece: str) -> Iterator[str]:
        """A long piece in chunks of a letter per byte; only one chunk is encoded at a time."""
        step = 4 * self.lookahead
        for i in range(0, len(piece), step):
            yield piece[i : i + step].encode("utf-8").decode("latin-1")

    def parts(self, text: str | None) -> Iterator[Iterable[int]]:
        """The ids of ``text`` in order, part by part; null and empty texts have none. Beside the text, what is held
        is one piece's window: pieces are cut one after the other, and a long piece's tokens leave once stable."""
        if not text:
            return
        cache, short = self._cache, self._short
        pieces = self._split.findall(text) if len(text) <= CUT_AT_ONCE else (m.group() for m in self._split.finditer(text))
        for p in pieces:
            known = cache.get(p)
            if known is not None:
                yield known
            elif len(p) <= 16:
                yield short(p)
            else:
                yield from self.stream(self._chunks(p))

    def encode_into(self, text: str | None, out: array) -> None:
        """Append the ids of ``text``."""
        extend = out.extend
        for part in self.parts(text):
            extend(part)

    def count(self, text: str | None) -> int:
        """Number of tokens of ``text``, in constant memory beside it."""
        return sum(map(len, self.parts(text)))

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, token by token through the incremental machine; an unknown id gives U+FFFD."""
        machine, known = Utf8Stream(), self.bytes_of
        return "".join(machine.feed(known.get(i, b"\xff")) for i in ids) + machine.feed(b"", last=True)


_LOADED: dict[str, Transducer] = {}


def transducer(content: bytes) -> Transducer:
    """The transducer of a vocabulary file's content; built once per process."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(content)
    return _LOADED[key]


def _sent(df: DataFrame, file: str):
    with open(file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _typed(df: DataFrame, doc_id: str, text: str, *more: str) -> tuple[DataFrame, str]:
    part = df.select(F.col(doc_id).alias("doc_id"), *more, F.col(text).cast("string").alias("text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    return part, head


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", file: str = DEFAULT_FILE, split_ids: int = 1 << 22) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every document, without special tokens.

    Null and empty texts have an empty list; blank texts have the tokens of their blanks; strings of special
    tokens are ordinary text; equal texts and repeated rows each come out; other columns are not read. An
    output batch closes after ``split_ids`` ids, so memory doesn't grow with the batch.
    """
    sent = _sent(df, file)
    part, head = _typed(df, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(sent.value)
        for batch in batches:
            ids, offsets, first = array("i"), [0], 0
            for i, value in enumerate(batch.column(1)):
                t.encode_into(value.as_py(), ids)
                offsets.append(len(ids))
                if len(ids) >= split_ids or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), lists], names=["doc_id", "ids"])
                    ids, offsets, first = array("i"), [0], i + 1

    return part.mapInArrow(run, f"{head}, ids array<int>")


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), file: str = DEFAULT_FILE) -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``n_tokens`` (bigint; 0 for null and empty) of every document."""
    sent = _sent(df, file)
    part, head = _typed(df, doc_id, text, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(sent.value)
        for batch in batches:
            counts = [t.count(value.as_py()) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return part.mapInArrow(run, f"{head}, n_tokens bigint")


def decode_corpus(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", file: str = DEFAULT_FILE) -> DataFrame:
    """``doc_id`` and ``text`` of lists of ids; a null list gives null, an empty one the empty text."""
    sent = _sent(df, file)
    part = df.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = part.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(sent.value)
        for batch in batches:
            texts = [None if v.as_py() is None else t.decode(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return part.mapInArrow(run, f"doc_id {kind}, text string")
