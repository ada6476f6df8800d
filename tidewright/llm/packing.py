"""Packing tokenised documents into fixed windows: online sum-of-squares packing.

A document's whole windows stand alone. What remains of it goes, whole, into a partially filled window of that fill
level which makes the sum of the squared counts of partially filled windows smallest; the counts are held in an array
indexed by fill level, with opening a window as one more choice. At the end of a task the fullest of the windows still
partially filled are topped up with what the emptiest hold, which is cut for that; all others stay as they were
placed. What is left of one window at the very end is cut into windows whose fills are powers of two, which need no
padding. The column made_by of the result says which way each window came about.

Tokenising and packing happen in the task that reads the documents; nothing is shuffled, and a task holds the windows
that are partially filled, not the documents.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_texts, documents, runs_of_texts

WINDOW = 2048
END_ID = 1
CACHE_WORDS = 150_000
#: Bytes of text that are cut and looked up together: each of their distinct pieces is looked up once.
TEXT_BYTES = 4 << 20
#: White space other than blanks and line feeds, and pairs of these two.
_ODD = (*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "  ", " \n", "\n ", "\n\n")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts by the `tokenizers` library, as little-endian unsigned 32-bit bytes.

    The vocabulary's own pre-tokeniser never joins what stands on the two sides of a single blank or line feed between
    two words; the blank goes with the word after it, the line feed stands alone. So a text is cut there and the ids
    that the tokenizer gives for each piece are remembered; texts with any other white space, or with the name of a
    special token, are encoded whole. Arrow cuts the texts of a call together and numbers their pieces, so each distinct
    piece is looked up once a call, however often it occurs. special_as_text: such names are text like any other, not the tokens' ids.
    """

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path or vocabulary_path("byte_bpe_50k.json"))
        self._tokenizer.encode_special_tokens = special_as_text
        self._special = () if special_as_text else tuple(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        self._lengths = np.zeros(self._tokenizer.get_vocab_size(), np.int64)  # in bytes: the vocabulary spells a byte as a character
        for token, i in self._tokenizer.get_vocab().items():
            self._lengths[i] = len(token)
        self._encode = lambda texts: self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        self._most, self._older, self._later, self._first, self._newline = cache_words, {}, {}, {}, self.whole("\n")
        self._marks = {mark: self.whole(mark) for mark in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        return np.array(self._encode([text])[0].ids, dtype="<u4").tobytes()

    def _learn(self, known: dict[str, bytes], pieces: list[str], before: str, skip: int) -> None:
        """Ids of pieces that follow the character before, without the first `skip`: encoded in one text, dealt by their lengths."""
        ids = np.array(self._encode(["".join([before + p for p in pieces])])[0].ids, dtype="<u4")
        ends = np.cumsum(self._lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(p.encode("utf-8", "replace")) + 1 for p in pieces]), side="left") + 1
        data, start = ids.tobytes(), 0
        for piece, end in zip(pieces, (4 * cuts).tolist(), strict=True):
            known[piece] = data[start + 4 * skip : end]
            start = end

    def _looked_up(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of pieces, None for those that are not known; what was known the time before last is again."""
        later, older = self._later, self._older
        found = list(map(later.get, pieces))
        for i, ids in enumerate(found):
            if ids is None and (ids := older.get(pieces[i])) is not None:
                later[pieces[i]] = found[i] = ids
        return found

    def _within(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces that follow a blank."""
        found, later, marks = self._looked_up(pieces), self._later, self._marks
        at = [i for i, ids in enumerate(found) if ids is None]
        new = [pieces[i] for i in at]
        # a mark after a letter is a word of its own, so only what stands before it has to be known
        bare = [p[:-1] if p[-1] in marks and p[-2:-1].isalpha() else p for p in new]
        if unknown := {b for b, ids in zip(bare, self._looked_up(bare), strict=True) if ids is None}:
            self._learn(later, list(unknown), " ", 0)
        for i, p, b in zip(at, new, bare, strict=True):
            found[i] = later[b]
            if p is not b:
                later[p] = found[i] = found[i] + marks[p[-1]]
        return found

    def _heads(self, heads: list[str]) -> list[bytes]:
        """The ids of pieces that begin a line."""
        if new := set(heads).difference(self._first):
            self._learn(self._first, list(new), "\n", 1)
        return list(map(self._first.__getitem__, heads))

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that may be cut at every blank and line feed: Arrow cuts them, numbers their distinct pieces and lays the ids side by side."""
        lines = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
        cut = pc.split_pattern(lines.flatten(), " ")
        coded = cut.flatten().dictionary_encode()
        distinct, head_at = coded.dictionary, cut.offsets.to_numpy()[:-1]
        text_at = np.append(head_at, len(coded))[lines.offsets.to_numpy()]  # the piece at which a text begins
        # a piece is known by its number and where it stands: after a blank, first in a text, or after a line feed
        kind = np.zeros(len(coded), np.int64)
        kind[head_at], kind[text_at[:-1]] = 2, 1
        key = coded.indices.to_numpy() + kind * len(distinct)
        used = np.zeros(3 * len(distinct), np.bool_)
        used[key] = True
        within, first, after = (distinct.filter(pa.array(u)).to_numpy(zero_copy_only=False).tolist() for u in used.reshape(3, -1))
        heads = self._heads(first + after)
        ids = self._within(within) + heads[: len(first)] + [self._newline + h for h in heads[len(first) :]]
        laid = pa.array(ids, pa.large_binary()).take(pa.array((np.cumsum(used) - 1)[key]))
        _, offsets, data = laid.buffers()
        ends = np.frombuffer(offsets, np.int64)[text_at].tolist()
        return [data.slice(a, b - a).to_pybytes() for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._later) > self._most:  # what was met since the time before last stays known
            self._older, self._later = self._later, {}
        if len(self._first) > self._most:
            self._first = {}
        odd = [not t or t[0] in " \n" or t[-1] in " \n" or any(map(t.__contains__, _ODD)) or any(map(t.__contains__, self._special)) for t in texts]
        plain = [t for t, o in zip(texts, odd, strict=True) if not o]
        done = iter(self._encode_cut(plain) if plain else ())
        return [next(done) if not o else self.whole(t) if t else b"" for t, o in zip(texts, odd, strict=True)]

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0]


def encoder_of(path: str | None) -> Encoder:
    """The encoder of this process: the vocabulary is read, and words are learnt, once for all tasks that a worker runs.

    This package's code travels to workers with each task, so its own module variables would be new in each.
    """
    held = sys.modules.setdefault("_tidewright_encoders", ModuleType("_tidewright_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


#: How a window came about: a document's own whole window; pieces placed whole; placed, then topped up; the cut rest.
WHOLE, PLACED, TOPPED, REST = MADE_BY = ("whole", "placed", "topped", "rest")


class Packer:
    """Places pieces into windows. emit(doc, start, ids, sequence, offset, made_by) gets every piece once its place is final."""

    def __init__(self, emit: Callable[[int, int, bytes, int, int, str], None], first_sequence: int = 0, window: int = WINDOW):
        self.emit, self.window, self.next = emit, window, first_sequence
        self.counts = np.zeros(window + 1, dtype=np.int64)  # of partially filled windows, by fill level
        self.open: dict[int, list[list[tuple[int, int, bytes]]]] = {}

    def _close(self, pieces: list[tuple[int, int, bytes]], made_by: str) -> None:
        offset = 0
        for doc, start, ids in pieces:
            self.emit(doc, start, ids, self.next, offset, made_by)
            offset += len(ids) // 4
        self.next += 1

    def _level(self, size: int) -> int:
        """The fill level to add size tokens to: 0 opens a window."""
        held = np.flatnonzero(self.counts[: self.window - size + 1])
        if not len(held):
            return 0
        counts = self.counts
        after = held + size
        # change of the sum of squares: one window leaves level `held`, one reaches level `after` (a full one leaves)
        change = 1 - 2 * counts[held] + np.where(after < self.window, 2 * counts[np.minimum(after, self.window)] + 1, 0)
        best = int(np.argmin(change))
        opening = 2 * counts[size] + 1
        return int(held[best]) if change[best] <= opening else 0

    def add(self, doc: int, ids: bytes) -> None:
        """All ids of one document."""
        total, window = len(ids) // 4, self.window
        for start in range(0, total - total % window, window):
            self._close([(doc, start, ids[4 * start : 4 * (start + window)])], WHOLE)
        size = total % window
        if not size:
            return
        piece = (doc, total - size, ids[4 * (total - size) :])
        level = self._level(size)
        if level:
            held = self.open[level]
            pieces = held.pop()
            self.counts[level] -= 1
            if not held:
                del self.open[level]
        else:
            pieces = []
        pieces.append(piece)
        if level + size == window:
            self._close(pieces, PLACED)
        else:
            self.open.setdefault(level + size, []).append(pieces)
            self.counts[level + size] += 1

    def finish(self) -> None:
        """Tops up the fullest partially filled windows with what the emptiest hold; powers of two at the very end."""
        held = deque((level, pieces) for level in sorted(self.open) for pieces in self.open[level])
        self.open, self.counts[:] = {}, 0
        giving: deque[tuple[int, int, bytes]] = deque()  # pieces of the emptiest window, which is being given away

        def taken(tokens: int) -> list[tuple[int, int, bytes]]:
            out = []
            while tokens:
                if not giving:
                    giving.extend(held.popleft()[1])
                doc, start, ids = giving.popleft()
                out.append((doc, start, ids[: 4 * tokens]))
                if len(ids) > 4 * tokens:
                    giving.appendleft((doc, start + tokens, ids[4 * tokens :]))
                tokens -= len(out[-1][2]) // 4
            return out

        left = sum(level for level, _ in held)
        while held and left >= self.window:
            level, pieces = held.pop()
            self._close(pieces + taken(self.window - level), TOPPED)
            left -= self.window
        for k in range(self.window.bit_length() - 1, -1, -1):
            if left >> k & 1:
                self._close(taken(1 << k), REST)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, made_by string, ids binary"
#: Pieces, and bytes of their ids, that a task holds before it gives them away.
FLUSH_ROWS, FLUSH_BYTES = 20_000, 8 << 20


def pack_rows(window: int, end_id: int, vocabulary: str | None, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder, end = encoder_of(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        keys: dict[int, tuple[int | None, int]] = {}  # doc_id, tokens; of documents that are not emitted yet
        left: dict[int, int] = {}  # tokens of each still to be emitted
        rows: list[tuple] = []
        held = 0  # bytes of ids in rows

        def emit(doc: int, start: int, ids: bytes, sequence: int, offset: int, made_by: str) -> None:
            nonlocal held
            doc_id, tokens = keys[doc]
            length = len(ids) // 4
            held += len(ids) if with_ids else 0
            rows.append((doc_id, start, length, zlib.crc32(ids), tokens, sequence, offset, made_by, ids if with_ids else None))
            left[doc] -= length
            if not left[doc]:
                del keys[doc], left[doc]

        def flushed() -> pa.RecordBatch:
            nonlocal held
            held = 0
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = {"ids": pa.binary(), "made_by": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)

        packer = Packer(emit, first_sequence=(context.partitionId() if context else 0) << 40, window=window)
        number = 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch_texts(batch.column("text"))
            for a, b in runs_of_texts(texts, TEXT_BYTES):
                for doc_id, ids in zip(doc_ids[a:b], encoder.encode([t.decode("utf-8", "replace") for t in texts[a:b]]), strict=True):
                    ids += end
                    keys[number] = (doc_id, len(ids) // 4)
                    left[number] = len(ids) // 4
                    packer.add(number, ids)
                    number += 1
                    if len(rows) >= FLUSH_ROWS or held >= FLUSH_BYTES:
                        yield flushed()
        packer.finish()
        if rows:
            yield flushed()

    return run


def pack_documents(docs: DataFrame, *, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, made_by and, if asked for, ids.

    docs needs doc_id and text; other columns are ignored. A document's tokens are its text's (none for null or empty
    text) and end_id; each lies in exactly one piece. Pieces of a sequence follow one another from offset 0. A sequence
    has at most `window` tokens and is to be padded to that, except where its fill is a power of two. Repeated rows are
    packed each for itself; rows without a doc_id too. A very long text is many windows. An empty table gives an empty
    result. Sequence ids are unique, not gapless.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(pack_rows(window, end_id, vocabulary, with_ids), SCHEMA)
    return out if with_ids else out.drop("ids")


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), with_ids=False)
