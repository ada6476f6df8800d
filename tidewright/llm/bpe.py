"""Byte-level BPE: encoding in batched numpy merge rounds, and decoding.

Texts are cut into words by the vocabulary's pattern. Words that a worker has not met lately lie one after another in one
flat array of symbols. In a round, all pairs of neighbours are looked up together by binary search over the sorted keys
of the pairs that merge, each word's lowest rank is found, and every occurrence of it in the word is merged, of
overlapping ones the first. A merged pair's symbol is part of pairs of higher ranks only, so a round does what merging one
pair at a time would do. Words of many symbols, whose rounds would each pass over all of them, are merged by a heap
instead; the ids are the same.

Everything happens in the task that reads the documents; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, islice
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_texts, documents, runs_of_texts
from .packing import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Words kept known in a worker; when there are more, those not met lately go.
CACHE_WORDS = 150_000
#: Words of more bytes than this are merged by a heap.
LONG_WORD = 2048
#: Texts of more characters than this are cut, and words taken, in parts.
LONG_TEXT = 1 << 20
WORDS_AT_ONCE = 200_000
NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """How byte-level vocabularies spell each byte: visible Latin-1 characters stand for themselves, the rest follow 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


def character_class(wanted: Callable[[str], bool], end: int) -> str:
    """The inside of a regular expression's class of all wanted characters before `end`, as ranges."""
    edges = np.flatnonzero(np.diff(np.array([0, *map(wanted, map(chr, range(end))), 0], np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


def word_pattern(end: int) -> re.Pattern:
    """Contractions, letters, digits and others with a blank before them, white space; for texts of characters before `end`."""
    letter = character_class(lambda c: unicodedata.category(c)[0] == "L", end)
    digit = character_class(lambda c: unicodedata.category(c)[0] == "N", end)
    space = character_class(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f", end)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


class ByteBpe:
    """Encodes and decodes with the vocabulary file of a byte-level BPE tokenizer."""

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS, long_word: int = LONG_WORD):
        self._path = path or vocabulary_path(VOCABULARY)
        with open(self._path, encoding="utf-8") as file:
            told = json.load(file)
        model, before = told["model"], told["pre_tokenizer"] or {}
        added = told["added_tokens"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told["normalizer"]
        if model["type"] != "BPE" or not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {self._path}")
        spelled = byte_characters()
        byte_of = {c: b for b, c in enumerate(spelled)}
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self._size = 1 + max([*vocabulary.values(), *self.special.values()])
        self._bytes = [b""] * self._size
        for token, i in vocabulary.items():
            self._bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self._bytes[i] = token.encode()
        self._decimal = [b"%d" % i for i in range(self._size)]
        self._of_byte = np.array([vocabulary[c] for c in spelled], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] * self._size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)[order]
        self._words, self._wide_words, self._met = word_pattern(0x10000), word_pattern(0x110000), set()
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._most, self._long = cache_words, long_word
        self._known: dict[str, list[int]] = {}
        self._older: dict[str, list[int]] = {}
        self._library = None

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it does not merge) and its place among the sorted keys."""
        wanted = left * self._size + right
        at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
        return np.where(self._keys[at] == wanted, self._ranks[at], NONE), at

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by rounds over all words together; no word may be empty."""
        symbols = self._of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank, place = self._looked_up(symbols[:-1], symbols[1:])
            rank = np.append(np.where(word[1:] == word[:-1], rank, NONE), NONE)
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            active = least < NONE
            at = np.flatnonzero((rank == least) & active)
            if len(at):  # of occurrences that overlap, every other one
                run = np.concatenate([[True], np.diff(at) != 1])
                start = at[run][np.cumsum(run) - 1]
                at = at[(at - start) % 2 == 0]
                symbols[at] = self._merged[place[at]]
                active[at + 1] = False
            finished = least == NONE
            done.append((word[finished], symbols[finished]))
            symbols, word = symbols[active], word[active]
        if not done:
            return []
        word, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        ids, ends = symbols[order].tolist(), np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one word, merging one pair at a time: the lowest rank first, then the leftmost."""
        symbols = self._of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []
        rank, place = self._looked_up(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        for i in np.flatnonzero(rank < NONE).tolist():
            heap.append((int(rank[i]), i, symbols[i], symbols[i + 1]))
        table = {}

        def pair(left: int, right: int) -> tuple[int, int]:
            if (left, right) not in table:
                r, p = self._looked_up(np.array([left]), np.array([right]))
                table[left, right] = (int(r[0]), int(self._merged[p[0]]))
            return table[left, right]

        heapq.heapify(heap)
        end = len(symbols)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else end
            if j >= end or symbols[j] != right:
                continue
            symbols[i], symbols[j] = pair(left, right)[1], -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else end
                if b < end and (found := pair(symbols[a], symbols[b])[0]) < NONE:
                    heapq.heappush(heap, (found, a, symbols[a], symbols[b]))
        return [s for s in symbols if s >= 0]

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, special tokens among them, in parts."""
        pieces = self._special.split(text) if self._special else [text]
        for piece in pieces:
            if piece in self.special:
                yield [piece]
                continue
            characters = set(piece)
            self._met.update(c for c in characters - self._met if unicodedata.category(c) != "Cn")
            pattern = self._words if not characters or max(characters) < "\U00010000" else self._wide_words
            if not characters <= self._met:  # no category here, but maybe one in the tokenizer's own tables
                yield [piece[a:b] for _, (a, b) in self._cutter().pre_tokenize_str(piece)]
            elif len(piece) <= LONG_TEXT:
                yield pattern.findall(piece)
            else:
                found = (m.group() for m in pattern.finditer(piece))
                while part := list(islice(found, WORDS_AT_ONCE)):
                    yield part

    def _cutter(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return self._library

    def _learn(self, words: set[str]) -> None:
        """Makes the ids of all these words known."""
        if len(self._known) > self._most:
            self._older, self._known = self._known, {}
        new = words.difference(self._known)
        if held := new.intersection(self._older):
            self._known.update({w: self._older[w] for w in held})
            new -= held
        spelled = {w: w.encode("utf-8", "replace") for w in new if w not in self.special}
        short = [w for w, b in spelled.items() if len(b) <= self._long]
        self._known.update(zip(short, self.merge_words([spelled[w] for w in short]), strict=True))
        self._known.update((w, self.merge_long(b)) for w, b in spelled.items() if len(b) > self._long)
        self._known.update((w, [self.special[w]]) for w in new if w in self.special)

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in parts."""
        for part in self.words(text):
            self._learn(set(part))
            yield list(chain.from_iterable(map(self._known.__getitem__, part)))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that are not long: new words of all of them are merged together."""
        cut = [list(chain.from_iterable(self.words(t))) for t in texts]
        self._learn(set().union(*cut))
        return [list(chain.from_iterable(map(self._known.__getitem__, words))) for words in cut]

    def decimals(self, ids: list[int]) -> bytes:
        return b",".join(map(self._decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of these ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


def bpe_of(path: str | None) -> ByteBpe:
    """The coder of this process: the vocabulary is read, and words are learnt, once for all tasks that a worker runs.

    This package's code travels to workers with each task, so its own module variables would be new in each.
    """
    held = sys.modules.setdefault("_tidewright_coders", ModuleType("_tidewright_coders")).__dict__
    if path not in held:
        held[path] = ByteBpe(path)
    return held[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encode_rows(vocabulary: str | None, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe_of(vocabulary)

        def row(doc_id: int | None, parts: Iterator[list[int]]) -> tuple:
            count, decimal, decoded, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            for ids in parts:
                if ids:
                    decimal.update((b"," if count else b"") + coder.decimals(ids))
                    decoded.update(coder.decode(ids).encode())
                    count += len(ids)
                    if with_ids:
                        kept.append(np.array(ids, "<u4").tobytes())
            return doc_id, count, decimal.hexdigest(), decoded.hexdigest(), b"".join(kept) if with_ids else None

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch_texts(batch.column("text"))
            for a, b in runs_of_texts(texts):
                plain = [t.decode("utf-8", "replace") for t in texts[a:b]]
                parts = [coder.encode(plain[0])] if len(plain) == 1 else ([ids] for ids in coder.encode_all(plain))
                rows = [row(d, p) for d, p in zip(doc_ids[a:b], parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def encode_documents(docs: DataFrame, *, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian unsigned 32-bit).

    docs needs doc_id and text; other columns are ignored. vocabulary is the path of a byte-level BPE vocabulary on every
    machine (None: that of the public tokenizers). Special tokens named in a text become their ids. ids_sha256 is of the
    decimal ids joined by commas, decoded_sha256 of the text decoded from them. Null and empty texts have no ids. Rows
    that repeat, or have no doc_id, are encoded each for itself; a very long text is encoded in parts, a very long word
    as a whole. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(encode_rows(vocabulary, with_ids), SCHEMA)
    return out if with_ids else out.drop("ids")


def decode_documents(encoded: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (little-endian unsigned 32-bit). Null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe_of(vocabulary)
        for batch in batches:
            texts = [coder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), with_ids=False)
