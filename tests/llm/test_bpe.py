"""The byte-level BPE against the tokenizers library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import bpe

R = random.Random(9)


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(cache_words=50)


@pytest.fixture(scope="module")
def library(coder):
    return Tokenizer.from_file(coder._path)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_texts_of_any_characters(coder, library):
    some = [*map(chr, range(0x250)), *"́ 　 \x85\x1c᠎ ﻿​", "\U00010940", "\U0001f600", "一", "１", "Ⅰ", "", "\U0010ffff"]
    weighted = some + [" "] * 60 + ["\n"] * 20 + ["'"] * 10 + ["<|endoftext|>"] * 5 + ["aaaa"] * 5 + ["'re", "'ll"] * 3
    texts = ["".join(R.choices(weighted, k=R.randint(0, 60))) for _ in range(1500)]
    assert coder.encode_all(texts) == [ids_of(library, t) for t in texts]
    for t in texts[:300]:
        ids = [i for part in coder.encode(t) for i in part]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_every_character_is_cut_as_the_library_does(coder, library):
    for plane in (range(0, 0xD800), range(0xE000, 0x33500), range(0xE0000, 0xE0200)):
        for at in range(plane.start, plane.stop, 64):
            text = "".join(f"a{c} {c}1{c}{c}" for c in map(chr, range(at, min(at + 64, plane.stop))))
            assert [w for part in coder.words(text) for w in part] == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_long_words_by_either_way(coder, library):
    for k in (1, 2, 3, 50, 700, 5001):
        for letters in ("abetth", "a", "etaoinshrdlu"):
            word = "".join(R.choices(letters, k=k))
            want = ids_of(library, word)
            assert coder.merge_long(word.encode()) == want
            assert coder.merge_words([b"the", word.encode(), b"a"])[1] == want


def test_merges_come_after_what_they_are_made_of(coder, library):
    """Then a round may merge all occurrences of a word's lowest pair at once."""
    ranks = dict(zip(coder._merged.tolist(), coder._ranks.tolist(), strict=True))
    for key, rank in zip(coder._keys.tolist(), coder._ranks.tolist(), strict=True):
        assert all(ranks.get(part, -1) < rank for part in divmod(key, coder._size))


def test_long_texts_in_parts(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 7)
    text = " ".join("".join(R.choices("abcdefghäöü.,'1 \n", k=9)) for _ in range(400)) + "<|endoftext|> end"
    parts = list(coder.encode(text))
    assert len(parts) > 9 and [i for p in parts for i in p] == ids_of(library, text)


def test_documents(spark, library):
    rows = [(1, "Hello there. "), (None, "no id"), (2, None), (3, ""), (4, "hello <|endoftext|> x"), (5, "word " * 300_000), (1, "again"), (6, "x" * 9000), (7, "퟿ \U0001f468‍\U0001f469")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    encoded = bpe.encode_documents(df)
    found = sorted((tuple(r) for r in encoded.drop("ids").collect()), key=repr)
    want = []
    for doc_id, text in rows:
        ids = ids_of(library, text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == sorted(want, key=repr)
    assert sorted((tuple(r) for r in bpe.decode_documents(encoded).collect()), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert bpe.encode_documents(df.limit(0)).collect() == []


def test_whole_table(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = bpe.op13_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = ids_of(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
