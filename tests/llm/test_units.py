"""The parts of the corpus operators that need no session, against plain restatements."""

import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import exact_dedup, language, linear, minhash, packing, quality, sentence_spans, suffix_dedup, toxicity, warc


def test_fingerprints_combine():
    hasher = exact_dedup.Fingerprinter(chunk=8)
    whole = exact_dedup.Fingerprinter(chunk=1 << 10)
    text = bytes(random.Random(1).choices(range(256), k=100))
    assert hasher.of(text) == whole.of(text)
    left, right = whole.of_chunk(text[:37]), whole.of_chunk(text[37:])
    joined = whole.combine(left, right, 63)
    assert joined[0] << 31 | joined[1] == whole.of(text)
    assert whole.of(b"") == 0 != whole.of(b"\0")
    terms = [whole.shifted(whole.of_chunk(text[i : i + 30]), max(0, 70 - i)) for i in (60, 0, 90, 30)]
    assert sum(a for a, _ in terms) % whole.primes[0] << 31 | sum(b for _, b in terms) % whole.primes[1] == whole.of(text)


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh"])
def test_suffix_order(letters):
    r = random.Random(2)
    blocks = [bytes(r.choices(letters, k=r.choice([10, 60]))) for _ in range(5)]
    data = b"".join(r.choice(blocks) for _ in range(40)) + b"x" * 60
    at = np.array(r.choices(range(len(data) - 58), k=300))
    group = np.array([r.randrange(3) for _ in at])
    order, equal = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), at, group)
    keys = [(group[i], data[at[i] : at[i] + 50]) for i in order]
    assert keys == sorted(keys)
    assert list(equal) == [False] + [a == b for a, b in zip(keys, keys[1:], strict=False)]


def test_anchors_cover_every_window_and_depend_on_it_alone():
    r = random.Random(3)
    texts = [bytes(r.choices(b"abcd", k=n)) for n in (300, 49, 50, 0, 500)]
    texts.append(texts[0][40:240])
    gram, _, which, a, more = suffix_dedup.Anchors().of(texts)
    seen = {}
    for g, t, s, m in zip(gram, which, a, more, strict=True):
        for w in range(s, s + m + 1):
            assert seen.setdefault((t, w), g) == g
    assert sorted(seen) == [(t, w) for t, x in enumerate(texts) for w in range(max(0, len(x) - 49))]
    assert all(seen[5, w] == seen[0, w + 40] for w in range(151))


def test_packed_columns_come_back():
    columns = [(np.arange(5), 3), (np.array([1 << 60, 0, 7, 9, 1]), 8)]
    found, rest = suffix_dedup.unpack_columns(suffix_dedup.pack_columns(columns, b"tail"), (3, 8))
    assert [f.tolist() for f in found] == [c.tolist() for c, _ in columns] and rest == b"tail"


def brute_quality(text):
    words = text.split()
    n = 5
    count = {}
    for i in range(len(words) - n + 1):
        count.setdefault(tuple(words[i : i + n]), []).append(i)
    covered = {i + k for at in count.values() if len(at) > 1 for i in at for k in range(n)}
    lines = [x for x in text.split(b"\n") if x.split()]
    return {
        "n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text.decode()),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_quality_counts():
    r = random.Random(4)
    texts = [" ".join(r.choices(["a", "bé", "c#", "\n", "dd"], k=r.choice([0, 3, 30, 200]))).encode() for _ in range(40)] + [b"", b" \n\t", "é".encode() * 5000]
    figures = quality.measure(texts)
    for i, text in enumerate(texts):
        assert {k: int(figures[k][i]) for k in brute_quality(text)} == brute_quality(text)


def test_quality_hash_collisions_change_nothing():
    texts = [b"a b c d e a b c d e x y z"]
    words = quality.split_words(texts)
    where, group = quality.ngram_groups(words, 5, np.zeros(len(words.ids), np.uint64))
    times = np.bincount(group)
    assert sorted(where[times[group] > 1]) == [0, 5]


def reference_ids(texts, special_as_text=False):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = special_as_text
    return [np.array(e.ids, "<u4").tobytes() for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    texts = ["", " ", "a", "a  b", " a", "a\n\nb", "a \nb", "x\ty", "it's 12\n3 é ü 東京 a", "a b.\nc d", "z " * 300, "no break", "end\n", "<|endoftext|> a", "x 's 't it's"]
    texts += ["hello <|endoftext|> x", "a<|endoftext|>b c", "<|endoftext|>", "x <|endoftext", "|> y"]
    assert packing.Encoder().encode(texts) == reference_ids(texts)
    assert packing.Encoder(special_as_text=True).encode(texts) == reference_ids(texts, True)
    assert reference_ids(texts) != reference_ids(texts, True)


def test_encoder_equals_the_tokenizer_on_all_documents():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    encoder = packing.Encoder(cache_words=3000)
    assert [x for i in range(0, len(texts), 50) for x in encoder.encode(texts[i : i + 50])] == reference_ids(texts)


def test_encoder_equals_the_tokenizer_on_random_characters():
    r = random.Random(9)
    letters = " \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000ab1é東'’.,!<|>stre\U0001f600\u0301\u200b\xad" + " abc" * 5
    texts = ["".join(r.choices(letters, k=r.randrange(1, 40))) for _ in range(5000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(300)]
    assert packing.Encoder().encode(texts) == reference_ids(texts)


class CountingDict(dict):
    """Counts how often it is asked."""

    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def test_encoder_looks_a_distinct_piece_up_once_a_call():
    texts = ["der Fluss, der Fluss\nund das Meer " * 300 + "Ende.", "Meer und Fluss,\nFluss. " * 500 + "Ende"]
    encoder = packing.Encoder()
    encoder._later, encoder._older, encoder._first = CountingDict(), CountingDict(), CountingDict()
    assert encoder.encode(texts) == reference_ids(texts)
    assert encoder._later.asked + encoder._older.asked + encoder._first.asked < 100


def random_ids(r, n):
    return {i: np.array(r.choices(range(1000), k=r.choice([1, 5, 30, 63, 64, 65, 200])), "<u4").tobytes() for i in range(n)}


def packed(docs, window=64):
    pieces = []
    packer = packing.Packer(lambda *x: pieces.append(x), window=window)
    for i, ids in docs.items():
        packer.add(i, ids)
    packer.finish()
    return pieces


def test_packer_places_every_token_once():
    docs = random_ids(random.Random(5), 300)
    back, fills = {}, {}
    for doc, start, ids, sequence, offset, _ in sorted(packed(docs), key=lambda p: (p[0], p[1])):
        assert len(back.setdefault(doc, b"")) == 4 * start
        back[doc] += ids
        fills.setdefault(sequence, []).append((offset, len(ids) // 4))
    assert back == docs
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert packed({}) == []


def test_packer_follows_the_sum_of_squares():
    """Placement against a restatement that tries every level and adds up the squares."""
    docs, window = random_ids(random.Random(6), 400), 64
    open_, closed = [], []  # [fill, documents]
    for i, ids in docs.items():
        size = len(ids) // 4 % window
        if not size:
            continue
        counts = {}
        for fill, _ in open_:
            counts[fill] = counts.get(fill, 0) + 1

        def squares(level):
            after = dict(counts)  # noqa: B023
            if level:
                after[level] -= 1
            if level + size < window:  # noqa: B023
                after[level + size] = after.get(level + size, 0) + 1  # noqa: B023
            return sum(n * n for n in after.values())

        levels = [k for k in sorted(counts) if k + size <= window]
        best = min(levels, key=lambda k: (squares(k), k), default=0)
        if not levels or squares(0) < squares(best):
            open_.append([size, [i]])
            continue
        at = max(n for n, (fill, _) in enumerate(open_) if fill == best)
        fill, held = open_.pop(at)
        (closed if fill + size == window else open_).append([fill + size, [*held, i]])
    found = {}
    for doc, _, _, sequence, _, made_by in packed(docs):
        if made_by == packing.PLACED:
            found.setdefault(sequence, []).append(doc)
    assert sorted(found.values()) == sorted(held for _, held in closed)
    # of the windows that were still open all but the emptiest, which are given away, keep what they hold
    ways = {p[3]: p[5] for p in packed(docs)}
    topped = sum(w == packing.TOPPED for w in ways.values())
    assert topped == sum(fill for fill, _ in open_) // window and len(found) > 3 * topped


def test_warc_ranges_find_every_record_once():
    r = random.Random(6)
    payloads = [b"", b"\x1f\x8b\x08" * 50, bytes(r.choices(range(256), k=5000)), b"<p>" * 1000]
    archive = b"".join(warc.gzip_member(warc.record_bytes("response", i, "http://x/", p, None)) for i, p in enumerate(payloads))
    for step in (37, 1000, 1 << 20):
        found = [d for s in range(0, len(archive), step) for _, d in warc.records_in_range(io.BytesIO(archive), s, min(s + step, len(archive)), read_bytes=64)]
        assert [warc.parse_record(d)["payload"] for d in found] == payloads


def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(7)
    darts = minhash.DartMinHash(2000)
    base = r.integers(0, 1 << 63, 60).astype(np.uint64)
    weights = r.integers(1, 4, 60).astype(float)
    other = weights.copy()
    other[:20] = r.integers(1, 4, 20)
    signatures = darts.signatures(np.concatenate([base, base[5:]]), np.repeat([0, 1], [60, 55]), np.concatenate([weights, other[5:]]), 2)
    a, b = weights, np.concatenate([np.zeros(5), other[5:]])
    assert abs((signatures[0] == signatures[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    alone = darts.signatures(base, np.zeros(60, int), weights, 1)
    assert (alone[0] == signatures[0]).all()
    assert not darts.signatures(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0), 1).any()


def test_missed_links():
    assert minhash.missed(0.8) < 1e-5 and minhash.missed(0.95) < 1e-12


def test_spans():
    pieces, numbers, found = sentence_spans.pieces_of(b"One two. Three!\n\nFour five? six")
    assert b"".join(pieces) == b"One two. Three!\n\nFour five? six" and found == [b"One two.", b"Three!", b"Four five?", b"six"]
    a, check, lengths = sentence_spans.spans_of(found * 2, 2, 4)
    assert lengths.tolist() == [3, 3, 3, 3, 3, 3] and a[0] == a[4] and check[1] == check[5] and a[0] != a[1]


def test_classifiers_learn():
    r = np.random.default_rng(8)
    model = linear.Ftrl(50, 3, alpha=1.0, l1=0.01, l2=0.01)
    for _ in range(600):
        label = int(r.integers(3))
        model.learn(np.array([label, 10 + int(r.integers(40))]), np.ones(2), label)
    w = model.weights()
    assert all(np.argmax(w[i] + w[-1]) == i for i in range(3))
    scores = r.normal(size=(200, 3)) * 10
    assert 2 < linear.temperature(scores, np.array([r.choice(3, p=linear.softmax(s / 5)) for s in scores])) < 12


def test_letters_only():
    assert language.ngram_counts("12 .,!") is None and language.ngram_counts("") is None
    a, b = language.ngram_counts("Ab, c"), language.ngram_counts("ab   C!")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert [len(x) for x in toxicity.Featurizer(1 << 10)(None)] == [0, 0]
    words, pairs = toxicity.Featurizer(1 << 20)("One two one THREE")
    assert len(set(words)) == 3 and len(pairs) == 3 + 2
    index, value = toxicity.distinct(words, pairs)
    assert len(index) == 8 and sorted(value) == [toxicity.PAIR] * 5 + [1.0] * 3


def test_cut():
    text = bytes(range(200))
    kept, removed, runs = suffix_dedup.cut(text, np.array([10, 130]), np.array([5, 0]))
    assert kept == text[:10] + text[65:130] + text[180:] and (removed, runs) == (105, 2)
    assert hashlib.sha256(suffix_dedup.cut(text, np.zeros(0, int), np.zeros(0, int))[0]).hexdigest() == hashlib.sha256(text).hexdigest()


def test_blobs_of_the_suffix_dedup_travel_compressed():
    blob = suffix_dedup.pack_columns([(np.arange(5000) // 7, 8), (np.arange(5000) % 90, 4)])
    sent = suffix_dedup._rows([(0, suffix_dedup.ANCHORS, blob), (0, suffix_dedup.TEXTS, b"packed")]).column("data").to_pylist()
    assert len(sent[0]) * 10 < len(blob) and sent[1] == b"packed"
    assert suffix_dedup.unpacked(suffix_dedup.ANCHORS, sent[0]) == blob


def test_packing_gives_ids_away_by_bytes(monkeypatch):
    """A task held the ids of 20,000 pieces, whatever their size."""
    from tidewright.llm import packing

    texts = [" ".join(f"word{i}" for i in range(3000)) for _ in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = packing.pack_rows(packing.WINDOW, packing.END_ID, None, True)
    whole = list(run(iter([batch])))
    monkeypatch.setattr(packing, "FLUSH_BYTES", 100_000)
    parts = list(run(iter([batch])))
    assert len(whole) == 1 and len(parts) > 5 and sum((b.to_pylist() for b in parts), []) == whole[0].to_pylist()
    assert all(sum(map(len, b.column("ids").to_pylist())) < 200_000 for b in parts[:-1])
