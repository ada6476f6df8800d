"""Passages that repeat between sentences that differ."""

import random

from tidewright.llm import sentence_spans

R = random.Random(5)


def words(n):
    return " ".join("".join(R.choices("abcdefghijkl", k=8)) for _ in range(n))


def passage(lengths):
    """The end of a sentence, whole sentences of so many words, the start of a sentence."""
    first, *inner, last = lengths
    return f"{words(first)}. " + " ".join(words(n) + "." for n in inner) + f" {words(last)}"


def test_runs_cover_the_end():
    found = [b"a " * 30, b"b " * 5, b"c"]
    _, _, starts, lengths = sentence_spans.runs_of(found, 2, 20, 40)
    assert list(zip(starts.tolist(), lengths.tolist(), strict=True)) == [(0, 2), (0, 3)]


def test_passages_between_other_sentences(spark):
    shapes = [(20, 5, 12, 20), (20, 15, 20), (10, 30, 5, 1, 10), (1, 30, 5, 1, 20), (25, 3, 4, 25), (22, 9, 24)]
    for _ in range(20):
        inner = [R.choice([1, 3, 5, 9, 14]) for _ in range(R.choice([2, 3, 4]))]
        rest = R.randint(50, 60) - sum(inner)
        shapes.append((max(rest // 2, 1), *inner, max(rest - rest // 2, 1)))
    texts, removed = [], []
    for shape in shapes:
        p = passage(shape)
        whole = shape[1:-1]
        removed += [0, len(whole) if len(whole) > 1 and sum(whole) >= 6 or max(whole) >= 8 else 0]
        for _ in range(2):
            texts.append(f"{words(9)}. {words(7)} {p} {words(6)}. {words(11)}.")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in sentence_spans.remove_repeated_spans(docs).collect()}
    assert [found[i] for i in range(len(texts))] == removed and sum(removed) > 60
