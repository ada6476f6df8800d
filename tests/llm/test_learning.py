"""The toxicity model against a restatement with plain dictionaries and floats."""

import hashlib
import math
import random
import re

import xxhash
from pyspark.sql import functions as F

from tidewright.llm import toxicity

R = random.Random(21)
MASK = (1 << 64) - 1
MARKS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def spread(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def features(text, dims):
    """Number -> value: words 1, pairs and pairs with one word between PAIR."""
    words = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
    number = lambda h: spread(h) >> (64 - dims.bit_length() + 1)
    out = {number((a * m + b) & MASK): toxicity.PAIR for k, m in ((1, MARKS[1]), (2, MARKS[2])) for a, b in zip(words, words[k:])}
    return out | {number(w * MARKS[0] & MASK): 1.0 for w in words}


def learnt(rows, dims, epochs, alpha=0.3, beta=1.0, l1=1.0, l2=0.5):
    z, n = {}, {}

    def weight(k):
        a, b = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2)

    for _ in range(epochs):
        for text, label in rows:
            held = features(text, dims) | {dims: 1.0}
            margins = [sum(v * weight((i, c)) for i, v in held.items()) for c in (0, 1)]
            top = [math.exp(m - max(margins)) for m in margins]
            change = {}
            for c in (0, 1):
                error = top[c] / sum(top) - (c == label)
                for i, v in held.items():
                    g, k = v * error, (i, c)
                    after = n.get(k, 0.0) + g * g
                    change[k] = (z.get(k, 0.0) + g - (math.sqrt(after) - math.sqrt(n.get(k, 0.0))) / alpha * weight(k), after)
            for k, (a, b) in change.items():
                z[k], n[k] = a, b
    return {i: weight((i, 1)) - weight((i, 0)) for i in {i for i, _ in z} if weight((i, 1)) != weight((i, 0))}


def test_toxicity(spark):
    bad, words = ["vile", "rot", "scum"], ["sea", "wind", "shore", "wave", "sand", "rock"]
    rows = []
    for i in range(60):
        toxic = int(R.random() < 0.4)
        rows.append((i, " ".join(R.choices(words, k=R.randint(1, 12)) + R.choices(bad, k=2 * toxic)).capitalize() + ".", toxic))
    rows += [(60, None, 0), (61, "", 1), (62, "one", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    dims = 1 << 12
    index, weights = toxicity.fit_toxicity(docs, labels, dims=dims, epochs=2)
    order = sorted((r for r in rows if r[2] is not None), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    want = learnt([(r[1], r[2]) for r in order], dims, 2)
    found = dict(zip(index.tolist(), weights.tolist(), strict=True))
    assert len(want) > 4 and {i: w for i, w in want.items() if abs(w) > 1e-6}.keys() <= found.keys() <= want.keys()
    assert all(math.isclose(found[i], want[i], rel_tol=1e-4, abs_tol=1e-6) for i in found)
    for r in toxicity.score_toxicity(docs, (index, weights), dims=dims).collect():
        text = rows[r["doc_id"]][1]
        margin = want.get(dims, 0.0) + sum(v * want.get(i, 0.0) for i, v in features(text, dims).items())
        assert math.isclose(r["score"], 1 / (1 + math.exp(-margin)), rel_tol=1e-3) and r["predicted"] == int(r["score"] >= toxicity.CUT)


def test_held_out_labels_are_never_learnt(spark, sf_dir):
    """Other labels of held-out rows change no score."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out_of(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [
        sorted((r["doc_id"], r["score"]) for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, t.where(~toxicity.held_out_of()))).collect()) for t in (labels, wrong)
    ]
    assert scores[0] == scores[1]
