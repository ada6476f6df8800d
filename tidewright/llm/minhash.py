"""Near-duplicate classes by DartMinHash signatures, banded candidates and exact verification.

Signatures: hashed darts are thrown at the plane of (element, weight, rank). A dart counts for a document if it lands
under the element's weight there, which is how often the shingle occurs; each dart belongs to one coordinate of the
signature, and of a coordinate's darts the one of lowest rank is kept. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. The work is in proportion to the elements plus the coordinates, not
to their product.

Documents with the same multiset of shingles are one from the start. The others are grouped by bands of their
signatures, and links are decided exactly from the shingle counts, so whether one is found rests on the bands only (see
`missed`). First each document of a bucket is compared with the smallest one there, which is linear in the documents;
what these links connect is a class already. Only in buckets that still hold several classes are documents of
different classes compared with one another: clusters of such buckets are cut into blocks, and every pair of blocks is
a task of its own, with an inverted index of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, WHOLE, batch_texts, documents, join_groups, materialize, mix64, runs_of_texts, unwrapped, wrapped
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
BLOCK = 1000
#: Rank axis: cells that double in length up to 32, then cells of 32; a cell of area a holds Poisson(a) darts.
_FIRST, _LONGEST = 1 / 16, 32.0
_SEED = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def missed(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that a pair of this similarity shares no band: 3e-6 at 0.8 with the defaults."""
    return (1 - similarity**rows) ** bands


def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    p, steps, n = math.exp(-area), [], 0
    total = 0.0
    while total < 1 - 1e-15 and n < 400:
        total += p
        steps.append(total)
        n += 1
        p *= area / n
    return np.array(steps)


def _rank_cells() -> Iterator[tuple[float, float]]:
    low, high = 0.0, _FIRST
    while True:
        yield low, high
        low, high = high, high + min(max(high, _FIRST), _LONGEST)


def _weight_cells(most: float) -> Iterator[tuple[float, float]]:
    """Start and height of the cells of the weight axis below `most`: 0, 1, 2, 4, 8, ..."""
    yield 0.0, 1.0
    base = 1.0
    while base < most:
        yield base, base
        base *= 2


def _constant(*parts: int) -> np.uint64:
    x = _SEED
    for part in parts:
        x = (x * 0xBF58476D1CE4E5B9 + part + 1) & _MASK
        x ^= x >> 31
    return np.uint64(x)


class DartMinHash:
    """Signatures of k coordinates for many weighted sets at once."""

    def __init__(self, k: int):
        self.k = k
        self.darts = k * math.log(k) + 2 * k  # enough for every coordinate to get one, most of the time
        self.steps: dict[float, np.ndarray] = {}

    def signatures(self, elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, sets: int) -> np.ndarray:
        """elements: hashes; owner: number of the set of each; weights > 0. A row of k numbers for each set.

        A set without elements gets zeros. Rows depend on a set's own elements and weights only.
        """
        best = np.full(sets * self.k, np.iinfo(np.uint64).max, dtype=np.uint64)
        total = np.bincount(owner, weights, sets)
        reach = np.where(total > 0, self.darts / np.maximum(total, 1e-9), 0.0)  # ranks up to here
        todo = total > 0
        while todo.any():
            chosen = np.flatnonzero(todo[owner])
            self._throw(elements[chosen], owner[chosen], weights[chosen], reach, best)
            # a coordinate is settled once it holds a dart: ranks below the reach have all been seen
            todo &= (best.reshape(sets, self.k) == np.iinfo(np.uint64).max).any(axis=1)
            reach = np.where(todo, reach * 2, reach)
        out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(sets, self.k)
        out[total <= 0] = 0
        return out

    def _throw(self, elements, owner, weights, reach, best) -> None:
        limit = reach[owner]
        for level, (base, height) in enumerate(_weight_cells(float(weights.max()))):
            here = np.flatnonzero(weights > base)
            for number, (low, high) in enumerate(_rank_cells()):
                # a higher cell of the weight axis has shorter cells of the rank axis: areas stay the same
                here = here[limit[here] * height > low]
                if not len(here):
                    break
                area = high - low
                if area not in self.steps:
                    self.steps[area] = _poisson_steps(area)
                draw = (mix64(elements[here] ^ _constant(level, number)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                count = np.searchsorted(self.steps[area], draw, side="right")
                at = np.repeat(here, count)
                if not len(at):
                    continue
                nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                h = mix64(elements[at] + mix64((nth.astype(np.uint64) + np.uint64(1)) * _constant(level, number, 1)))
                rank = (low + area * ((h >> np.uint64(32)).astype(np.float64) / (1 << 32))) / height
                h = mix64(h + np.uint64(_SEED))
                tall = base + height * (h & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32)
                ok = (rank < limit[at]) & (tall < weights[at])
                at, rank, h = at[ok], rank[ok], h[ok]
                coordinate = (((h >> np.uint64(32)) * np.uint64(self.k)) >> np.uint64(32)).astype(np.int64)
                # the bits of a positive float order as it does, whatever its size
                upper = rank.astype(np.float32).view(np.uint32).astype(np.uint64)
                code = (upper << np.uint64(32)) | (mix64(h + np.uint64(1)) >> np.uint64(32))
                np.minimum.at(best, owner[at] * self.k + coordinate, code)


_WEIGHTS = np.array([_constant(7, i) | np.uint64(1) for i in range(64)], dtype=np.uint64)


class Shingler:
    """Hashes of the distinct runs of `words` words of a text; a text of fewer words has one run, all it has."""

    def __init__(self, words: int = WORDS, most_known: int = 200_000):
        self.words, self.most, self.known = words, most_known, {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes, and how often each occurs."""
        tokens = text.split()
        if not tokens:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = xxhash.xxh64_intdigest(token)
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        n = min(self.words, len(h))
        runs = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            runs += mix64(h[i : len(h) - n + 1 + i] ^ _WEIGHTS[i]) * _WEIGHTS[i]
        return np.unique(mix64(runs + np.uint64(n)), return_counts=True)


def signature_rows(words: int, bands: int, rows: int, weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text -> doc_id, mark_a, mark_b (of the set or multiset; null if it is empty), n_shingles, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, darts = Shingler(words), DartMinHash(bands * rows)
        for batch in batches:
            texts = batch_texts(batch.column("text"))
            for a, b in runs_of_texts(texts):
                sets = [shingle(t) for t in texts[a:b]]
                sizes = np.array([len(s) for s, _ in sets])
                elements = np.concatenate([s for s, _ in sets])
                counts = np.concatenate([c for _, c in sets]) if weighted else np.ones(len(elements))
                owner = np.repeat(np.arange(b - a), sizes)
                signatures = darts.signatures(elements, owner, counts.astype(np.float64), b - a).astype(np.uint64)
                keys = np.zeros((b - a, bands), np.uint64)
                for i in range(rows):
                    keys = mix64(keys * np.uint64(_SEED) + signatures.reshape(b - a, bands, rows)[:, :, i] + np.uint64(i + 1))
                keys = mix64(keys + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _constant(3)).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                marks = []
                for salt in (11, 12):
                    values = np.concatenate([[0], np.cumsum(mix64(elements ^ _constant(salt)) * counts.astype(np.uint64))]).astype(np.uint64)
                    marks.append((values[edges[1:]] - values[edges[:-1]]).astype(np.int64))
                empty = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(marks[0], mask=empty), pa.array(marks[1], mask=empty), pa.array(sizes, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "mark_a", "mark_b", "n_shingles", "bands"],
                )

    return run


def set_rows(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, text -> node, its shingles and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for a, b in runs_of_texts(texts := batch_texts(batch.column("text")), 4 << 20):
                sets = [shingle(t) for t in texts[a:b]]
                blobs = [pa.array([s.astype("<u8").tobytes() for s, _ in sets], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), *blobs], names=["node", "shingles", "counts"])

    return run


def similar_links(sets: list[np.ndarray], counts: list[np.ndarray], similarity: float, weighted: bool, first: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links enough to connect what pairs of at least this similarity connect.

    Pairs inside the first `first` sets, and inside the rest, are left out where both parts are given (first > 0): other
    tasks have these. With first = 0 all pairs count. Every pair that shares a shingle is counted exactly. known: the
    classes of the sets so far; links inside one are not needed.
    """
    n = len(sets)
    sizes = np.array([int(c.sum()) if weighted else len(s) for s, c in zip(sets, counts, strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elements, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")  # by shingle, then by set
    postings, times = owner[order], np.concatenate(counts)[order].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(elements)))])
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    named: dict[int, int] = {}
    for x, label in enumerate(known or ()):
        parent[x] = named.setdefault(label, x)
    links = []
    for x in range(max(1, first), n):
        own = number[ends[x] : ends[x + 1]]
        low, size = starts[own], starts[own + 1] - starts[own]
        shared = size > 1
        low, size, mine = low[shared], size[shared], counts[x][shared].astype(np.int64)
        if not len(low):
            continue
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        who = postings[at]
        common = np.bincount(who, np.minimum(times[at], np.repeat(mine, size)), n) if weighted else np.bincount(who, minlength=n)
        upto = first if first else x
        common = common[:upto]
        union = sizes[x] + sizes[:upto] - common
        # the similarity as a ratio of whole numbers, so that 4 of 5 is 0.8
        for y in np.flatnonzero(common >= similarity * union - 1e-9):
            a, b = root(x), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, int(y)))
    return links


def link_groups(similarity: float, weighted: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("node", "ascending")])
        ids = table.column("node").to_pylist()
        sets = [np.frombuffer(x, "<u8").astype(np.uint64) for x in table.column("shingles").to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
        known = table.column("known").to_pylist()
        first = sum(p == 0 for p in table.column("part").to_pylist()) if table.column("part")[0].as_py() >= 0 else 0
        links = similar_links(sets, counts, similarity, weighted, first, known) if len(set(known)) > 1 and first < len(ids) else []
        return pa.table({"src": pa.array([ids[a] for a, _ in links], pa.int64()), "dst": pa.array([ids[b] for _, b in links], pa.int64())})

    return run


LINKS = "src long, dst long"


def near_classes(
    docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True, block: int = BLOCK
) -> DataFrame:
    """Per row: doc_id, class_id, class_size, kept.

    docs needs doc_id and text; other columns are ignored. class_id is the smallest doc_id of all documents that links
    of at least `similarity` connect; similarity is that of the multisets of shingles, or of the sets if not weighted. A
    text without a word (null, empty or blank) is a class of its own; one of fewer words than a shingle has one shingle.
    Very long texts have all their shingles. Repeated rows share a class; all rows with the smallest doc_id are kept.
    Rows that share a doc_id but not the text are joined through it. Rows with a null doc_id are classes of their own
    (class_id null, class_size 1). An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = texts.mapInArrow(signature_rows(words, bands, rows, weighted), "doc_id long, mark_a long, mark_b long, n_shingles int, bands array<long>")
    signed = materialize(signed, "signatures")
    marks = ["mark_a", "mark_b", "n_shingles"]
    # equal multisets are one node, named by their smallest document
    nodes = signed.where("mark_a is not null and doc_id is not null").groupBy(*marks)
    nodes = materialize(nodes.agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.count(F.lit(1)).alias("copies")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band")).distinct()
    buckets = banded.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a node for each bucket that it shares; nodes of several texts under one doc_id are one node here
    shared = materialize(banded.join(buckets, "band").select("band", "first", "node"), "shared-bands")
    stars = shared.where("node <> first").select("first", "node").distinct()

    wanted = shared.select("node").distinct()
    sets = texts.withColumnRenamed("doc_id", "node").join(wanted.hint("merge"), "node", "left_semi").mapInArrow(set_rows(words), "node long, shingles binary, counts binary")
    sets = materialize(sets, "shingle-sets")
    # the smallest node of a bucket against the others, in units of a block
    sizes = stars.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    placed = stars.join(sizes, "first").select("first", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)).alias("own"))
    unit = F.concat_ws("/", "first", "own")
    units = placed.select(unit.alias("unit"), F.lit(1).alias("part"), "node").union(placed.select(unit.alias("unit"), F.lit(0).alias("part"), F.col("first").alias("node")).distinct())
    met = units.join(sets.hint("merge"), "node").withColumn("known", F.col("node"))
    found = materialize(met.groupBy("unit").applyInArrow(link_groups(similarity, weighted), LINKS), "star-links")
    classes = connected_components(found)

    # buckets whose nodes are of several classes: clusters of them, in blocks
    named = shared.join(classes, "node", "left").select("band", "node", F.coalesce("label", "node").alias("known"))
    open_ = named.groupBy("band").agg(F.min("known").alias("least"), F.max("known").alias("most")).where("least <> most")
    waiting = materialize(named.join(open_.select("band", "least"), "band").select("node", "known", "least").distinct(), "open-bands")
    clusters = connected_components(waiting.select(F.col("least").alias("src"), F.col("known").alias("dst")))
    members = waiting.select("node", "known").distinct().join(clusters.select(F.col("node").alias("known"), "label"), "known")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    # a pair of blocks (i, j), i <= j, is a unit; part -1: all pairs inside the unit, 0 and 1: pairs across the parts only
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.concat_ws("/", F.col("label"), F.least(F.col("own"), j), F.greatest(F.col("own"), j)).alias("unit"),
            F.when(j == F.col("own"), -1).when(F.col("own") < j, 0).otherwise(1).alias("part"),
        ),
    )
    units = members.join(sizes, "label").withColumn("own", own).select("node", "known", others.alias("units"))
    met = units.join(sets.hint("merge"), "node").select("node", "known", "shingles", "counts", F.explode("units").alias("at")).select("node", "known", "shingles", "counts", "at.unit", "at.part")
    more = materialize(met.groupBy("unit").applyInArrow(link_groups(similarity, weighted), LINKS), "block-links")
    classes = connected_components(found.union(more))

    groups = materialize(nodes.join(classes, "node", "left").select(*marks, F.coalesce("label", "node").alias("class_id"), "copies"), "near-groups")
    sums = materialize(groups.groupBy("class_id").agg(F.sum("copies").alias("class_size")), "near-classes")
    groups = materialize(groups.join(sums, "class_id"), "near-groups")
    named = signed.select("doc_id", *[F.when(F.col("doc_id").isNotNull(), F.col(m)).alias(m) for m in marks], F.monotonically_increasing_id().alias("_n"))
    out = join_groups(named, groups, marks, "copies", ["_n"])
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def keep_near(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, one of each near-duplicate class: that with the smallest doc_id (null last).

    Texts without a word are no copies of one another. Classes are of rows, so rows may share a doc_id or have none. docs is read more than once, and has to give its rows
    in the same order each time, as a written table does.
    """
    rows = wrapped(docs)
    near = near_classes(rows.select(F.col(ROW).alias("doc_id"), f"{WHOLE}.text"), **options).select(F.col("doc_id").alias(ROW), "class_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW).alias("row"))
    kept = near.join(rows.select(ROW, f"{WHOLE}.doc_id").hint("merge"), ROW).groupBy("class_id").agg(F.min(order)["row"].alias(ROW)).select(ROW)
    return unwrapped(rows.join(kept.hint("merge"), ROW, "left_semi"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
