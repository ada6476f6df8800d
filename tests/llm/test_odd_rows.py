"""Rows without a doc_id, rows that share one, texts beyond a chunk and a step, hash collisions; and the operators' SQL."""

import datetime
import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from tidewright.llm import exact_dedup, language, minhash, mixing, packing, quality, queries, sentence_spans, suffix_dedup, toxicity, warc

R = random.Random(21)


def words(n):
    return " ".join("".join(R.choices("abcdefghijklmnop", k=R.choice([3, 6, 9]))) for _ in range(n))


LONG = words(220_000)  # about 1.5 MB: several chunks, and beyond a step of the anchors
ODD = [(None, words(60)), (None, None), (1, words(60)), (1, words(80)), (2, LONG), (3, "x " + LONG + " y"), (4, LONG.replace(" ", "  ")), (5, ""), (None, LONG[:5000])]
ODD += [(6, ODD[2][1] + " " + words(5)), (7, ODD[3][1]), (7, ODD[3][1])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if n % 2 else "de", "s") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_every_row_has_a_result(docs):
    assert quality.quality_rules(docs).count() == len(ODD)
    assert {r["doc_id"]: r["n_words"] for r in quality.quality_rules(docs).collect()}[2] == 220_000
    assert minhash.near_classes(docs).count() == len(ODD)
    mixed = mixing.mix_sources(docs)
    assert mixed.count() == len(ODD) and mixed.where("doc_id = 2").first()["size"] == 220_000
    assert toxicity.score_toxicity(docs, (np.zeros(0, np.int64), np.zeros(0, np.float32))).count() == len(ODD)
    assert language.identify_languages(docs, None).count() == len(ODD)
    assert sentence_spans.remove_repeated_spans(docs).count() == len(ODD)
    pieces = packing.pack_documents(docs).select("doc_id", "length", "doc_tokens").collect()
    encode = packing.Encoder()
    assert sum(r["length"] for r in pieces) == sum(len(encode(t or "")) // 4 + 1 for _, t in ODD)


def test_quality_filter_keeps_what_the_rules_keep(docs):
    kept = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in quality.keep_quality(docs).collect()), key=repr)
    marks = quality.verdicts(quality.measure([(t or "").encode() for _, t in ODD]))["kept"]
    assert kept == sorted(((i is None, i, t) for (i, t), k in zip(ODD, marks, strict=True) if k), key=repr) and 0 < len(kept) < len(ODD)
    assert quality.keep_quality(docs.limit(0)).count() == 0


def test_suffix_dedup_of_odd_rows(docs):
    found = suffix_dedup.remove_repeated_bytes(docs, parts=3, flush_bytes=400_000)
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in found.collect()]
    windows, want = {}, []
    texts = [(i, (t or "").encode()) for i, t in ODD]
    for i, b in texts:
        for s in range(len(b) - 49) if i is not None else ():
            w = b[s : s + 50]
            windows[w] = min(i, windows.get(w, i))
    for i, b in texts:
        gone = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - 49) if i is not None else ():
            if windows[b[s : s + 50]] < i:
                gone[s] += 1
                gone[s + 50] -= 1
        hole = np.cumsum(gone)[:-1] > 0
        want.append((i, len(b), int(hole.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~hole].tobytes()).hexdigest()))
    assert sorted(rows, key=repr) == sorted(want, key=repr) and sum(x[2] for x in want) > 1_500_000


def test_unequal_texts_under_equal_hashes_stop_the_suffix_dedup():
    key = np.array([7, 7], np.int64)
    blob = lambda digests: [(suffix_dedup.DIGESTS, suffix_dedup.pack_columns([(key, 8)], b"".join(digests)))]
    suffix_dedup.verify(blob([b"a" * 16, b"a" * 16]))
    for digests in ([b"a" * 16, b"b" * 16],):
        with pytest.raises(RuntimeError):
            suffix_dedup.verify(blob(digests))
    data = np.frombuffer(b"0123456789" * 20, np.uint8)
    assert suffix_dedup.agree(data, np.array([0, 0, 3]), np.array([10, 11, 13]), np.array([50, 60, 82])).tolist() == [True, False, True]


def exact_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return sorted(((i, min(g)[3], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, i in g), key=repr), len(groups)


@pytest.mark.parametrize("options", [{}, {"huge": 1000}, {"primes": (3, 5)}, {"primes": (3, 5), "huge": 500, "bloom_bits": 64}])
def test_exact_classes_of_odd_rows(spark, docs, options):
    """Also with moduli so small that unequal texts of one length share their fingerprint, and a filter that is full."""
    rows = ODD + [(100 + i, "".join(R.choices("ab", k=3))) for i in range(60)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(ODD) :], "doc_id long, text string"))
    found = exact_dedup.exact_classes(table, **options).collect()
    want, groups = exact_groups(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=repr) == want
    assert sum(r["kept"] for r in found) == groups


def test_near_classes_by_brute_force_on_multisets(spark):
    """Repeated lines make the multiset's similarity differ from the set's: both kinds, all links, all classes."""
    rows = []
    for g in range(25):
        base = words(R.choice([6, 40, 150])).split()
        for k in range(4):
            copy = [("new" + w if R.random() < R.choice([0.0, 0.01, 0.03]) else w) for w in base]
            rows.append((len(rows), " ".join(copy + base[:8] * R.choice([0, 0, 3, 9]))))
    sets = []
    for _, t in rows:
        w, count = t.split(), {}
        for i in range(max(1, len(w) - 4)):
            count[tuple(w[i : i + 5])] = count.get(tuple(w[i : i + 5]), 0) + 1
        sets.append(count)
    for weighted in (True, False):
        parent, differ = list(range(len(rows))), 0

        def root(x):
            while parent[x] != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for a in range(len(rows)):
            for b in range(a):
                keys = sets[a].keys() & sets[b].keys()
                common = sum(min(sets[a][k], sets[b][k]) if weighted else 1 for k in keys)
                union = (sum(sets[a].values()) + sum(sets[b].values()) if weighted else len(sets[a]) + len(sets[b])) - common
                if 5 * common >= 4 * union:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
                    differ += 1
        found = minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), weighted=weighted, block=7)
        assert {r["doc_id"]: r["class_id"] for r in found.collect()} == {i: root(i) for i in range(len(rows))} and differ > 20


def test_language_filter_rejects_an_unlearned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").repartition(8)
    model = language.fit_language_model(docs.where("lang <> 'de'"))
    stays = lambda df: language.keep_identified(df, model).count() / df.count()
    assert stays(docs.where("lang = 'de' and length(text) > 200")) < 0.5
    assert stays(docs.where("lang <> 'de' and length(text) > 50")) > 0.99


def test_language_held_out(spark):
    path = "/root/testdata/sf0.01"
    found = language.op5_language_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.98


def test_samples_are_bounded_under_repeats(spark):
    one = spark.range(3000).selectExpr("1 as doc_id", "'the same text again' as text", "'en' as lang")
    other = spark.range(50).selectExpr("id + 10 as doc_id", "concat('texte autre ', id) as text", "'fr' as lang")
    model = language.fit_language_model(one.union(other), per_language=20)
    assert list(model["languages"]) == ["en", "fr"] and language.predict(model, "texte autre")[0] == "fr"
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    few = toxicity.fit_toxicity(one.limit(1).union(other), labels, train_rows=60)
    many = toxicity.fit_toxicity(one.union(other), labels, train_rows=60)
    assert (few[0] == many[0]).all() and (few[1] == many[1]).all()


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet").where("toxic is not null")
    found = toxicity.op10_toxicity(spark, path).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 == r["toxic"] for r in found)
    assert hit / sum(r["predicted"] for r in found) > 0.9 and hit / sum(r["toxic"] for r in found) > 0.65


def test_warc_of_a_long_page(spark):
    from tidewright.llm.common import scratch_path

    pages = spark.createDataFrame([(1, "u", LONG), (2, "u", LONG), (None, None, None)], "page_id long, url string, html string")
    found = warc.read_warc(warc.write_warc(warc.with_record_types(pages), scratch_path(spark, "t")), range_bytes=100_000).collect()
    assert sorted((r["record_type"], r["payload_bytes"]) for r in found) == [("response", 0), ("response", len(LONG)), ("revisit", len(LONG))]


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return str(x)
    return x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == want
