"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import exact_dedup, language, minhash, mixing, packing, quality, sentence_spans, suffix_dedup, toxicity, warc

R = random.Random(11)
WORDS = ["".join(R.choices("abcdefghij", k=R.choice([2, 4, 7]))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(w + ("." if r.random() < 0.15 else "") for w in r.choices(WORDS, k=n))


def make_rows():
    passage, long = prose(70), prose(6000)
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    out = [(i, prose(R.choice([12, 80, 200])), "en" if i % 2 else "de", f"s{i % 3}") for i in range(30)]
    out += [(30, base, "en", "s0"), (31, " ".join(near), "en", "s0"), (32, base, "en", None), (33, base.replace(" ", "  "), None, "s1")]
    out += [(40 + i, prose(30) + ". " + passage + ". " + prose(20), "en", "s0") for i in range(6)]
    out += [(50, None, "en", "s0"), (51, "", "de", "s1"), (52, " \n\t", None, "s2"), (53, long, "en", "s0"), (54, long, "en", "s2"), (55, "ä", "de", "s1"), (56, "same line\n" * 40, "en", "s1")]
    out += [(30, base, "en", "s0"), (60, "1234 !!", "en", "s0"), (61, "one two three", "en", "s0"), (62, "one two three", "en", "s0")]
    return out


ROWS = make_rows()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    extra = {c: F.lit("x") for c in ("size", "taken", "row", "kept", "class_id", "label", "node", "target", "bucket", "score", "start", "length", "digest")}
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def test_exact(docs, empty):
    found = exact_dedup.exact_classes(docs)
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    want = []
    for key, members in groups.items():
        want += [(i, min(members)[1], len(members), hashlib.sha256(key.encode()).hexdigest()) for _, i in members]
    assert table(found, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert found.where("kept").count() == len(groups)
    assert exact_dedup.exact_classes(empty).count() == 0
    kept = exact_dedup.keep_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def brute_bytes(table):
    first = {}
    data = {i: (t or "").encode() for i, t, *_ in table}
    for i, b in data.items():
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    out = []
    for i, t, *_ in table:
        b = data[i]
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("many", [4096, 1])
def test_suffix_dedup(docs, empty, many):
    found = suffix_dedup.remove_repeated_bytes(docs, parts=3, flush_bytes=5000, many=many)
    assert table(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows())
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_near(docs, empty):
    sets = {}
    for i, t, *_ in rows():
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for block in (1000, 2):
        assert table(minhash.near_classes(docs, block=block), "doc_id", "class_id") == sorted(((i, root(i)) for i, *_ in rows()), key=repr)
    assert minhash.near_classes(docs, weighted=True).count() == len(rows())
    assert minhash.near_classes(empty).count() == 0
    assert minhash.keep_near(docs).columns == docs.columns


def test_mix(docs, empty):
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows()) and mixing.mix_sources(empty).count() == 0
    sizes, total = {}, 0
    for _, t, _, s in rows():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(k for k in sizes if k is not None) + [None]
    weights = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * level > 2 * sizes[k]}
        for k in full or open_:
            target[k] = 2.0 * sizes[k] if full else weights[k] * level
            left -= target[k]
        open_ -= full or open_
    by_id = {i: s for i, _, _, s in rows()}
    taken = dict.fromkeys(names, 0)
    for r in found:
        assert r["source_size"] == sizes[by_id[r["doc_id"]]] and r["target"] == pytest.approx(target[by_id[r["doc_id"]]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[by_id[r["doc_id"]]] += r["taken"]
        total += r["taken"]
    assert total <= 1.5 * sum(sizes.values())
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))
    out = mixing.apply_mix(docs, mixing.mix_sources(docs))
    assert out.columns == docs.columns


def test_quality(docs, empty):
    found = quality.quality_rules(docs)
    assert found.count() == len(rows()) and quality.quality_rules(empty).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert kept[0] is not None and not kept[50] and not kept[56] and kept[53] and kept[40]


def test_spans(docs, empty):
    found = {r["doc_id"]: r for r in sentence_spans.remove_repeated_spans(docs, flush_bytes=4000).collect()}
    assert found[40]["n_removed"] == 0 and all(found[i]["n_removed"] > 0 for i in range(41, 46))
    assert found[50]["kept_text"] == "" and found[53]["n_removed"] == 0 and found[54]["kept_text"].strip() == ""
    assert sentence_spans.remove_repeated_spans(empty).count() == 0


def test_pack(docs, empty):
    found = packing.pack_documents(docs).collect()
    encode = packing.Encoder()
    want = sorted((i, len(encode(t or "")) // 4 + 1) for i, t, *_ in rows())
    tokens = {}
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {i: sum(n for j, n in want if j == i) for i, _ in want}
    fills = {}
    for r in found:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills.values())
    assert packing.pack_documents(empty).count() == 0


def test_language(docs, empty):
    model = language.fit_language_model(docs)
    found = {r["doc_id"]: r for r in language.identify_languages(docs, model).collect()}
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (50, 51, 52, 60))
    assert set(model["languages"]) == {"de", "en"} and 0 < found[1]["score"] <= 1
    assert language.fit_language_model(empty) is None and language.identify_languages(empty, None).count() == 0
    assert language.identify_languages(docs, None).where("lang_pred <> 'und'").count() == 0
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()}.isdisjoint({50, 51, 52, 60})


def test_toxicity(spark, docs, empty):
    bad = [(i, prose(20) + (" vile scum " if i % 4 == 0 else " fine day ") + prose(20)) for i in range(400)]
    texts = spark.createDataFrame(bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(300)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit_toxicity(texts, labels)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(texts, model).collect()}
    assert all(found[i] == int(i % 4 == 0) for i in range(300, 400))
    assert len(model[0]) < 2000
    scores = toxicity.score_toxicity(docs, model)
    assert scores.count() == len(rows()) and scores.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert len(toxicity.fit_toxicity(texts, labels.limit(0))[0]) == 0


def test_warc(spark):
    from tidewright.llm.common import scratch_path

    html = [(1, "http://a", "x" * 100), (2, "http://b", "y"), (3, None, "x" * 100), (4, "http://d", None), (5, "u", ""), (9, "http://a\n", "<p>é</p>" * 4000), (9, "http://a\n", "<p>é</p>" * 4000), (None, "n", "z")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    manifest = warc.write_warc(warc.with_record_types(pages), scratch_path(spark, "t"), file_bytes=200)
    found = warc.read_warc(manifest, range_bytes=50).collect()
    assert sorted(r["record_id"] for r in found) == sorted(f"urn:page:{'' if i is None else i}" for i, _, _ in html)
    by = {}
    for r in found:
        by.setdefault(r["record_id"], []).append(r)
    assert by["urn:page:1"][0]["record_type"] == "revisit" and by["urn:page:1"][0]["refers_to_id"] == "urn:page:3" and by["urn:page:1"][0]["payload_bytes"] == 100
    assert by["urn:page:4"][0]["refers_to_id"] == "urn:page:5"
    assert sorted(r["record_type"] for r in by["urn:page:9"]) == ["response", "revisit"]
    assert bytes(by["urn:page:2"][0]["payload"]) == b"y"
    empty = warc.write_warc(warc.with_record_types(pages.limit(0)), scratch_path(spark, "t"))
    assert warc.read_warc(empty).count() == 0


def test_pipeline(spark, sf_dir):
    from tidewright.llm.common import documents, materialize

    stages = dict(corpus_pipeline.STAGES)
    raw = documents(spark, sf_dir)
    known = materialize(stages["identify languages"](spark, raw, sf_dir), "t")
    assert known.columns == raw.columns and known.count() >= 0.98 * raw.count()
    distinct = materialize(stages["drop exact copies"](spark, known, sf_dir), "t")
    clean = {"".join(r["text"].split()) for r in known.select("text").collect()}
    assert distinct.count() == len(clean)
    single = materialize(stages["drop near copies"](spark, distinct, sf_dir), "t")
    assert 0 < single.count() <= distinct.count() and single.select("doc_id").distinct().count() == single.count()
    mixed = materialize(stages["mix sources"](spark, single, sf_dir), "t")
    assert mixed.columns == raw.columns
    packed = stages["pack windows"](spark, mixed, sf_dir)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
