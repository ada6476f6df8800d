"""Repair and trie of conversations against brute force and SQL, on small tables with odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.llm import repair, trie

R = random.Random(5)
SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def odd_rows():
    texts = ["Hello there.", "No end", "  ", "", None, "Fine!", "Is it? ", "x" * 70_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None]
    rows = []
    for c in range(230):
        turn = R.choice([0, 0, 1, 5])
        for _ in range(R.choice([0, 1, 2, 3, 4, 7, 12])):
            rows.append((c, turn, R.choice(roles[:2] if R.random() < 0.7 else roles), R.choice(texts[:-1] if R.random() < 0.98 else texts)))
            turn += R.choice([1, 1, 1, 2])
    rows += [(300, None, "user", "No turn."), (300, None, "user", "No turn."), (300, 3, "assistant", "Yes."), (300, 3, "assistant", "Yes!")]
    rows += [(-7, 0, "user", "Negative.")]
    rows += [(900, t, "user" if t % 3 else "assistant", f"Turn {t}." if t % 5 else "Same.") for t in range(11)]
    rows += [(901, t, "user" if t % 3 else "assistant", f"Turn {t}." if t % 5 else "Same.") for t in range(11)]
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    extra = {c: F.lit("x") for c in ("part", "digest", "first", "node", "n", "at", "seq", "audit", "points", "_spread")}
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns(extra).repartition(5)


def by_sql(spark, df, sql):
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return {tuple(dict(zip(names, r, strict=True)).items()) for r in found.fetchall()}


def rows_of(df, columns=None):
    return {tuple(r.asDict().items()) for r in df.select(*(columns or df.columns)).collect()}


def test_repair_equals_sql(spark, turns):
    with_null = turns.unionByName(spark.createDataFrame([(None, 1, "user", "No id."), (None, 2, None, None)], SCHEMA), allowMissingColumns=True)
    want = by_sql(spark, with_null, repair.OP11_SQL)
    for segment in (repair.SEGMENT, 3):
        assert rows_of(repair.repair_conversations(repair.damage(with_null), with_null, segment=segment)) == want


def test_cheapest_equals_all_edits():
    """Every edit string up to a length, applied as the contract says."""
    for _ in range(60):
        turns = [(R.choice("suat"), R.choice(["", "", "t", "b", "d"])) for _ in range(R.randint(0, 3))]
        best = None
        for n in range(len(turns) + 4):
            for audit in itertools.product("DIKR", repeat=n):
                kept = [e for e in audit if e != "I"]
                if len(kept) != len(turns) or any(f in ("b", "d") and e != "D" for e, (_, f) in zip(kept, turns, strict=True)):
                    continue
                cost, row, shapes = 0, 0, [""]
                for e in audit:
                    if e == "I":
                        cost, shapes = cost + 5, [s + x for s in shapes for x in "ua"]
                        continue
                    initial, fault = turns[row]
                    row += 1
                    cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if fault == "t" and e != "D" else 0)
                    shapes = [s + x for s in shapes for x in {"D": [""], "K": initial, "R": "ua"}[e]]
                if any(re.fullmatch("(s?(ua)+)?", s) for s in shapes) and (best is None or (cost, "".join(audit)) < best):
                    best = (cost, "".join(audit))
        assert repair.cheapest(turns)[0][2:] == best


def test_repaired_turns_are_what_is_hashed(spark, turns):
    damaged = repair.damage(turns)
    report = {r["conv_id"]: r for r in repair.repair_conversations(damaged, turns).collect()}
    lines = {}
    for r in sorted(repair.repair_conversations(damaged, as_turns=True).collect(), key=lambda r: (r["conv_id"], r["position"])):
        lines.setdefault(r["conv_id"], []).append(r)
    for c, r in report.items():
        rows = lines.get(c, [])
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in rows).encode()).hexdigest() == r["repaired_sha256"]
        assert [x["edit"] for x in rows] == [e for e in r["audit"] if e != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in rows))


def test_repair_of_nothing(spark, turns):
    empty = turns.limit(0)
    assert repair.repair_conversations(repair.damage(empty), empty).collect() == []
    alone = spark.createDataFrame([(5,)], "conv_id long")
    assert [tuple(r) for r in repair.repair_conversations(empty, alone).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_trie_equals_sql(spark, turns):
    assert rows_of(trie.conversation_trie(turns)) == by_sql(spark, turns, trie.OP12_SQL)


def test_trie_of_long_and_equal_conversations(spark):
    """Conversations that are equal for more levels than a block, and many copies."""
    rows = [(c * 100, t, "user", f"turn {t}" if t < 9 or c < 6 else f"own {c}") for c in range(1, 9) for t in range(11)]
    rows += [(c * 100, 0, "user", "copy") for c in range(20, 260)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(trie.conversation_trie(df)) == by_sql(spark, df, trie.OP12_SQL)


def test_trie_in_ranges_and_of_nothing(spark, turns):
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert rows_of(trie.conversation_trie(turns)) == by_sql(spark, turns, trie.OP12_SQL)
        want = by_sql(spark, turns, repair.OP11_SQL)
        assert rows_of(repair.repair_conversations(repair.damage(turns), turns)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert trie.conversation_trie(turns.limit(0)).collect() == []
    no_id = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert trie.conversation_trie(no_id).collect() == []
