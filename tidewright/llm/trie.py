"""Prefix trie of conversations, built level by level.

Per depth, the conversations that still share their node with another are grouped by (node, next turn); a group's node is
named by its smallest conv_id, which with the depth is unique. A conversation that is alone in its node leaves: what
follows is a chain of its own, which needs no grouping. So the levels are those at which two conversations share
something, however long single conversations are. Then, from the deepest level up, each level is joined with sums over
its children: leaves and savings.

Turns are short rows (a digest and a count of code points) in blocks of BLOCK turns; a block's turns travel with their
conversation for so many levels. Groups that hold many conversations are broadcast and their rows spread
(`common.join_groups`). Each level is a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize
from .conversations import DIGEST_SQL, conversations, crc32_sql, turn_digest

BLOCK = 8
#: Conversations of a century share the first turns of its first one, HEADS - 1 at most.
CENTURY, HEADS = 100, 6
#: Depths of a chain that one row stands for until the end.
STRETCH = 65536
#: Characters of ids in one piece.
PIECE = 1 << 16

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def positioned(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with conv_id, part, at, digest, points; parts with conv_id, part, first, n, before).

    Rows are in ranges of (conv_id, turn, digest), nulls first: a row's position is at - first + before + 1.
    """
    order = (F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"))
    sorted_rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(sorted_rows.select("conv_id", F.monotonically_increasing_id().alias("at"), "digest", "points"), "trie-turns").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return rows, parts.withColumn("before", F.coalesce(before, F.lit(0)))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns; conv_id, pos, digest, points) of rebuilt conversations, from conv_id, turn, digest, points."""
    rows, parts = positioned(turns)
    parts = materialize(parts, "trie-parts")
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = F.crc32(F.col("conv_id").cast("string")) % HEADS
    named = sizes.select("conv_id", "n", heads.alias("heads"), (F.col("conv_id") - F.col("conv_id") % CENTURY).alias("base"))
    taken = F.least("heads", F.coalesce("base_n", F.lit(0)))
    convs = materialize(named.join(bases, "base", "left").select("conv_id", "n", "heads", "base", taken.alias("taken")), "trie-conversations")
    with_heads = parts.join(convs.select("conv_id", "heads", "taken"), "conv_id")
    own = rows.join(with_heads, ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    of_bases = own.where((F.col("conv_id") % CENTURY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "digest", "points")
    shared = convs.join(of_bases, "base").where("pos <= heads").select("conv_id", "pos", "digest", "points")
    kept = own.where("pos > heads").select("conv_id", (F.col("pos") - F.col("heads") + F.col("taken")).alias("pos"), "digest", "points")
    n_turns = F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))
    return convs.select("conv_id", n_turns.alias("n_turns")), kept.unionByName(shared)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted depth, node, conv_id -> depth, node, seq, ids: comma-joined ids, in pieces that follow one another."""
    from pyspark import TaskContext

    seq = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    held, ids, size, rows = None, [], 0, []
    names = ["depth", "node", "seq", "ids"]

    def piece() -> None:
        nonlocal seq, ids, size
        if ids:
            rows.append((*held, seq, ",".join(ids)))
            seq, ids, size = seq + 1, [], 0

    for batch in batches:
        for depth, node, conv_id in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv_id")), strict=True):
            if held != (depth, node) or size > PIECE:
                piece()
                held = (depth, node)
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
            rows = []
    piece()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> depth, node, sha256 of all of a node's pieces."""
    names = ["depth", "node", "sha256"]
    held, digest, rows = None, None, []
    for batch in batches:
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
            if held == (depth, node):
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                rows.append((*held, digest.hexdigest()))
            held, digest = (depth, node), hashlib.sha256(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
            rows = []
    if held is not None:
        rows.append((*held, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def ends_of(ended: DataFrame) -> DataFrame:
    """depth, node, sha256 of the sorted conv_ids of each node; a node of any size is spread but for the hashing itself."""
    ranges = ended.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    pieces = ranges.mapInArrow(_pieces, "depth long, node long, seq long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "seq").mapInArrow(_hashes, "depth long, node long, sha256 string")


def chains(singles: DataFrame) -> DataFrame:
    """The nodes of conversations that are alone from a depth on: child, depth, parent, n_turns."""
    stretches = singles.select("child", "depth", "parent", "n_turns", F.explode(F.expr(f"sequence(depth, n_turns, {STRETCH}L)")).alias("start")).repartition("child", "start")
    rows = stretches.withColumn("at", F.explode(F.expr(f"sequence(start, least(start + {STRETCH - 1}, n_turns))")))
    last = F.col("at") == F.col("n_turns")
    parent = F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("child"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.sha2(F.when(last, F.col("child").cast("string")).otherwise("").cast("binary"), 256)
    return rows.select(F.col("child").alias("conv_id"), F.col("at").alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"))


def build_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row of NODES for each distinct prefix of turns.

    convs: conv_id (unique, not null), n_turns; turns: conv_id, pos (1 to n_turns), digest, points. Conversations without a
    turn are members of the root alone. No conversation gives no node, not even the root.
    """
    spark = convs.sparkSession
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not whole["n"]:
        return spark.createDataFrame([], NODES)
    block = F.sort_array(F.collect_list(F.struct("pos", "digest", "points")))
    blocks = materialize(turns.groupBy("conv_id", F.expr(f"(pos - 1) div {BLOCK}").alias("block")).agg(block.alias("turns")), "trie-blocks")
    levels = [materialize(spark.range(1).select(F.lit(whole["least"]).alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(whole["n"]).cast("long").alias("n"), F.lit(0).cast("long").alias("points")), "trie-root")]
    singles: list[DataFrame] = []
    ended: list[DataFrame] = []
    live = convs.select("conv_id", "n_turns", F.lit(whole["least"]).alias("node"))
    depth = 0
    while True:
        if depth % BLOCK == 0:
            of_block = blocks.where(F.col("block") == depth // BLOCK).drop("block")
            live = materialize(live.select("conv_id", "n_turns", "node").join(of_block, "conv_id", "left"), "trie-live")
        ended.append(live.where(F.col("n_turns") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        turn = F.col("turns")[depth % BLOCK]
        going = live.where(F.col("n_turns") > depth).withColumn("key", turn["digest"])
        groups = going.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.max(turn["points"]).cast("long").alias("points"), F.max("n_turns").alias("n_turns"))
        groups = materialize(groups, "trie-groups")
        depth += 1
        singles.append(groups.where("n = 1").select("child", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), "n_turns"))
        common = groups.where("n > 1")
        if common.isEmpty():
            break
        levels.append(common.select(F.col("child").alias("conv_id"), F.col("node").alias("parent"), "n", "points"))
        found = join_groups(going, common.select("node", "key", "child", "n"), ["node", "key"], "n", ["conv_id"])
        live = materialize(found.where("child is not null").select("conv_id", "n_turns", F.col("child").alias("node"), "turns"), "trie-live")

    rolled: list[DataFrame] = []
    above: DataFrame | None = None
    for at in range(len(levels) - 1, -1, -1):
        alone = singles[at].groupBy("parent").agg(F.count("*").alias("children"), F.count("*").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        if above is not None:
            below = above.groupBy("parent").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            alone = alone.unionByName(below).groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
        joined = levels[at].join(alone.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        above = joined.select("conv_id", F.lit(at).cast("long").alias("depth"), "parent", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), ((F.col("n") - 1) * F.col("points") + F.coalesce("saved", F.lit(0))).alias("saved"))
        above = materialize(above, "trie-rolled")
        rolled.append(above)

    ends, nodes = ended[0], rolled[0]
    for more in ended[1:]:
        ends = ends.unionByName(more)
    for more in rolled[1:]:
        nodes = nodes.unionByName(more)
    chain = singles[0]
    for more in singles[1:]:
        chain = chain.unionByName(more)
    hashed = ends_of(ends).withColumnRenamed("node", "conv_id")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    shared = nodes.join(hashed, ["depth", "conv_id"], "left").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha256", empty).alias("ends_sha256"))
    return shared.unionByName(chains(chain))


def short_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest, points of rows with conv_id, turn, role and text; null roles and texts are empty."""
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.where("conv_id is not null").select("conv_id", "turn", turn_digest().alias("digest"), F.length("text").alias("points"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie (NODES) of rebuilt conversations: their century's first turns, then their own.

    turns needs conv_id, turn, role and text; other columns are ignored. Null turns come first, rows that share a turn
    follow by turn_digest, repeated rows count each. Null roles and texts are empty. Rows without a conv_id belong to no
    conversation and are left out. Texts are compared by digest, whole. Conversations that become turnless end at the
    root. An empty table gives an empty result. Jobs run while the levels are built.
    """
    return build_trie(*rebuild(short_turns(turns)))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(conversations(spark, sf_dir))


OP12_SQL = f"""
WITH src AS (
  SELECT conv_id, length(text) AS points, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
  FROM (SELECT conv_id, turn, text, {DIGEST_SQL} AS digest
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS heads
  FROM (SELECT DISTINCT conv_id FROM src)
), sizes AS (SELECT conv_id AS base, count(*) AS n FROM src GROUP BY conv_id
), rebuilt AS (
  SELECT i.conv_id, s.pos, s.digest, s.points FROM ids i JOIN src s ON s.conv_id = i.base AND s.pos <= i.heads
  UNION ALL
  SELECT i.conv_id, s.pos - i.heads + least(i.heads, coalesce(z.n, 0)), s.digest, s.points
  FROM ids i JOIN src s ON s.conv_id = i.conv_id AND s.pos > i.heads LEFT JOIN sizes z ON z.base = i.base
), paths AS (
  SELECT i.conv_id, coalesce(string_agg(r.digest, '' ORDER BY r.pos), '') AS path, list(r.points ORDER BY r.pos) AS points, count(r.pos) AS n
  FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(point) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM (SELECT conv_id, n, depth, substr(path, 1, 32 * depth) AS prefix, CASE WHEN depth = 0 THEN 0 ELSE points[depth] END AS point
    FROM (SELECT *, unnest(range(0, n + 1)) AS depth FROM paths))
  GROUP BY depth, prefix
), linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id, p.prefix AS parent_prefix
  FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = substr(c.prefix, 1, 32 * (c.depth - 1)) AND c.depth > 0
), children AS (
  SELECT depth - 1 AS depth, parent_prefix AS prefix, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT up AS depth, substr(prefix, 1, 32 * up) AS prefix, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT n.prefix, n.saved, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, n.depth + 1)) AS up
    FROM nodes n LEFT JOIN children c USING (depth, prefix))
  GROUP BY ALL
)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l JOIN sums s USING (depth, prefix) LEFT JOIN children c USING (depth, prefix)
"""
