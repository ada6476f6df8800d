"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put into a shuffled order (by the md5 of its id) and gets a virtual finish time: the
source's words up to and with it, divided by the source's target. A second pass over the source continues the same
clock. All passes of all sources are then ordered by finish time and taken until the total budget is reached.

At scale: neither a source nor the final order is ever put into one task. Prefix sums inside a source are made in two
levels (sums of hash ranges, then inside a range); the global cut is found from sums of finish-time bins, the bin that
the budget falls into is cut into as many bins again, and only the one of these with the cut is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, WHOLE, WORD_PATTERN, documents, materialize, text_or_empty, unwrapped

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Finish-time bins per unit of virtual time; times of 2 and more share the last bin.
BINS = 8192


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Per source (absent, name): source_size, target.

    sizes has a row per source: absent, name, source_size. The budget is `share` times all sizes; it is shared by
    weight, a target stops at `epochs` times its source's size, and what that leaves is shared again by weight. With
    the sources in the order of cap/weight this fill level has a closed form, so nothing iterates.
    """
    by_name = Window.orderBy("absent", "name")  # one row per source
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "absent", "name")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("budget", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
        .withColumn("fits", F.col("weight") * F.col("level") <= F.col("cap"))
    )
    # the first source, in this order, that the level does not fill marks the level of all after it
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "absent", "name", "level"))).over(everything)["level"]
    return levels.withColumn("fill", level).select(
        "absent", "name", "source_size", "budget",
        F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("fill"))).alias("target"),
    )


def crossing_bin(passes: DataFrame, name: str) -> DataFrame:
    """name, start: the bin (of passes: bin, size, budget, start) in which the sums from start on exceed the budget, and the sum before it.

    A row of nulls if none does.
    """
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each bin
    filled = passes.groupBy("bin").agg(F.sum("size").alias("bin_size"), F.max("budget").alias("budget"), F.max("start").alias("start"))
    filled = filled.withColumn("end", F.col("start") + F.sum("bin_size").over(upto)).where(F.col("end") > F.col("budget"))
    return filled.agg(F.min("bin").alias(name), F.min(F.struct("bin", (F.col("end") - F.col("bin_size")).alias("start")))["start"].alias("start"))


def mix_sources(
    docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS, hash_digits: int = 3, bins: int = BINS
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, passes.

    docs needs doc_id, text and source. size is the number of words (null text: 0); taken is size times the passes the
    mix makes over the document, `epochs` at most. A null source is a source of its own, last in order. Documents
    without words are in the result with taken 0. Repeated rows count each for itself; rows alike in every column used
    here are interchangeable. An empty table gives an empty result. hash_digits hex digits of the shuffle's hash make
    the ranges in which prefix sums are formed (16 ** hash_digits of them per source). Numbers of the rows (`numbered`)
    are in the result too.
    """
    row = [ROW] if ROW in docs.columns else []
    base = docs.select(
        *row,
        F.col("doc_id"),
        F.col("source").isNull().cast("int").alias("absent"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"),
    ).withColumn("range", F.conv(F.substring("draw", 1, hash_digits), 16, 10).cast("int"))
    base = materialize(base, "mix-sizes")

    ranges = base.groupBy("absent", "name", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("absent", "name").agg(F.sum("range_size").alias("source_size")), weights, share, epochs)
    offsets = (
        ranges.withColumn(
            "offset",
            F.sum("range_size").over(Window.partitionBy("absent", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size"),
        )
        .join(targets, ["absent", "name"])
        .select("absent", "name", "range", "offset", "source_size", "target", "budget")
    )
    inside = Window.partitionBy("absent", "name", "range").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["absent", "name", "range"])
    clocks = []
    for k in range(epochs):
        time = F.try_divide((F.col("offset") + F.col("inside") + k * F.col("source_size")).cast("double"), F.col("target"))
        rows = rows.withColumn(f"time{k}", time).withColumn(f"bin{k}", F.least(F.floor(F.col(f"time{k}") * bins), F.lit(2 * bins)).cast("int"))
        clocks.append((f"time{k}", f"bin{k}"))
    rows = materialize(
        rows.select(*row, "doc_id", "absent", "name", "draw", "size", "source_size", "target", "budget", *[c for pair in clocks for c in pair]), "mix-times"
    )

    passes = rows.select(
        "size", "budget",
        F.explode(F.array(*[F.struct(F.col(t).alias("time"), "absent", "name", "draw", "doc_id", F.lit(k).alias("pass"), F.col(b).alias("bin")) for k, (t, b) in enumerate(clocks)])).alias("at"),
    ).where(F.col("at.bin").isNotNull())
    crossing = crossing_bin(passes.select(F.col("at.bin").alias("bin"), "size", "budget", F.lit(0).cast("long").alias("start")), "cross")
    # that bin's share of a unit of time, in as many finer bins
    finer = F.floor((F.col("at.time") * bins - F.col("cross")) * bins).cast("int")
    inside = materialize(passes.join(F.broadcast(crossing), F.col("at.bin") == F.col("cross")).withColumn("fine", finer), "mix-crossing")  # one row is broadcast
    fine = crossing_bin(inside.select(F.col("fine").alias("bin"), "size", "budget", "start"), "fine_cross").withColumnRenamed("start", "fine_start")
    in_bin = Window.partitionBy("fine").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        inside.join(F.broadcast(fine), F.col("fine") == F.col("fine_cross"))  # one row
        .withColumn("run", F.col("fine_start") + F.sum("size").over(in_bin))
        .where(F.col("run") <= F.col("budget"))
        .select("at")
    )
    # all of the finer bins before, and what fits of the last
    before = inside.join(F.broadcast(fine), F.col("fine") < F.col("fine_cross")).select("at")
    last = ordered.union(before).agg(F.max("at").alias("last"))
    cut = F.broadcast(crossing.select("cross").crossJoin(F.broadcast(last)))  # one row each
    count = sum(
        F.when(F.col(b).isNull(), 0)
        .when(F.col("cross").isNull() | (F.col(b) < F.col("cross")), 1)
        .when(
            F.col("last").isNotNull()
            & (F.struct(F.col(t).alias("time"), "absent", "name", "draw", "doc_id", F.lit(k).alias("pass"), F.col(b).alias("bin")) <= F.col("last")),
            1,
        )
        .otherwise(0)
        for k, (t, b) in enumerate(clocks)
    )
    return rows.crossJoin(cut).withColumn("passes", count.cast("int")).select(
        *row, "doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).cast("long").alias("taken"), "passes"
    )


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix passes over it.

    With row numbers (`common.numbered`) in both tables every row has its own decision, rows without a doc_id and rows
    that share one too. Without them rows that share a doc_id share the decision, and rows without a doc_id go. Empty
    texts have no words and are passed over like others; an empty table gives an empty result.
    """
    key = ROW if ROW in docs.columns and ROW in mixed.columns else "doc_id"
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if key == "doc_id" or c != ROW])
    times = mixed.where("passes > 0").groupBy(F.col(key).alias("_key")).agg(F.max("passes").alias("_passes"))
    joined = docs.select(own.alias(WHOLE), F.col(key).alias("_key")).join(times.hint("merge"), "_key")
    return unwrapped(joined.select(WHOLE, F.explode(F.sequence(F.lit(1), F.col("_passes")))))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("passes")


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS absent, coalesce(source, '') AS name,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents
), sources AS (
  SELECT absent, name, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY 1, 2
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY absent, name) - 1 AS rank FROM sources
), weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         CAST(source_size AS DOUBLE) * 2 AS cap FROM ranked
), leveled AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
         coalesce(sum(cap) OVER before, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM weighted WINDOW before AS (ORDER BY cap / weight, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, (budget - capped) / open_weight AS level FROM leveled
), fill AS (
  SELECT arg_min(level, row(cap / weight, absent, name)) AS fill FROM filled WHERE weight * level <= cap
), targets AS (
  SELECT absent, name, source_size, budget, CASE WHEN fill IS NULL THEN cap ELSE least(cap, weight * fill) END AS target
  FROM filled, fill
), clocked AS (
  SELECT b.*, source_size, target, budget,
         sum(size) OVER (PARTITION BY b.absent, b.name ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM base b JOIN targets t ON b.absent = t.absent AND b.name = t.name
), passes AS (
  SELECT *, 0 AS pass, CAST(run AS DOUBLE) / nullif(target, 0) AS time FROM clocked
  UNION ALL SELECT *, 1 AS pass, CAST(run + source_size AS DOUBLE) / nullif(target, 0) AS time FROM clocked
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY time, absent, name, draw, doc_id, pass ROWS UNBOUNDED PRECEDING) AS upto
  FROM passes WHERE time IS NOT NULL
)
SELECT c.doc_id, c.size, c.source_size, c.target,
       CAST(coalesce(sum(CASE WHEN upto <= cut.budget THEN cut.size END), 0) AS BIGINT) AS taken
FROM clocked c LEFT JOIN cut ON c.doc_id = cut.doc_id
GROUP BY c.doc_id, c.size, c.source_size, c.target
"""
