"""The exposure index: storm energy, directional concentration, variability, ranks and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import COMPASS_16, sector_number
from .ranks import percentiles

METRICS = ("mean_CWEF_Wm", "E_storm_MJm", "K_dir", "CV")
STEPS = (0.2, 0.4, 0.6, 0.8)


def _sector_sums(flux: str) -> Column:
    """Array of the flux summed by sector, 0 for a sector without days: an aggregate."""
    sector = sector_number("direction")
    return F.array(*[F.coalesce(F.sum(F.when(sector == i, F.col(flux))), F.lit(0.0)) for i in range(16)])


def _strongest(sums: str) -> dict[str, Column]:
    """K_dir, top_start, top3_sectors from an array of sums by sector."""
    at = lambda i: F.element_at(sums, F.pmod(i, F.lit(16)).cast("int") + 1)
    top = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct((at(i) + at(i + 1) + at(i + 2)).alias("e"), (-i).alias("start"))))
    total = F.aggregate(sums, F.lit(0.0), lambda a, e: a + e)
    names = F.array(*[F.lit(n) for n in COMPASS_16])
    label = F.concat_ws(",", *[F.element_at(names, F.pmod(-top["start"] + i, F.lit(16)).cast("int") + 1) for i in range(3)])
    none = total == 0
    return {"K_dir": F.when(none, 0.0).otherwise(F.try_divide(top["e"], total)), "top_start": F.when(~none, -top["start"]), "top3_sectors": F.when(none, "").otherwise(label)}


def top_sectors(daily: DataFrame, keys: tuple[str, ...] = ("point_id",), flux: str = "CWEF_W_m") -> DataFrame:
    """keys, K_dir, top_start, top3_sectors: the three neighbouring sectors, on the ring of 16, with the largest share.

    Of equal sums the first start counts. Without energy the share is 0 and no sector is named.
    """
    sums = daily.groupBy(*keys).agg(_sector_sums(flux).alias("_sums"))
    return sums.select(*keys, *[c.alias(n) for n, c in _strongest("_sums").items()])


def _percentile_over(flux: str, keys: tuple[str, ...], share: float) -> tuple[Column, Column, Column]:
    """_at, _place and, from these two, the linear percentile of each key's values on every row: windows, which spill.

    low + (high - low) * rest: where a key's values have few digits, percentiles lie on halves, and the way of computing
    them decides how they are rounded.
    """
    every = Window.partitionBy(*keys)
    at = F.row_number().over(every.orderBy(F.asc_nulls_last(flux))) - 1
    place = F.lit(share) * (F.count(flux).over(every) - 1)
    low, high = (F.max(F.when(F.col("_at") == f(F.col("_place")), F.col(flux))).over(every) for f in (F.floor, F.ceil))
    return at, place, low + (high - low) * (F.col("_place") - F.floor("_place"))


def exposure_metrics(daily: DataFrame, keys: tuple[str, ...] = ("point_id",), *, percentile: float = 90.0, threshold: float | None = None, seconds: float = 86400.0, flux: str = "CWEF_W_m") -> DataFrame:
    """Per key: mean, storm energy above the threshold, share of the three strongest sectors, coefficient of variation.

    The threshold is a percentile (linear) of the key's own days unless one is given; storm days lie above it. daily is
    read once and shuffled once: the percentile is a window over a key's days, and one aggregate does the rest.
    """
    if not 0 < percentile < 100:
        raise ValueError("percentile lies between 0 and 100")
    days = daily.select(*keys, "direction", flux)
    if threshold is not None:
        days = days.withColumn("_limit", F.lit(float(threshold)))
    else:
        at, place, limit = _percentile_over(flux, keys, percentile / 100.0)
        days = days.withColumns({"_at": at, "_place": place}).withColumn("_limit", limit)
    over = F.col(flux) > F.col("_limit")
    base = days.groupBy(*keys).agg(
        F.avg(flux).alias("mean"), F.stddev_samp(flux).alias("std"), F.count(flux).alias("n_days"), F.first("_limit").alias("storm_threshold_Wm"),
        F.coalesce(F.sum(F.when(over, F.col(flux))) * seconds / 1e6, F.lit(0.0)).alias("E_storm_MJm"), F.count_if(over).alias("n_storm_days"), _sector_sums(flux).alias("_sums"),
    )
    cv = F.when(F.col("mean").isNull() | (F.col("mean") == 0), 0.0).otherwise(F.try_divide(F.col("std"), F.col("mean")))
    top = _strongest("_sums")
    return base.select(
        *keys, F.round("mean", 3).alias("mean_CWEF_Wm"), F.round("E_storm_MJm", 3).alias("E_storm_MJm"), F.round("storm_threshold_Wm", 3).alias("storm_threshold_Wm"),
        F.round(F.coalesce(top["K_dir"], F.lit(0.0)), 4).alias("K_dir"), top["top3_sectors"].alias("top3_sectors"), F.round(cv, 4).alias("CV"), "n_days", "n_storm_days",
    )


def annual_metrics(daily: DataFrame, keys: tuple[str, ...] = ("point_id",), **options) -> DataFrame:
    return exposure_metrics(daily.withColumn("year", F.year("date")), (*keys, "year"), **options)


def quintile_ranks(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """A rank 1 .. 5 per metric (new name by column) against linear percentiles of all rows; ties share a rank, null stays null.

    df is written down once; its percentiles are found by histograms, whose size does not grow with the rows.
    """
    from ..shared import written

    present = {m: r for m, r in metrics.items() if m in df.columns}
    out = written(df, "ranked") if present else df
    bounds = percentiles(out, list(present), STEPS) if present else {}
    for m, r in metrics.items():
        if m in bounds:
            value, edges = F.col(m), [F.lit(float(e)) for e in bounds[m]]
            rank = F.when(value.isNull(), F.lit(None)).when(value <= edges[0], 1).when(value <= edges[1], 2).when(value <= edges[2], 3).when(value <= edges[3], 4).otherwise(5)
            out = out.withColumn(r, rank.cast("int"))
        else:
            out = out.withColumn(r, F.lit(None).cast("int"))
    return out


def combined_rank(df: DataFrame, ranks: tuple[str, ...]) -> DataFrame:
    """WER: the geometric mean of the ranks, null if one is null."""
    product = F.lit(1.0)
    for r in ranks:
        product = product * F.col(r)
    return df.withColumn("WER", F.round(F.pow(product, F.lit(1.0 / len(ranks))), 3))


def exposure_index(daily: DataFrame, summary: DataFrame | None = None, metrics: tuple[str, ...] = METRICS, **options) -> DataFrame:
    """Metrics, ranks and WER per point; with a summary, one row for each of its points (days without: 0)."""
    found = exposure_metrics(daily, **options)
    if summary is not None:
        found = summary.select(F.col("point_id").cast("string").alias("point_id")).join(found.withColumn("point_id", F.col("point_id").cast("string")), "point_id", "left")
        found = found.withColumns({"n_days": F.coalesce("n_days", F.lit(0)), "n_storm_days": F.coalesce("n_storm_days", F.lit(0))})
    names = {m: f"R{i}" for i, m in enumerate(metrics, 1)}
    return combined_rank(quintile_ranks(found, names), tuple(names.values()))


def empty_indices(points: DataFrame, daily: DataFrame) -> DataFrame:
    """Points without a single day, with 0 counts and null metrics."""
    gone = points.select("point_id").join(daily.select("point_id").distinct(), "point_id", "left_anti")
    return gone.select("point_id", F.lit(0).alias("n_days"), F.lit(0).alias("n_storm_days"), *[F.lit(None).cast("double").alias(m) for m in METRICS])


def shore_normal_from_fetch(fetch: DataFrame, keys: tuple[str, ...] = ("point_id",), window: int = 11) -> DataFrame:
    """keys, normal_deg: the direction of the largest centred running mean of fetch (not round the circle); first of equals."""
    half = window // 2
    smooth = F.avg("fetch_m").over(Window.partitionBy(*keys).orderBy("direction").rowsBetween(-half, half))
    return fetch.withColumn("smooth", smooth).groupBy(*keys).agg(F.max_by("direction", F.struct("smooth", (-F.col("direction")).alias("d"))).alias("normal_deg"))
