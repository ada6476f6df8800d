"""Daily waves at shore points from wind, fetch and depths, and their summaries per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import waves
from ..functions.angles import sector_name, sector_number, shoreward_cosine, signed_difference
from .normalise import drop_calm, valid_depth
from .rasters import Frame, raster_tiles, transect_scalars

SECONDS = 86400.0


def densify_fetch(trace: DataFrame, keys: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """keys, direction 0 .. 359, fetch_m: of the traced direction nearest on the circle, the smaller one of two.

    Done once per point, so that the daily lookup is an equi-join. Every traced direction is expanded to the whole
    directions that it serves, up to halfway to its neighbours on the circle, so the work is 360 rows a point.
    """
    held = trace.where("direction is not null").groupBy(*keys, F.pmod("direction", F.lit(360)).alias("at")).agg(F.min("fetch_m").alias("fetch_m"))
    ring = Window.partitionBy(*keys).orderBy("at")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = held.select(
        *keys, "at", "fetch_m",
        F.coalesce(F.lag("at").over(ring), F.last("at").over(whole) - 360).alias("before"),
        F.coalesce(F.lead("at").over(ring), F.first("at").over(whole) + 360).alias("after"),
    )
    # halfway counts for the smaller direction; across north the one after, or before, is the smaller one if it wraps
    left, right = (F.col("before") + F.col("at")) / 2, (F.col("at") + F.col("after")) / 2
    low = F.when(F.col("at") < F.pmod("before", F.lit(360)), F.ceil(left)).otherwise(F.floor(left) + 1)
    high = F.when(F.col("at") < F.pmod("after", F.lit(360)), F.floor(right)).otherwise(F.ceil(right) - 1)
    alone = F.col("after") - F.col("before") == 720
    served = F.when(alone, F.sequence(F.lit(0), F.lit(359))).otherwise(F.sequence(low.cast("int"), high.cast("int")))
    # between fractional directions of less than a degree apart may lie no whole one
    rows = near.where(alone | (low <= high)).select(*keys, "fetch_m", F.explode(served).alias("direction"))
    return rows.select(*keys, F.pmod("direction", F.lit(360)).alias("direction"), "fetch_m")


def lookup_fetch(wind: DataFrame, trace: DataFrame, keys: tuple[str, ...] = ("point_id",)) -> DataFrame:
    return wind.join(densify_fetch(trace, keys), [*keys, "direction"])


def lookup_with_offset(points: DataFrame, trace_ids: DataFrame, offset: int) -> DataFrame:
    """points with fetch_id: the identifier shifted by offset where it was traced, else the identifier itself; others go."""
    ids = trace_ids.select(F.col("point_id").alias("fetch_id")).distinct()
    shifted = points.join(ids.withColumn("near", F.col("fetch_id")), F.col("point_id") + offset == F.col("fetch_id"), "left").drop("fetch_id")
    plain = shifted.join(ids.withColumn("own", F.col("fetch_id")), F.col("point_id") == F.col("fetch_id"), "left").drop("fetch_id")
    return plain.withColumn("fetch_id", F.coalesce("near", "own")).where("fetch_id is not null").drop("near", "own")


def profile_scalars(profile: DataFrame, keys: tuple[str, ...], z: str = "z", step: str = "step", sign_policy: str = "negate_land_null") -> DataFrame:
    """keys, h_min, h_max, h_first, first_valid: all that the nearshore step needs of a depth profile.

    sign_policy says how elevations become depths: raw (as they are), abs, or negate_land_null (sea is below 0).
    """
    depth = {"raw": F.col(z), "abs": F.abs(z), "negate_land_null": F.when(F.col(z) < 0, -F.col(z))}[sign_policy]
    rows = profile.select(*keys, step, depth.alias("h"))
    held = F.when(valid_depth("h"), F.col("h"))
    return rows.groupBy(*keys).agg(
        F.min(held).alias("h_min"), F.max(held).alias("h_max"), F.min_by("h", step).alias("h_first"), F.min_by(held, F.when(held.isNotNull(), F.col(step))).alias("first_valid")
    )


def nearshore(height: Column, delta: Column, h_min: Column | None = None, h_max: Column | None = None, h_first: Column | None = None, first_valid: Column | None = None,
              deep: float = waves.DEEP_M, point: float = waves.POINT_M, gamma: float = waves.GAMMA) -> dict[str, Column]:
    """ks, h_break, height and cosine at the shore.

    Along a profile the height that shoals to a depth falls as the depth grows, and the breaking limit rises; so the
    first breaking depth, if there is one, is the smallest valid depth, and the loop over depths is one comparison.
    """
    if h_min is None:
        h_deep, h_point, breaks = F.lit(deep), F.lit(point), None
    else:
        h_deep = F.coalesce(h_max, F.lit(deep))
        h_point = F.coalesce(F.when(valid_depth(h_first), h_first), first_valid, F.lit(point))
        breaks = height * F.pow(h_deep / h_min, F.lit(0.25)) >= gamma * h_min
    h_break = h_point if breaks is None else F.when(breaks, h_min).otherwise(h_point)
    ks = waves.shoaling(h_deep, h_point)
    return {"ks": ks, "h_break": h_break, "height": F.least(height * ks, gamma * h_break), "cosine": waves.shallow_refraction(delta, h_point, h_deep)}


def breaking_limit(height: Column, h_min: Column, gamma: float = waves.GAMMA, default_depth: float = 10.0) -> tuple[Column, Column]:
    """Height and depth at breaking in the second model: gamma times the smallest depth; without depths, capped at 10 m."""
    return F.coalesce(gamma * h_min, F.least(height, F.lit(gamma * default_depth))), F.coalesce(h_min, F.lit(default_depth))


def nearshore_b(height: Column, period: Column, delta: Column, h_min: Column, h_max: Column, h_first: Column) -> dict[str, Column]:
    """The second nearshore model: clamped shoaling, breaking at the smallest depth, refraction by full dispersion."""
    ks = waves.shoaling(h_max, h_first, clamp=True)
    broken, depth = breaking_limit(height * ks, h_min)
    ratio = waves.phase_speed(period, depth) / waves.phase_speed(period, h_max)
    s = F.greatest(F.least(F.sin(F.radians(F.abs(delta))) * ratio, F.lit(1.0)), F.lit(-1.0))
    return {"ks": ks, "height": F.least(height * ks, broken), "h_break": depth, "angle": F.degrees(F.asin(s)), "cosine": F.cos(F.asin(s))}


def daily_waves(wind: DataFrame, trace: DataFrame, points: DataFrame, profiles: DataFrame | None = None, *, least_speed: float = 0.1, shoreward_only: bool = False, rounded: bool = True, known_profiles_only: bool = False) -> DataFrame:
    """A row per point and day with wind of least_speed km/h and more, for points with wind and a fetch.

    wind: point_id, date, ws_kmh, direction. trace: point_id, direction, fetch_m. points: point_id, normal_azimuth_deg.
    profiles: profile_scalars() by point_id and direction; days without one get the default depths, or go if
    known_profiles_only. Physics uses whole values, columns are rounded at the end. shoreward_only: waves from behind the
    shore line carry nothing.
    """
    joined = lookup_fetch(drop_calm(wind), trace).join(points.select("point_id", "normal_azimuth_deg"), "point_id")
    if profiles is not None:
        joined = joined.join(profiles, ["point_id", "direction"], "inner" if known_profiles_only else "left")
    delta = signed_difference("direction", "normal_azimuth_deg")
    u = waves.wind_over_water("ws_kmh")
    height, period = waves.fetch_limited_growth(u, F.col("fetch_m"))
    shore = nearshore(height, delta, *([F.col(c) for c in ("h_min", "h_max", "h_first", "first_valid")] if profiles is not None else []))
    cosine = shore["cosine"] if not shoreward_only else F.when(shoreward_cosine(delta) > 0, shore["cosine"]).otherwise(0.0)
    power = waves.wave_power(shore["height"], period)
    columns = {
        "fetch_m": (F.col("fetch_m"), 1), "U10_ms": (u, 3), "Hs_offshore_m": (height, 4), "Hs_nearshore_m": (shore["height"], 4), "Tp_s": (period, 4),
        "Ks": (shore["ks"], 4), "h_breaking_m": (shore["h_break"], 3), "cos_shore": (cosine, 4), "WavePower_W_m": (power, 3), "CWEF_W_m": (power * cosine, 3),
    }
    return joined.select("point_id", "date", "direction", F.col("normal_azimuth_deg").alias("shore_normal_deg"), *[(F.round(c, n) if rounded else c).alias(k) for k, (c, n) in columns.items()])


def waves_over_raster(wind: DataFrame, trace: DataFrame, points: DataFrame, nodes: DataFrame, frame: Frame, *, strict: bool = True, radius_m: float = 20_000.0, samples: int = 200, sign_policy: str = "negate_land_null", **options) -> DataFrame:
    """daily_waves() with depths along each point's own transects, for every direction that has wind.

    points: also lon, lat; nodes: ix, iy, z of the raster. strict: a point of which any such transect leaves the raster
    goes altogether; otherwise what lies beyond has no depth. Each transect is sampled once, however many days use it.
    """
    used = lookup_fetch(drop_calm(wind), trace).select("point_id", "direction").distinct()
    rays = used.join(points.select("point_id", "lon", "lat"), "point_id")
    profiles = transect_scalars(rays, raster_tiles(nodes, frame), frame, radius_m=radius_m, samples=samples, sign_policy=sign_policy)
    if strict:
        leaves = F.max("outside").over(Window.partitionBy("point_id"))  # a point has 360 directions at most
        profiles = profiles.withColumn("leaves", leaves)
    else:
        profiles = profiles.withColumn("leaves", F.lit(False))
    return daily_waves(wind, trace, points, profiles.where(~F.col("leaves")), known_profiles_only=True, **options)


def cwef_summary(daily: DataFrame, keys: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """Statistics of the daily flux per key, on the rounded daily columns; days at the 90th percentile count as storms.

    daily is read once: the percentiles are a window over a key's days, which the statistics then share.
    """
    values = F.array(*[F.lit(v) for v in (0.5, 0.75, 0.9, 0.95, 0.99)])
    days = daily.select(*keys, "CWEF_W_m", "Hs_nearshore_m").withColumn("q", F.percentile("CWEF_W_m", values).over(Window.partitionBy(*keys)))
    base = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days_total"), F.count_if(F.col("CWEF_W_m") > 0).alias("n_days_active"), F.avg("CWEF_W_m").alias("mean_W_m"),
        F.first("q").alias("q"), F.stddev_samp("CWEF_W_m").alias("std_W_m"), F.max("CWEF_W_m").alias("max_W_m"), F.count_if(F.col("CWEF_W_m") >= F.col("q")[2]).alias("n_storm_days_p90"),
        (F.sum("CWEF_W_m") * SECONDS / 1e6).alias("total_energy_MJ_m"), F.avg("Hs_nearshore_m").alias("Hs_mean_m"), F.max("Hs_nearshore_m").alias("Hs_max_m"),
    )
    return base.select(
        *keys, "n_days_total", "n_days_active", "mean_W_m", F.col("q")[0].alias("median_W_m"), "std_W_m", F.col("q")[1].alias("p75_W_m"), F.col("q")[2].alias("p90_W_m"),
        F.col("q")[3].alias("p95_W_m"), F.col("q")[4].alias("p99_W_m"), "max_W_m", "n_storm_days_p90", "total_energy_MJ_m", "Hs_mean_m", "Hs_max_m",
    )


def cwef_summary_all(points: DataFrame, daily: DataFrame) -> DataFrame:
    """The summary for every point; one without days has 0 days and nulls."""
    out = points.select("point_id").join(cwef_summary(daily), "point_id", "left")
    return out.withColumn("n_days", F.coalesce("n_days_total", F.lit(0))).drop("n_days_total")


def cwef_by_direction(daily: DataFrame) -> DataFrame:
    return daily.groupBy("direction").agg(
        F.avg("CWEF_W_m").alias("cwef_mean"), F.sum("CWEF_W_m").alias("cwef_sum"), F.avg("Hs_nearshore_m").alias("hs_mean"), F.max("Hs_nearshore_m").alias("hs_max"), F.count("CWEF_W_m").alias("n")
    )


def cwef_by_sector(daily: DataFrame) -> DataFrame:
    return daily.groupBy(sector_number("direction").alias("sector_no"), sector_name("direction").alias("sector")).agg(
        F.avg("CWEF_W_m").alias("cwef_mean"), F.sum("CWEF_W_m").alias("cwef_sum"), F.avg("Hs_nearshore_m").alias("hs_mean"), F.max("Hs_nearshore_m").alias("hs_max"),
        F.avg("cos_shore").alias("cos_mean"), F.count("CWEF_W_m").alias("n"),
    )


def annual_extremes(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("date").alias("year")).agg(F.max("Hs_nearshore_m").alias("hs_max"), F.max("CWEF_W_m").alias("cwef_max"), F.avg("CWEF_W_m").alias("cwef_mean"))
