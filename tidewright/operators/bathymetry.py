"""Depth grids: values at points, profiles, sea and land, and the choice of source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import direct, distance, geodesic_destination, inverse, sphere_destination, sphere_distance
from .dealing import dealt

# The area that the finer European source covers (south, west, north, east).
FINE_COVERAGE = (15.0, -36.0, 90.0, 43.0)


def source_for_box(south: Column, west: Column, north: Column, east: Column) -> Column:
    s, w, n, e = FINE_COVERAGE
    return F.when((south >= s) & (west >= w) & (north <= n) & (east <= e), "EMODnet_WCS").otherwise("GEBCO_OpenTopography")


def grid_summary(grid: DataFrame) -> DataFrame:
    z = F.when(~F.isnan("z"), F.col("z"))
    return grid.agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.count(z).alias("n"))


def depth_at(points: DataFrame, grid: DataFrame, west: float, south: float, step: float, nx: int, ny: int, keys: tuple[str, ...] = ("point_id",), method: str = "bilinear") -> DataFrame:
    """keys, z, outside: the grid's value at lon, lat; null, and outside true, beyond its nodes. A null corner gives null."""
    fx, fy = (F.col("lon") - west) / step, (F.col("lat") - south) / step
    out = (fx < 0) | (fx > nx - 1) | (fy < 0) | (fy > ny - 1)
    if method == "nearest":
        near = points.select(*keys, out.alias("outside"), F.rint(fx).cast("bigint").alias("ix"), F.rint(fy).cast("bigint").alias("iy"))
        return near.join(grid.select("ix", "iy", "z"), ["ix", "iy"], "left").select(*keys, F.when(~F.col("outside"), F.col("z")).alias("z"), "outside")
    ix, iy = F.least(F.floor(fx), F.lit(nx - 2)), F.least(F.floor(fy), F.lit(ny - 2))
    cells = points.select(*keys, out.alias("outside"), ix.alias("ix"), iy.alias("iy"), (fx - ix).alias("tx"), (fy - iy).alias("ty"))
    # a row for each cell with its four corners, so a point meets one row and is not shuffled to be one row again
    places = [(i, j) for j in (0, 1) for i in (0, 1)]
    around = F.array(*[F.struct((F.col("ix") - i).alias("ix"), (F.col("iy") - j).alias("iy"), F.lit(i + 2 * j).alias("at")) for i, j in places])
    corners = grid.select(F.explode(around).alias("c"), "z").groupBy(F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy"))
    corners = corners.agg(*[F.min(F.when(F.col("c.at") == i + 2 * j, F.col("z"))).alias(f"z{i}{j}") for i, j in places])
    value = lambda i, j: (F.col("tx") if i else 1 - F.col("tx")) * (F.col("ty") if j else 1 - F.col("ty")) * F.col(f"z{i}{j}")
    total = value(0, 0) + value(1, 0) + value(0, 1) + value(1, 1)
    return cells.join(corners, ["ix", "iy"], "left").select(*keys, "outside", F.when(~F.col("outside"), total).alias("z"))


def sea_land_split(z: Column | str) -> tuple[Column, Column]:
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z < 0, z), F.when(z >= 0, z)


def signed_depth(z: Column, policy: str) -> Column:
    return {"raw": z, "abs": F.abs(z), "negate_land_null": F.when(z < 0, -z)}[policy]


def transects(points: DataFrame, azimuths: list, radius_m: float = 20_000.0, samples: int = 200, surface: str = "sphere") -> DataFrame:
    """point_id, direction, step, distance_m, lon, lat: equally spaced samples from each point along each azimuth."""
    rows = dealt(points, "point_id").select("point_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.explode(F.array(*[F.lit(float(a)) for a in azimuths])).alias("direction"))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("distance_m", F.col("step") * (radius_m / (samples - 1)))
    to = sphere_destination if surface == "sphere" else geodesic_destination
    lon, lat = to("lon0", "lat0", "direction", F.col("distance_m"))
    return rows.select("point_id", "direction", "step", "distance_m", lon.alias("lon"), lat.alias("lat"))


def line_samples(lines: DataFrame, samples: int = 200, keys: tuple[str, ...] = ("point_id", "direction")) -> DataFrame:
    """keys, step, distance_m, lon, lat: the samples of each line from lon0, lat0 to lon1, lat1, both ends among them.

    They lie equally spaced on the geodesic between the ends, whose azimuth and length follow from these; distance_m is the
    geodesic distance of a sample from the start, measured to where it lies.
    """
    if samples < 2:
        raise ValueError("a profile has two samples at least")
    share = np.arange(samples) / (samples - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                b = batch.iloc[at : at + 500]
                lon0, lat0, lon1, lat1 = (b[c].to_numpy(float)[:, None] for c in ("lon0", "lat0", "lon1", "lat1"))
                azimuth, length = inverse(lon0, lat0, lon1, lat1)
                lon, lat = (c + np.zeros((1, samples)) for c in direct(lon0, lat0, azimuth, length * share))
                lon[:, :1], lat[:, :1], lon[:, -1:], lat[:, -1:] = lon0, lat0, lon1, lat1
                away = distance(lon0, lat0, lon, lat)
                out = b[list(keys)].loc[b.index.repeat(samples)]
                yield out.assign(step=np.tile(np.arange(samples, dtype=np.int32), len(b)), distance_m=away.ravel(), lon=lon.ravel(), lat=lat.ravel())

    kinds = dict(lines.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", step int, distance_m double, lon double, lat double"
    return dealt(lines.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("lon0", "lat0", "lon1", "lat1")]), *keys).mapInPandas(run, schema)


def line_profiles(lines: DataFrame, grid: DataFrame, frame: dict, samples: int = 200, keys: tuple[str, ...] = ("point_id", "direction"), method: str = "bilinear") -> DataFrame:
    """line_samples() with outside and z, the grid's value at each sample; frame: west, south, step, nx, ny of the grid."""
    return depth_at(line_samples(lines, samples, keys), grid, **frame, keys=(*keys, "step", "distance_m", "lon", "lat"), method=method)


def clip_into(points: DataFrame, west: float, south: float, east: float, north: float, margin: float = 1e-4) -> DataFrame:
    return points.withColumns({
        "lon": F.greatest(F.least("lon", F.lit(east - margin)), F.lit(west + margin)), "lat": F.greatest(F.least("lat", F.lit(north - margin)), F.lit(south + margin)),
    })


def profile_summary(profile: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return profile.groupBy(*keys).agg(F.max("distance_m").alias("length_m"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count(F.lit(1)).alias("n"))


def profile_distances(profile: DataFrame) -> DataFrame:
    """distance from the first sample, on the sphere."""
    first = profile.groupBy("point_id", "direction").agg(F.min_by(F.struct("lon", "lat"), "step").alias("at"))
    joined = profile.join(first, ["point_id", "direction"])
    return joined.withColumn("from_start_m", sphere_distance(F.col("at.lon"), F.col("at.lat"), F.col("lon"), F.col("lat"))).drop("at")


def box_key(south: Column, west: Column, north: Column, east: Column, source: Column) -> Column:
    """Cache key of a box and a source."""
    parts = [F.format_string("%.6f", c) for c in (south, west, north, east)]
    return F.sha2(F.concat_ws("|", *parts, source), 256)
