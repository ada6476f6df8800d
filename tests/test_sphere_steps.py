"""Samples along transects, by numbers of origins and steps."""

import numpy as np

from tidewright.functions.geodesy import sphere_direct, sphere_steps
from tidewright.operators.rasters import Frame, raster_tiles, transect_scalars


def test_steps_are_those_of_sphere_direct():
    """Sines were taken anew for every sample of a transect; the samples stay the same to the last bit."""
    r = np.random.default_rng(3)
    lon, lat, azimuth, distances = r.uniform(-180, 180, 300), r.uniform(-80, 80, 300), r.uniform(0, 360, 300), np.arange(200) * 100.5
    origin, step = r.integers(0, 300, 5000), r.integers(0, 200, 5000)
    found, wanted = sphere_steps(lon, lat, azimuth, distances, origin, step), sphere_direct(lon[origin], lat[origin], azimuth[origin], distances[step])
    assert all(np.array_equal(a, b) for a, b in zip(found, wanted, strict=True))


def test_transects_are_cut_once(spark):
    """Pieces were made three times: to count those of each tile, to be sent there, and to tell which leave the raster."""
    frame = Frame(10.0, 50.0, 0.01, 9, 9, 4)
    rays = spark.createDataFrame([(1, 45, 10.02, 50.02), (2, 0, 10.07, 50.07)], "point_id long, direction int, lon double, lat double")
    nodes = spark.range(81).selectExpr("id % 9 AS ix", "id div 9 AS iy", "-1.0D - id AS z")
    df = transect_scalars(rays, raster_tiles(nodes, frame), frame, radius_m=2_000.0, samples=20)
    assert "MapInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["point_id"], r["outside"]) for r in df.collect()} == {(1, False), (2, True)}
