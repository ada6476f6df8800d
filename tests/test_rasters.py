"""Transects over tiled rasters and rays traced shell by shell, against brute force."""

import math
import random

import numpy as np
import pytest

from tidewright.functions.geodesy import direct, sphere_direct
from tidewright.operators import fetch
from tidewright.operators.rasters import Frame, raster_tiles, transect_scalars

R = random.Random(2)
FRAME = Frame(west=10.0, south=50.0, step=0.02, nx=47, ny=33, tile=8)


def brute(z, rays, radius, samples):
    """Scalars of each transect, sample by sample."""
    out = {}
    for point, direction, lon, lat in rays:
        lon, lat = min(max(lon, FRAME.west + 1e-4), FRAME.east - 1e-4), min(max(lat, FRAME.south + 1e-4), FRAME.north - 1e-4)
        held, outside = [], False
        for i in range(samples):
            x, y = sphere_direct(lon, lat, direction, i * radius / (samples - 1))
            fx, fy = (x - FRAME.west) / FRAME.step, (y - FRAME.south) / FRAME.step
            if not (0 <= fx <= FRAME.nx - 1 and 0 <= fy <= FRAME.ny - 1):
                outside = True
                held.append(None)
                continue
            ix, iy = min(int(fx), FRAME.nx - 2), min(int(fy), FRAME.ny - 2)
            corners = [z.get((ix + a, iy + b)) for b in (0, 1) for a in (0, 1)]
            if None in corners:
                held.append(None)
                continue
            tx, ty = fx - ix, fy - iy
            v = (1 - tx) * (1 - ty) * corners[0] + tx * (1 - ty) * corners[1] + (1 - tx) * ty * corners[2] + tx * ty * corners[3]
            held.append(-v if v < 0 else None)
        valid = [h for h in held if h is not None and h > 0]
        out[point, direction] = (outside, min(valid, default=None), max(valid, default=None), held[0], valid[0] if valid else None)
    return out


@pytest.mark.parametrize("share", [20_000, 7])
def test_transects(spark, share):
    z = {(i, j): R.uniform(-40, 8) for i in range(FRAME.nx) for j in range(FRAME.ny) if R.random() < 0.97 and not (16 <= i < 25 and 8 <= j < 17)}
    nodes = spark.createDataFrame([(i, j, v, "x") for (i, j), v in z.items()] + [(3, 3, None, "x")], "ix long, iy long, z double, tx string")
    rays = [(p, d, R.uniform(9.9, 11.0), R.uniform(49.95, 50.7)) for p in range(60) for d in R.sample(range(360), 4)]
    df = spark.createDataFrame(rays, "point_id long, direction int, lon double, lat double").repartition(3)
    tiles = raster_tiles(nodes.where("not (ix = 3 and iy = 3 and z is null)"), FRAME)
    found = {(r["point_id"], r["direction"]): r for r in transect_scalars(df, tiles, FRAME, radius_m=20_000.0, samples=50, share=share).collect()}
    want = brute(z, rays, 20_000.0, 50)
    assert set(found) == set(want)
    for key, (outside, *scalars) in want.items():
        assert found[key]["outside"] == outside
        for name, value in zip(("h_min", "h_max", "h_first", "first_valid"), scalars, strict=True):
            got = found[key][name]
            assert (got is None) == (value is None) and (value is None or math.isclose(got, value, rel_tol=1e-9)), (key, name)
    assert transect_scalars(df.limit(0), tiles, FRAME).collect() == []


def test_samples_on_the_sphere_are_near_those_on_the_ellipsoid():
    """The transect ends on the sphere; between its ends, shares of the way lie within half a metre on either surface."""
    from tidewright.functions.geodesy import distance

    for lat in (10.0, 44.0, 70.0):
        for azimuth in range(0, 360, 30):
            end = sphere_direct(37.0, lat, float(azimuth), 20_000.0)
            length = float(distance(np.array(37.0), np.array(lat), *map(np.array, end)))
            tried = np.arange(azimuth - 0.5, azimuth + 0.5, 1e-4)
            turn = tried[np.argmin(distance(*direct(np.full(len(tried), 37.0), np.full(len(tried), lat), tried, length), *map(np.array, end)))]
            for share in (0.25, 0.5, 0.75):
                a, b = direct(37.0, lat, turn, share * length), sphere_direct(37.0, lat, float(azimuth), share * 20_000.0)
                assert float(distance(*map(np.array, a), *map(np.array, b))) < 0.5


def test_shells_find_the_first_hit(spark):
    points = [(p, R.uniform(0, 9000), R.uniform(0, 9000), float(R.randrange(360))) for p in range(12)]
    coast = [(x := R.uniform(-9000, 18000), y := R.uniform(-9000, 18000), x + R.uniform(-900, 900), y + R.uniform(-900, 900)) for _ in range(150)]
    coast += [(points[0][1] - 50.0, points[0][2] + 500.0, points[0][1] + 50.0, points[0][2] + 500.0)]
    p = spark.createDataFrame(points, "point_id long, x double, y double, normal_azimuth_deg double")
    s = spark.createDataFrame(coast, "x0 double, y0 double, x1 double, y1 double")
    every = {tuple(sorted((k, v) for k, v in r.asDict().items() if k in ("point_id", "direction_id", "hit_found", "fetch_length_m"))) for r in fetch.trace_fetch(p, s, range(0, 360, 3), max_m=15_000.0, cell=700.0, first_m=15_000.0).collect()}
    for first in (300.0, 2000.0):
        found = {tuple(sorted((k, v) for k, v in r.asDict().items() if k in ("point_id", "direction_id", "hit_found", "fetch_length_m"))) for r in fetch.trace_fetch(p, s, range(0, 360, 3), max_m=15_000.0, cell=700.0, first_m=first).collect()}
        assert found == every
    sea = [dict(r) for r in every if dict(r)["hit_found"]]
    assert sea
    for r in sea[:400]:
        _, x, y, normal = points[r["point_id"]]
        azimuth = math.radians((r["direction_id"] - 1) * 3)
        sx, sy = x + 10 * math.sin(math.radians(normal)), y + 10 * math.cos(math.radians(normal))
        rx, ry = 15_000 * math.sin(azimuth), 15_000 * math.cos(azimuth)
        best = 1e9
        for x0, y0, x1, y1 in coast:
            cross = rx * (y1 - y0) - ry * (x1 - x0)
            t = ((x0 - sx) * (y1 - y0) - (y0 - sy) * (x1 - x0)) / cross
            u = ((x0 - sx) * ry - (y0 - sy) * rx) / cross
            if 0 <= t <= 1 and 0 <= u <= 1 and t * 15_000 > 1 and math.hypot(sx + t * rx - x, sy + t * ry - y) > 1:
                best = min(best, t * 15_000)
        assert abs(best - r["fetch_length_m"]) < 2.0  # ray ends are snapped to 0.05 m, which tells where a segment is grazed
