"""Formulas against plain restatements, and properties."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import angles, geodesy, waves
from tidewright.operators import bathymetry, climate, coast, exposure, fetch, graph, normalise, rose, weather


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_breaking_depth_equals_the_loop(spark):
    r = random.Random(1)
    rows, want = [], []
    for i in range(300):
        depths = [r.choice([None, -2.0, r.uniform(0.2, 30)]) for _ in range(8)]
        height = r.uniform(0.1, 5)
        rows += [(i, s, z, height) for s, z in enumerate(depths)]
        valid = [z for z in depths if z is not None and z > 0]
        deep = max(valid) if valid else 20.0
        point = depths[0] if depths[0] and depths[0] > 0 else (valid[0] if valid else 3.0)
        found = next((h for h in sorted(valid) if height * (deep / h) ** 0.25 >= 0.55 * h), point)
        want.append((i, round(found, 9)))
    df = spark.createDataFrame(rows, "id int, step int, z double, hs double")
    scalars = climate.profile_scalars(df, ("id", "hs"), sign_policy="raw")
    near = climate.nearshore(F.col("hs"), F.lit(0.0), F.col("h_min"), F.col("h_max"), F.col("h_first"), F.col("first_valid"))
    assert sorted((r["id"], round(r["h"], 9)) for r in scalars.select("id", near["h_break"].alias("h")).collect()) == want


def test_growth_rises_with_wind_and_fetch(spark):
    h, t = waves.fetch_limited_growth(F.col("u"), F.col("f"))
    df = spark.range(1, 30).select(F.col("id").cast("double").alias("u"), F.lit(5000.0).alias("f")).select("u", h.alias("h"), t.alias("t")).orderBy("u").toPandas()
    assert df.h.is_monotonic_increasing and df.t.is_monotonic_increasing
    x = 9.81 * 5000 / 100
    assert df.h[9] == pytest.approx(0.283 * 100 / 9.81 * math.tanh(0.53 * x**0.75))


def test_angles(spark):
    row = one(spark, angles.signed_difference(F.lit(10.0), F.lit(350.0)).alias("a"), angles.signed_difference(F.lit(180.0), F.lit(0.0)).alias("b"), angles.sector_name(F.lit(348.75)).alias("c"), angles.sector_name(F.lit(11.24)).alias("d"), angles.in_land_sector(F.lit(90.0), F.lit(0.0)).alias("e"), angles.in_land_sector(F.lit(270.0), F.lit(0.0)).alias("f"), angles.in_land_sector(F.lit(270.0), F.lit(0.0), "closed").alias("g"))
    assert tuple(row) == (20.0, -180.0, "N", "N", True, False, True)


def test_geodesy(spark):
    # along a meridian and along the equator the ellipsoid has closed forms
    lon, lat = geodesy.geodesic_destination(F.lit(10.0), F.lit(0.0), F.lit(90.0), 111319.49079327358)
    row = one(spark, lon.alias("lon"), lat.alias("lat"))
    assert row["lon"] == pytest.approx(11.0, abs=1e-9) and row["lat"] == pytest.approx(0.0, abs=1e-9)
    lon, lat = geodesy.geodesic_destination(F.lit(10.0), F.lit(0.0), F.lit(0.0), 110574.388558)
    assert one(spark, lat.alias("lat"))["lat"] == pytest.approx(1.0, abs=1e-6)
    e, n = geodesy.utm_forward(F.lit(39.0), F.lit(45.0), 37)
    row = one(spark, e.alias("e"), n.alias("n"))
    assert row["e"] == pytest.approx(500000.0, abs=1e-6) and row["n"] == pytest.approx(4982950.400, abs=0.01)


def test_index_properties(spark):
    r = random.Random(2)
    rows = [(p, r.randrange(360), r.choice([0.0, r.uniform(0, 500)])) for p in range(20) for _ in range(50)]
    df = spark.createDataFrame(rows, "point_id int, direction int, CWEF_W_m double")
    found = exposure.exposure_index(df).toPandas()
    assert found.K_dir.between(3 / 16 - 1e-4, 1).all() and found.WER.between(1, 5).all()
    for metric, rank in zip(exposure.METRICS, ("R1", "R2", "R3", "R4"), strict=True):
        assert found.sort_values(metric)[rank].is_monotonic_increasing
    same = exposure.quintile_ranks(spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "point_id int, m double"), {"m": "r", "absent": "s"})
    assert {tuple(x) for x in same.select("point_id", "r", "s").collect()} == {(1, 1, None), (2, 1, None), (3, None, None)}
    with pytest.raises(ValueError):
        exposure.exposure_metrics(df, percentile=100)


def test_nearest_and_weights(spark):
    r = random.Random(3)
    nodes = [(i, r.uniform(0, 1e6), r.uniform(0, 1e6)) for i in range(60)] + [(99, 5.0, 5.0)]
    points = [(i, r.uniform(-1e5, 1.1e6), r.uniform(0, 1e6)) for i in range(40)] + [(99, 5.0, 5.0)]
    p, n = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(nodes, "grid_id long, x double, y double")
    found = {}
    for row in weather.nearest_nodes(p, n, 3, cell=40000.0).collect():
        found.setdefault(row["point_id"], {})[row["rank"]] = row["grid_id"]
    for i, x, y in points:
        order = sorted(nodes, key=lambda g: (math.hypot(g[1] - x, g[2] - y), g[0]))
        assert [found[i][k] for k in (1, 2, 3)] == [g[0] for g in order[:3]]
    series = n.select("grid_id", F.lit("2024-01-01").alias("date"), (F.col("grid_id") * 1.0).alias("ws"), F.lit(350.0).alias("wd"))
    out = {row["point_id"]: row for row in weather.assign_idw(p, n, series, 3).collect()}
    assert out[99]["ws"] == 99.0 and all(row["wd"] == pytest.approx(350.0) for row in out.values())
    gone = series.withColumn("ws", F.when(F.col("grid_id") != 99, F.col("ws")))
    assert {row["point_id"]: row["ws"] for row in weather.assign_idw(p, n, gone, 3).collect()}[99] is None


def test_series_are_not_shuffled_by_points(spark, monkeypatch):
    """Every point, node and date was a row of a shuffle; now points of the same nodes meet a row a day, in many tasks."""
    r = random.Random(8)
    nodes = [(i, r.uniform(0, 1e5), r.uniform(0, 1e5)) for i in range(12)]
    points = [(i, r.uniform(0, 1e5), r.uniform(0, 1e5)) for i in range(150)] + [(500, *nodes[3][1:])]
    days = [(g, f"2024-01-{t:02}", None if (g, t) == (5, 2) else r.uniform(1, 9), r.uniform(0, 360)) for g, *_ in nodes for t in range(1, 7) if (g, t) not in {(4, 3), (3, 5)}]
    p, n = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(nodes, "grid_id long, x double, y double")
    series = spark.createDataFrame(days, "grid_id long, date string, ws double, wd double")
    by = {}
    for g, t, ws, wd in days:
        by.setdefault(t, {})[g] = (ws, wd)
    want = {}
    for i, x, y in points:
        near = sorted((math.hypot(gx - x, gy - y), g) for g, gx, gy in nodes)[:4]
        near = near[:1] if near[0][0] < 1e-9 else near
        for t, at in by.items():
            held = [(1 / max(d, 1e-9) ** 2, *at[g]) for d, g in near if g in at]
            if held:
                full = len(held) == len(near) and all(v[1] is not None for v in held)
                wd = math.degrees(math.atan2(sum(w * math.sin(math.radians(a)) for w, _, a in held), sum(w * math.cos(math.radians(a)) for w, _, a in held))) % 360
                want[i, t] = (sum(w * v for w, v, _ in held) / sum(v[0] for v in held), wd, len(held)) if full else (None, None, len(held))
    monkeypatch.setattr(weather, "SHARE", 7)
    out = weather.assign_idw(p, n, series)
    assert {(v["point_id"], v["date"]): (v["ws"], v["wd"], v["neighbours"]) for v in out.collect()} == {key: tuple(pytest.approx(v) if isinstance(v, float) else v for v in row) for key, row in want.items()}
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert not {"Aggregate", "Repartition"} & set(re.findall(r"\w+", tree[: tree.index("Join")]))  # nothing is shuffled after points and days have met
    nearest = weather.assign_nearest(p, n, series)
    assert nearest.count() == sum(min((math.hypot(gx - x, gy - y), g) for g, gx, gy in nodes)[1] in at for _, x, y in points for at in by.values())
    assert nearest.select(F.spark_partition_id()).distinct().count() > 3


def test_fetch_against_all_pairs(spark):
    r = np.random.default_rng(4)
    p = r.uniform(0, 30000, (10, 2))
    s = np.concatenate([r.uniform(0, 30000, (60, 2)), np.zeros((60, 2))], 1)
    s[:, 2:] = s[:, :2] + r.uniform(-3000, 3000, (60, 2))
    points = spark.createDataFrame([(i, float(a), float(b), float(i * 36)) for i, (a, b) in enumerate(p)], "point_id long, x double, y double, normal_azimuth_deg double")
    segments = spark.createDataFrame([tuple(map(float, x)) for x in s], "x0 double, y0 double, x1 double, y1 double")
    for row in fetch.trace_fetch(points, segments, list(range(0, 360, 30)), max_m=20000.0).collect():
        if row["skipped_by_land_sector"]:
            assert row["fetch_length_m"] == 10.0
            continue
        az = math.radians(row["azimuth_deg"])
        d, best = np.array([math.sin(az), math.cos(az)]) * 20000, 20000.0
        for x0, y0, x1, y1 in s:
            e, q = np.array([x1 - x0, y1 - y0]), np.array([x0 - row["start_x"], y0 - row["start_y"]])
            c = d[0] * e[1] - d[1] * e[0]
            t, u = (q[0] * e[1] - q[1] * e[0]) / c, (q[0] * d[1] - q[1] * d[0]) / c
            if 0 <= t <= 1 and 0 <= u <= 1 and t * 20000 > 1:
                best = min(best, t * 20000)
        assert row["fetch_length_m"] == pytest.approx(best, abs=0.2)


def test_lines(spark):
    x, y = np.array([0, 1, 2, 3, 4.0]), np.array([0, 0.1, 0, 5, 0.0])
    assert coast.douglas_peucker(x, y, 0.5).tolist() == [True, False, True, True, True]
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 100.0, 0.0), (1, 2, 100.0, 100.0)], "line_id long, pos long, x double, y double")
    got = [(r["x"], r["y"]) for r in coast.equal_step_points(v, 60.0).orderBy("point_order").collect()]
    assert np.allclose(got, [(0, 0), (60, 0), (100, 20), (100, 80), (100, 100)])
    ring = [(r["x"], r["y"]) for r in coast.equal_radius_points(v, 50.0).orderBy("point_order").collect()]
    assert all(math.dist(a, b) == pytest.approx(50, abs=1e-6) for a, b in zip(ring[:-2], ring[1:-1], strict=True)) and ring[-1] == (100.0, 100.0)
    n = coast.shore_normals(v, spark.createDataFrame([(1, 50.0, 1)], "line_id long, chainage_m double, point_id long")).first()
    assert (n["nx"], n["ny"], n["normal_azimuth_deg"]) == pytest.approx((0, -1, 180))
    assert coast.validate_normals(spark.createDataFrame([n], coast.shore_normals(v, spark.createDataFrame([(1, 50.0, 1)], "line_id long, chainage_m double, point_id long")).schema)).first()["is_valid"]


def test_trees(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (3, 4, 100.0), (3, 5, 200.0), (1, 3, 1.0), (8, 9, 2.0)], "u long, v long, weight double")
    forest = {(r["u"], r["v"]) for r in graph.maximum_spanning_forest(edges).collect()}
    assert forest == {(1, 2), (2, 3), (3, 4), (3, 5), (8, 9)}
    tree = edges.where("weight > 2")
    assert sorted(r["node"] for r in graph.diameter_path(tree).collect()) == [3, 4, 5]
    pruned = {(r["u"], r["v"]) for r in graph.prune_short_leaves(tree, 80.0).collect()}
    assert pruned == {(3, 4), (3, 5)}


def test_bad_arguments(spark):
    for call in (lambda: rose.sector_of("d", 5), lambda: rose.speed_class_edges("s", (0.0, 0.0)), lambda: coast.simplify_lines(None, -1.0), lambda: coast.shore_normals(None, None, "up"), lambda: angles.in_land_sector("a", "n", "x"), lambda: normalise.present(spark.range(1), ("x",))):
        with pytest.raises(ValueError):
            call()
    grid = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (1, 1, None)], "ix long, iy long, z double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 0.0)], "point_id long, lon double, lat double")
    assert {(r["point_id"], r["z"], r["outside"]) for r in bathymetry.depth_at(points, grid, 0.0, 0.0, 1.0, 2, 2).collect()} == {(1, None, False), (2, None, True)}
