"""What a loop or a recursion decides in order, decided in rounds."""

import random
import re

import numpy as np
import pytest

from tidewright import shared
from tidewright.operators import coast, fetch

R = random.Random(12)


def in_order(rows):
    used, out = set(), set()
    for a, d, b in sorted((a, d, b) for a, b, d in rows):
        if a not in used and b not in used:
            used |= {a, b}
            out.add((a, b))
    return out


@pytest.mark.parametrize("kind", ["anywhere", "along a line", "star"])
def test_greedy_pairs(spark, kind):
    n = 1500
    if kind == "anywhere":
        rows = {(a, b) for _ in range(4 * n) for a, b in [sorted(R.sample(range(n), 2))]}
    elif kind == "along a line":
        rows = {(i, i + k) for i in range(n) for k in (1, 2, 3)}
    else:
        rows = {(i, b) for i in range(n) for b in (n, n + 1, n + 2)}
    rows = [(a, b, float(R.randint(1, 9))) for a, b in rows]
    df = spark.createDataFrame(rows, "a long, b long, d double").repartition(4)
    for chunk in (100, 50_000):
        assert {(r["a"], r["b"]) for r in coast.greedy_pairs(df, chunk).collect()} == in_order(rows)
    assert coast.greedy_pairs(df.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["anywhere", "crowds", "one place"])
def test_bridges_meet_their_nearest_ends_only(spark, monkeypatch, kind):
    """All ends within max_gap of one another were written as pairs, and again in each round, which grew with the square of the density."""
    n = 700
    if kind == "anywhere":
        xy = [(R.uniform(0, 1000), R.uniform(0, 1000)) for _ in range(n)]
    elif kind == "crowds":
        xy = [(500.0 * R.randint(0, 1) + R.uniform(0, 40), 300.0 * R.randint(0, 2) + R.uniform(0, 40)) for _ in range(n - 60)] + [(R.uniform(0, 1000), R.uniform(0, 1000)) for _ in range(60)]
    else:
        xy = [(0.0, 0.0) if i % 2 else (float(R.randint(3, 5)), 0.0) for i in range(n)]  # ties everywhere
    ends = [(str(R.randint(0, 2)) if kind != "one place" else str(i % 2), i, *p) for i, p in enumerate(xy)]
    at = np.array(xy)
    rows = []
    for i, (origin, *_) in enumerate(ends):
        d = np.sqrt((at[:, 0] - at[i, 0]) * (at[:, 0] - at[i, 0]) + (at[:, 1] - at[i, 1]) * (at[:, 1] - at[i, 1]))
        rows += [(i, j, d[j]) for j in range(i + 1, n) if ends[j][0] != origin and 2 < d[j] <= 300]
    df, tables, written = spark.createDataFrame(ends, "origin string, end_id long, x double, y double"), [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, name="table": tables.append((name, (t := written(df, name)), t.count())) or t)
    for chunk in (100, 50_000) if kind == "anywhere" else (1000,):
        tables.clear()
        assert {(r["a_end_id"], r["b_end_id"]) for r in coast.bridges(df, 2.0, 300.0, None, chunk).collect()} == in_order(rows)
        assert max(c for name, _, c in tables if name == "partners") <= max(coast.PARTNERS * min(chunk, n), len(rows) if kind == "one place" else 0) < len(rows) * (2 if kind == "one place" else 1)
    assert coast.bridges(df.limit(0)).collect() == []


def test_lines_level_by_level(spark):
    rows, want = [], set()
    for line, n in ((1, 1), (2, 2), (3, 700), (4, 60), (5, 300)):
        x, y = np.cumsum([R.uniform(-1, 2) for _ in range(n)]), np.cumsum([R.uniform(-1, 1) for _ in range(n)])
        if line == 4:
            x, y = np.round(x), np.round(y)  # ties
        if line == 5:
            x[-1], y[-1] = x[0], y[0]  # a ring
        rows += [(line, i * 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        want |= {(line, int(i) * 3) for i in np.flatnonzero(coast.douglas_peucker(x, y, 1.5))}
    df = spark.createDataFrame(rows, "line_id long, pos long, x double, y double").repartition(5)
    for stretch in (0, 40, 10_000):
        found = [(r["line_id"], r["pos"]) for r in coast.simplify_lines(df, 1.5, stretch).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_bridges_stay_out_of_the_box(spark):
    ends = [(1, "a", 0.0, 0.0), (2, "b", 30.0, 0.0), (3, "a", 40.0, 12.0), (4, "b", 40.0, 40.0), (5, "a", 12.0, 10.0), (6, "b", 12.0, 30.0)]
    df = spark.createDataFrame(ends, "end_id long, origin string, x double, y double")
    found = lambda box: {(r["a_end_id"], r["b_end_id"]) for r in coast.bridges(df, 1.0, 60.0, box).collect()}
    assert found((10.0, 10.0, 35.0, 35.0)) == {(1, 2), (3, 4)}  # from 5 to 6 it leads through
    assert found(None) == {(1, 2), (3, 4), (5, 6)}
    assert found((12.0, 10.0, 35.0, 35.0)) == {(1, 2), (3, 4), (5, 6)}  # along the edge


def test_a_line_of_equal_waves_is_not_split_wave_by_wave(spark, monkeypatch):
    """Of equally far vertices the first is split off: a round for each took a line of n waves n rounds."""
    from tidewright import shared

    n, tables, written = 12_000, [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, name="table": tables.append(name) or written(df, name))
    x, y = np.arange(n, dtype=float), np.where(np.arange(n) % 100 == 50, 9.0, 0.0)
    df = spark.createDataFrame([(1, i, float(x[i]), float(y[i])) for i in range(n)], "line_id long, pos long, x double, y double")
    found = sorted(r["pos"] for r in coast.simplify_lines(df, 1.5).collect())
    assert found == np.flatnonzero(coast.douglas_peucker(x, y, 1.5)).tolist()
    assert len(tables) < 8


def test_fans_hit_what_rays_hit(spark):
    """Ends on rays, segments along rays, around, near and behind the point; a point meets a segment once, not once a cell."""
    from pyspark.sql import functions as F

    from tidewright.operators import fetch

    lines = [(R.uniform(-9e3, 9e3), R.uniform(-9e3, 9e3)) for _ in range(300)]
    rows = [(x, y, x + R.uniform(-900, 900), y + R.uniform(-900, 900)) for x, y in lines]
    rows += [(0.0, 50.0, 0.0, 900.0), (-40.0, 10.0, 60.0, 10.0), (0.0, 500.0, 300.0, 500.0), (0.2, 10.1, 70.0, 80.0), (-500.0, -500.0, -500.0, 500.0), (0.0, -99.0, 0.0, 99.0)]
    segments = spark.createDataFrame(rows + rows[:5], "x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1234.5, -777.0, 123.0)], "point_id long, x double, y double, normal_azimuth_deg double")
    sea = fetch.ray_ends(fetch.split_land_sector(fetch.point_azimuths(fetch.shifted_starts(points)))[0], 20_000.0)
    plain = fetch.hits(sea, segments).select("point_id", "direction_id", F.round("hit_x", 3), F.round("hit_y", 3)).distinct()
    expected = {tuple(r) for r in plain.collect()}
    found = [tuple(r) for r in fetch.fan_hits(points, segments, max_m=20_000.0).collect()]
    assert len(expected) > 500 and set(found) == expected and len(found) == len(expected)


def test_fans_send_rays_by_number_and_coast_to_few_shares(spark):
    """A row was shuffled for each ray, its ends with it, and a copy of the coast for every 256 points."""
    from pyspark.sql import functions as F

    from tidewright.operators import fetch

    points = spark.range(9000).select(F.col("id").alias("point_id"), (F.col("id") % 90 * 10.0).alias("x"), F.floor(F.col("id") / 90).cast("double").alias("y"), F.lit(0.0).alias("normal_azimuth_deg"))
    segments = spark.createDataFrame([(-100.0, 5000.0, 2000.0, 5000.0)], "x0 double, y0 double, x1 double, y1 double")
    found = fetch.fan_hits(points.unionByName(points.limit(5)), segments, max_m=20_000.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Generate (pos)?explode\(\[0\.0", plan) and "collect_list(struct" not in plan
    assert found.rdd.getNumPartitions() == fetch.CORE_SHARES * spark.sparkContext.defaultParallelism < 9000 / 256
    rows = found.where("direction_id = 1").select("point_id", "hit_x", "hit_y")
    assert rows.count() == rows.distinct().count() == 9000 and rows.where("hit_y <> 5000").count() == 0
