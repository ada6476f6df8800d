"""Fetch is traced with a row a point, shell by shell."""

import json
import random
import re

from pyspark.sql import functions as F

from tidewright.operators import fetch
from tidewright.plans import coast, space

R = random.Random(5)


def test_shells_hold_a_row_a_point(spark, monkeypatch):
    """Each shell was a row for every ray and cell, which did not end on dense coast. First hits are those of all crossings."""
    lines = [(R.uniform(-4e3, 4e3), R.uniform(-4e3, 4e3)) for _ in range(400)]
    rows = [(x, y, x + R.uniform(-300, 300), y + R.uniform(-300, 300)) for x, y in lines] + [(-15e3, -15e3, -9e3, 15e3), (0.0, 50.0, 0.0, 900.0), (0.2, 10.1, 70.0, 80.0)]
    segments = spark.createDataFrame(rows + rows[:50], "x0 double, y0 double, x1 double, y1 double")
    ends = [(i, R.uniform(-5e3, 5e3), R.uniform(-5e3, 5e3), float(R.randint(0, 359))) for i in range(70)] + [(70, 0.0, 0.0, 0.0), (70, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(ends, "point_id long, x double, y double, normal_azimuth_deg double")
    azimuths, tables, written = [0.0, 90.0, 359.5, 7.25, 180.0, 270.0], [], fetch.written
    monkeypatch.setattr(fetch, "written", lambda df, name="table": tables.append((name, written(df, name))) or tables[-1][1])
    sea = fetch.ray_ends(fetch.split_land_sector(fetch.point_azimuths(fetch.shifted_starts(points), azimuths))[0], 20_000.0)
    away = lambda a, b: F.hypot(F.col("hit_x") - F.col(a), F.col("hit_y") - F.col(b))
    every = fetch.hits(sea, segments, keys=("point_id", "direction_id", "start_x", "start_y", "x", "y"))
    first = every.where((away("start_x", "start_y") > 1) & (away("x", "y") > 1)).groupBy("point_id", "direction_id").agg(F.min(away("start_x", "start_y")).alias("d"))
    expected = {(r["point_id"], r["direction_id"]): r["d"] for r in first.collect()}
    for first_m in (None, 200.0):
        tables.clear()
        found = fetch.trace_fetch(points, segments, azimuths, max_m=20_000.0, first_m=first_m).collect()
        assert len(found) == len(ends) * len(azimuths)
        hit = {(r["point_id"], r["direction_id"]): r["fetch_length_m"] for r in found if r["hit_found"]}
        assert hit.keys() == expected.keys() and all(abs(hit[k] - expected[k]) < 1e-6 for k in hit)
        assert {r["fetch_length_m"] for r in found if not r["hit_found"]} == {10.0, 20_000.0}
        counts = [t.count() for name, t in tables if name == "fetch-shell"]
        assert counts[0] == len(ends) and counts == sorted(counts, reverse=True) and (len(counts) == 1) == (first_m is None)
    assert fetch.trace_fetch(points, segments.limit(0), azimuths).where("hit_found").count() == 0


def test_offset_segments_trace_once(spark, sf_dir, monkeypatch):
    """G-15 traced the same rays twice."""
    calls, trace = [], fetch.trace_fetch
    monkeypatch.setattr(fetch, "trace_fetch", lambda *a, **k: calls.append(1) or trace(a[0], a[1], [0.0, 90.0], **k))
    assert space.registry.queries["G-15"](spark, sf_dir).count() == 10 and len(calls) == 1


def some_coast(spark, n=300):
    r = random.Random(9)
    rows = [(x, y, x + r.uniform(-300, 300), y + r.uniform(-300, 300)) for x, y in ((r.uniform(-4e3, 4e3), r.uniform(-4e3, 4e3)) for _ in range(n))]
    return spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")


def some_points(spark, n):
    r = random.Random(10)
    rows = [(i, r.uniform(-5e3, 5e3), r.uniform(-5e3, 5e3), float(r.randint(0, 359))) for i in range(n)]
    return spark.createDataFrame(rows + rows[:1], "point_id long, x double, y double, normal_azimuth_deg double")


def test_coast_comes_to_few_shares(spark, monkeypatch):
    """A tile of many points had a share, and a copy of its coast, for every 32 of them."""
    points, dealt, sent = some_points(spark, 3000), fetch.dealt, []
    monkeypatch.setattr(fetch, "dealt", lambda df, *keys: sent.append(df) or dealt(df, *keys))
    fetch.trace_fetch(points, some_coast(spark), [0.0, 90.0], first_m=100_000.0)
    shares = [df.where("coast is not null").select("cx", "cy", "share").distinct().count() for df in sent]
    tiles = [df.where("row is not null").select("cx", "cy").distinct().count() for df in sent]
    assert shares[0] <= fetch.CORE_SHARES * spark.sparkContext.defaultParallelism + tiles[0] < 3000 / fetch.SHELL_POINTS


def test_land_needs_no_coast(spark, sf_dir, monkeypatch):
    """G-03 traced all rays to return those that are not traced; K-09 traced 360 directions to write one."""
    calls, shells = [], fetch._shells
    monkeypatch.setattr(fetch, "_shells", lambda *a, **k: calls.append(a[2]) or shells(*a, **k))
    assert space.registry.queries["G-03"](spark, sf_dir).count() == 10 * 180 and not calls
    assert coast.registry.queries["K-09"](spark, sf_dir).count() == 10 and calls == [[90.0]]


def test_points_are_gathered_from_shells(spark, monkeypatch):
    """fetch_by_point() grouped a row of 14 columns for every ray; rows of equal points are gathered with all of their rays."""
    points, segments, azimuths = some_points(spark, 60), some_coast(spark), [0.0, 45.0, 90.0, 200.5]
    want = {}
    for r in fetch.trace_fetch(points, segments, azimuths).collect():
        ray = (r["azimuth_deg"], r["direction_id"], round(r["fetch_length_m"], 3), r["hit_found"], r["used_default_value"], r["skipped_by_land_sector"], r["hit_x"] and round(r["hit_x"], 3), r["hit_y"] and round(r["hit_y"], 3))
        want.setdefault((r["point_id"], round(r["start_x"], 3)), []).append(ray)
    monkeypatch.setattr(fetch, "trace_fetch", None)
    found = fetch.fetch_by_point(points, segments, azimuths, digits=3).collect()
    names = ("azimuths_deg", "fetch_lengths_m", "hit_found_list", "used_default_value_list", "skipped_by_land_sector_list", "hit_xs", "hit_ys")
    rays = {(r["point_id"], r["start_x"]): [json.loads(r[n]) for n in names] for r in found}
    assert len(found) == len(rays) == len(want) == 60 and len(rays[0, next(k[1] for k in rays if k[0] == 0)][0]) == 8
    none_last = lambda ray: tuple((v is None, v) for v in ray)
    for key, every in want.items():
        a, length, hit, default, land, x, y = rays[key]
        every = sorted(every, key=none_last)
        assert a == sorted(v[0] for v in every) and sorted(zip(a, length, hit, default, land, x, y), key=none_last) == sorted(((v[0], *v[2:]) for v in every), key=none_last)


def test_directions_are_split_by_what_cannot_be_computed(spark):
    """K-08 shuffled all 14 columns of every ray."""
    traced = fetch.trace_fetch(some_points(spark, 40), some_coast(spark), [0.0, 90.0, 200.0])
    split = fetch.split_by_direction(traced)
    shuffled = split._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, fetch.long_frame(traced).collect()), key=repr)
    assert "start_x" not in re.search(r"RepartitionByExpression.*\n[^\n]*", shuffled)[0].split("\n")[0]
