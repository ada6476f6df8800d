"""Queries that work on whole tables, against brute force on small ones."""

import numpy as np
import pytest

from tidewright import plans
from tidewright.plans import coast as C
from tidewright.plans.fixtures import view

QUERIES = plans.queries()
SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def neighbours(edges):
    found = {}
    for u, v, w in edges:
        found.setdefault(u, {})[v] = w
        found.setdefault(v, {})[u] = w
    return found


def branches(near):
    """(leaf, end, length, nodes up to the end)."""
    for leaf in [n for n in near if len(near[n]) == 1]:
        came, here, length, nodes = leaf, *next(iter(near[leaf].items())), [leaf]
        while len(near[here]) == 2:
            nodes.append(here)
            onward = next(n for n in near[here] if n != came)
            came, here, length = here, onward, length + near[here][onward]
        yield leaf, here, length, nodes


def pruned(edges, short=80.0, rounds=30):
    for _ in range(rounds):
        doomed = {n for _, _, length, nodes in branches(neighbours(edges)) if 0 < length < short for n in nodes}
        if not doomed:
            break
        edges = {e for e in edges if e[0] not in doomed and e[1] not in doomed}
    return edges


def farthest(near, source):
    seen, todo = {source: 0.0}, [source]
    for here in todo:
        for n, w in near[here].items():
            if n not in seen:
                seen[n] = seen[here] + w
                todo.append(n)
    return max(seen, key=seen.get), max(seen.values())


def test_graphs_are_whole(spark):
    edges = {tuple(r) for r in view(spark, SMALL, "v_edges").select("u", "v", "weight").collect()}
    near, component = neighbours(edges), {}
    for start in sorted(near):
        todo = [] if start in component else [start]
        for here in todo:
            if here not in component:
                component[here] = start
                todo += near[here]
    assert {(r["node"], r["component"]) for r in QUERIES["C-04"](spark, SMALL).collect()} == set(component.items())
    assert QUERIES["C-05"](spark, SMALL).count() == len(near) - len(set(component.values()))


def test_trees_are_whole(spark):
    edges = {(int(i) // 2, int(i), float(int(i) * 37 % 101 + 1)) for (i,) in view(spark, LARGER, "v_segments").select("seg_id").collect() if i > 0}
    near = neighbours(edges)
    assert len(edges) == 1999 and {tuple(r) for r in C.tree(spark, LARGER).collect()} == edges
    assert {tuple(r) for r in QUERIES["C-06"](spark, LARGER).select("leaf", "end", "length").collect()} == {x[:3] for x in branches(near)}
    path = {r["node"]: r["distance"] for r in QUERIES["C-08"](spark, LARGER).collect()}
    assert max(path.values()) == farthest(near, farthest(near, 0)[0])[1] and sum(len(set(near[n]) & set(path)) == 1 for n in path) == 2
    chains = QUERIES["C-20"](spark, LARGER).collect()
    assert len(chains) == len(edges) - sum(len(x) == 2 for x in near.values())
    assert sum(r["n_edges"] for r in chains) == len(edges) and sum(r["length"] for r in chains) == sum(e[2] for e in edges)


def test_pruning_has_all_rounds(spark):
    edges = {tuple(r) for r in C.tree(spark, SMALL).collect()}
    assert pruned(edges) != pruned(edges, rounds=2)
    assert {tuple(r) for r in QUERIES["C-07"](spark, SMALL).select("u", "v", "weight").collect()} == pruned(edges)


def test_normals_are_of_whole_lines(spark):
    want = {}
    v = C.vertices(spark, LARGER).toPandas().sort_values(["line_id", "pos"])
    for line, p in v.groupby("line_id"):
        x, y = p["x"].to_numpy(), p["y"].to_numpy()
        along = np.concatenate([[0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
        for i in range(int(along[-1] // 500) + 1):
            a, b = max(i * 500 - 5, 0), min(i * 500 + 5, along[-1])
            d = np.array([np.interp(b, along, x) - np.interp(a, along, x), np.interp(b, along, y) - np.interp(a, along, y)])
            want[line * 10000 + i] = (i * 500.0, *(d / np.hypot(*d)))
    found = {r["point_id"]: (r["chainage_m"], r["tx"], r["ty"]) for r in QUERIES["C-29"](spark, LARGER).collect()}
    assert found.keys() == want.keys()
    assert all(found[i] == pytest.approx(want[i], abs=2e-6) for i in want)
    assert QUERIES["C-24"](spark, LARGER).first().asDict() | {"n": len(want), "is_valid": True, "is_monotone": True, "n_repeated": 0} == QUERIES["C-24"](spark, LARGER).first().asDict()
    assert QUERIES["C-25"](spark, LARGER).first()["n"] == QUERIES["C-27"](spark, LARGER).count() == len(want)


def test_profiles_are_of_all_points(spark):
    points = view(spark, SMALL, "v_points").count()
    for name in ("B-05", "B-13"):
        rows = {(r["point_id"], r["direction"], r["step"]) for r in QUERIES[name](spark, SMALL).collect()}
        assert len(rows) == points * 2 * 200 and max(r[2] for r in rows) == 199
    ends = QUERIES["B-08"](spark, SMALL).collect()
    assert len(ends) == points * 2 and {r["distance_m"] for r in ends} == {20_000.0}


def test_profiles_between_ends_have_depths(spark):
    """B-05 stepped along a given azimuth, had no depths and took a sample's number for its distance."""
    from tidewright.functions import geodesy
    from tidewright.operators import bathymetry

    lines = spark.createDataFrame([(1, 0, 37.0, 43.0, 37.3, 43.2), (2, 0, 36.5, 42.9, 36.5, 42.9), (3, 0, 38.9, 45.0, 39.4, 45.1)], "point_id long, direction int, lon0 double, lat0 double, lon1 double, lat1 double")
    grid = view(spark, SMALL, "v_grid")
    found = bathymetry.line_profiles(lines, grid, {"west": 36.5, "south": 42.9, "step": 0.125, "nx": 21, "ny": 21}, samples=5)
    rows = {(r["point_id"], r["step"]): r for r in found.collect()}
    assert len(rows) == 15 and (rows[1, 0]["lon"], rows[1, 0]["lat"], rows[1, 4]["lon"], rows[1, 4]["lat"]) == (37.0, 43.0, 37.3, 43.2)
    length = float(geodesy.distance(*(np.array([v]) for v in (37.0, 43.0, 37.3, 43.2)))[0])
    assert all(rows[1, i]["distance_m"] == pytest.approx(length * i / 4, abs=1e-5) for i in range(5))
    node = {(r["ix"], r["iy"]): r["z"] for r in grid.collect()}
    for r in rows.values():
        fx, fy = (r["lon"] - 36.5) / 0.125, (r["lat"] - 42.9) / 0.125
        ix, iy = min(int(fx), 19), min(int(fy), 19)
        corners = sum((fx - ix if i else 1 - fx + ix) * (fy - iy if j else 1 - fy + iy) * node[ix + i, iy + j] for i in (0, 1) for j in (0, 1))
        assert r["z"] == (None if r["outside"] else pytest.approx(corners, abs=1e-9)) and r["outside"] == (r["lon"] > 39.0)
    assert {rows[2, i]["distance_m"] for i in range(5)} == {0.0} and any(r["outside"] for r in rows.values())
    with pytest.raises(ValueError):
        bathymetry.line_samples(lines, 1)
    whole = QUERIES["B-05"](spark, SMALL)
    assert {"distance_m", "lon", "lat", "z", "outside"} <= set(whole.columns) and whole.where("z is null and not outside").count() == 0 and whole.where("z is not null").count() > 0


def test_geodesic_rays_meet_the_whole_coast(spark, monkeypatch):
    from tidewright.operators import fetch
    from tidewright.plans import space

    seen = []
    monkeypatch.setattr(fetch, "geodesic_steps", lambda *a, f=fetch.geodesic_steps: seen.append(a[3]) or f(*a))
    for name in ("G-08", "G-09", "G-10"):
        QUERIES[name](spark, SMALL)
    assert seen == [200] * 3
    assert space._coast(spark, SMALL).count() == view(spark, SMALL, "v_segments").count()


def test_geodesic_fetch_against_all_segments(spark):
    from tidewright.functions import geodesy
    from tidewright.operators import fetch
    from tidewright.plans import space

    lon, lat = geodesy.direct(np.array([36.7]), np.array([43.2]), np.array([77.0]), 150_000.0)
    r = spark.range(1).select(*geodesy.geodesic_destination(*map(_lit, (36.7, 43.2, 77.0, 150_000.0)))).first()
    assert (lon[0], lat[0]) == pytest.approx(tuple(r), abs=1e-9)
    assert geodesy.distance(np.array([36.7]), np.array([43.2]), lon, lat)[0] == pytest.approx(150_000, abs=1e-3)

    points = view(spark, LARGER, "v_points").where("point_id < 12")
    coast = space._coast(spark, SMALL).toPandas()[["x0", "y0", "x1", "y1"]].to_numpy()
    held = {x["point_id"]: x for x in points.collect()}
    found = fetch.geodesic_fetch(points, space._coast(spark, SMALL), [10.0, 100.0, 190.0, 280.0]).collect()
    every = fetch.geodesic_fetch(points, space._coast(spark, SMALL), [10.0, 100.0, 190.0, 280.0], land_sector=False).collect()
    assert len(found) == len(every) == 4 * len(held)
    assert not any(x["skipped_by_land_sector"] for x in every) and any(x["hit_found"] and x["fetch_m"] % 1000 for x in every)
    for x in found + every:
        p = held[x["point_id"]]
        if x["skipped_by_land_sector"]:
            assert abs((x["azimuth_deg"] - p["normal_azimuth_deg"]) % 360 - 180) <= 90 and x["fetch_m"] == 1.0 and not x["hit_found"]
            continue
        want, az = 200_000.0, np.array([x["azimuth_deg"]])
        at = geodesy.direct(np.array([p["lon"]]), np.array([p["lat"]]), az, 1.0)
        for _ in range(200):
            to = geodesy.direct(*at, az, 1000.0)
            dx, dy = to[0] - at[0], to[1] - at[1]
            ex, ey, qx, qy = coast[:, 2] - coast[:, 0], coast[:, 3] - coast[:, 1], coast[:, 0] - at[0], coast[:, 1] - at[1]
            c = dx * ey - dy * ex
            t, u = (np.divide(v, c, out=np.full(len(c), -1.0), where=c != 0) for v in (qx * ey - qy * ex, qx * dy - qy * dx))
            good = t[(t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)]
            if len(good):
                want = geodesy.distance(np.array([p["lon"]]), np.array([p["lat"]]), at[0] + good.min() * dx, at[1] + good.min() * dy)[0]
                break
            at = to
        assert x["fetch_m"] == pytest.approx(want, abs=0.01) and x["hit_found"] == (want < 200_000)


def _lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
