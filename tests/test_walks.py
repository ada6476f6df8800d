"""Graphs that are long, and line operators, against plain restatements."""

import random
import time

import numpy as np
import pytest

from tidewright import plans, shared
from tidewright.functions import geodesy
from tidewright.operators import climate, coast, graph
from tidewright.plans import coast as C
from tidewright.plans.fixtures import view

QUERIES = plans.queries()
SMALL = "/root/testdata/sf0.001"


def edges_of(spark, rows):
    return spark.createDataFrame([(int(u), int(v), float(w)) for u, v, w in rows], "u long, v long, weight double")


def long_path(n, r):
    """A path through n shuffled nodes."""
    order = r.sample(range(n), n)
    return [(a, b, 1 + (i % 7)) for i, (a, b) in enumerate(zip(order, order[1:], strict=False))], order


def test_components_of_long_paths_and_loops(spark):
    rows, _ = long_path(3000, random.Random(1))
    ring = [(5000 + i, 5000 + (i + 1) % 40, 1) for i in range(40)]
    star = [(9000, 9001 + i, 1) for i in range(50)]
    found = dict(map(tuple, graph.components(edges_of(spark, rows + ring + star + [(7000, 7000, 1)])).collect()))
    assert {found[i] for i in range(3000)} == {0} and {found[5000 + i] for i in range(40)} == {5000}
    assert {found[9000 + i] for i in range(51)} == {9000} and found[7000] == 7000 and len(found) == 3000 + 40 + 51 + 1
    assert graph.components(edges_of(spark, rows).limit(0)).isEmpty()


def test_walks_go_to_the_end(spark):
    rows, order = long_path(1000, random.Random(2))
    ring = [(5000 + i, 5000 + (i + 1) % 40, 1) for i in range(40)]
    fork = [(order[-1], 2000, 4), (order[-1], 2001, 5)]
    found = {(r["leaf"], r["end"], r["length"]) for r in graph.leaf_branches(edges_of(spark, rows + fork + ring)).collect()}
    assert found == {(order[0], order[-1], sum(w for *_, w in rows)), (2000, order[-1], 4.0), (2001, order[-1], 5.0)}


def test_diameter_of_a_long_tree(spark):
    rows, order = long_path(700, random.Random(3))
    twigs = [(order[i], 10_000 + i, 2) for i in range(50, 600, 7)]
    other = [(90_000, 90_001, 1)]  # another tree
    edges = edges_of(spark, rows + twigs)
    path = {r["node"]: r["distance"] for r in graph.diameter_path(edges).collect()}
    ahead = np.concatenate([[0], np.cumsum([w for *_, w in rows])])
    whole = dict(zip(order, ahead if path[order[0]] == 0 else ahead[-1] - ahead, strict=True))
    assert path == whole
    far = {r["node"]: (r["distance"], r["parent"]) for r in graph.distances(edges.unionByName(edges_of(spark, other)), order[0]).collect()}
    assert set(far) == set(order) | {x for _, x, _ in twigs} and far[order[5]] == (ahead[5], order[4]) and far[10_050] == (ahead[50] + 2, order[50])


def test_written_tables_keep_loops_cheap(spark):
    df, times = spark.range(2000), []
    for _ in range(40):
        start = time.time()
        df = shared.written(df.join(df.select("id"), "id").join(df.select("id"), "id"))
        times.append(time.time() - start)
    assert df.count() == 2000 and np.median(times[-5:]) < 5 * np.median(times[2:10]) + 0.5


def test_no_shared_folder_off_local_mode():
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Nothing:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            @staticmethod
                            def isDefined():
                                return False

                        return Empty

                return Nothing

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)


def test_nearest_direction_by_brute_force(spark):
    r = random.Random(4)
    rows = [(p, d, float(r.randrange(1000))) for p, n in enumerate((1, 2, 3, 7, 360, 40)) for d in r.sample(range(360), n)] + [(7, 10, 5.0), (7, 10, 3.0), (7, 370, 4.0), (8, None, 1.0)]
    found = {(x["point_id"], x["direction"]): x["fetch_m"] for x in climate.densify_fetch(spark.createDataFrame(rows, "point_id int, direction int, fetch_m double")).collect()}
    want = {}
    for p in {x[0] for x in rows} - {8}:
        for d in range(360):
            want[p, d] = min((min(abs(a % 360 - d), 360 - abs(a % 360 - d)), a % 360, f) for q, a, f in rows if q == p)[2]
    assert found == want


def test_points_on_lines_by_brute_force(spark):
    r = np.random.default_rng(5)
    v = [(line, i, float(x), float(y)) for line in range(3) for i, (x, y) in enumerate(np.cumsum(r.uniform(-50, 200, (60, 2)).round(1), axis=0))]
    v.insert(5, (0, 1000, *v[59][2:]))  # the last vertex twice
    marks = [(line, float(c)) for line in range(3) for c in [-5.0, 0.0, 1e9, *r.uniform(0, 9000, 50)]]
    vertices, chainages = spark.createDataFrame(v, "line_id long, pos long, x double, y double"), spark.createDataFrame(marks, "line_id long, chainage_m double")
    for block in (50_000.0, 137.0):
        found = {(p["line_id"], p["chainage_m"]): (p["x"], p["y"]) for p in coast.points_at(vertices, chainages, block).collect()}
        assert len(found) == len(set(marks))
        for line, c in marks:
            p = np.array(sorted((i, x, y) for k, i, x, y in v if k == line))
            at = np.concatenate([[0], np.cumsum(np.hypot(np.diff(p[:, 1]), np.diff(p[:, 2])))])
            assert found[line, c] == pytest.approx((np.interp(c, at, p[:, 1]), np.interp(c, at, p[:, 2])), abs=1e-6)


def plain_chains(ends, gap, passes=20):
    """All pairs, in order."""
    chains, tips = {i: [i] for i, _, _ in ends}, {i: (h, t) for i, h, t in ends}
    for _ in range(passes):
        used, merged = set(), False
        for a in sorted(chains):
            if a in used or a not in chains:
                continue
            ways = [(float(np.hypot(p[0] - q[0], p[1] - q[1])), b, m) for b in sorted(chains) if b != a and b not in used for m, (p, q) in enumerate(((tips[a][1], tips[b][0]), (tips[a][1], tips[b][1]), (tips[a][0], tips[b][0]), (tips[a][0], tips[b][1])))]
            ways = [w for w in ways if w[0] <= gap]
            if ways:
                _, b, m = min(ways)
                (ah, at), (bh, bt) = tips[a], tips[b]
                tips[a] = ((ah, bt), (ah, bh), (at, bt), (bh, at))[m]
                chains[a] += chains.pop(b)
                used |= {a, b}
                merged = True
        if not merged:
            break
    return {i: c for c, held in chains.items() for i in held}


def test_chains_by_brute_force(spark):
    pieces = {}
    for r in C._pieces(spark, SMALL).collect():
        pieces.setdefault(r["line_id"], {})[r["pos"]] = (r["x"], r["y"])
    ends = [(i, p[0], p[1]) for i, p in sorted(pieces.items())]
    for gap in (150.0, 4000.0):
        want = plain_chains(ends, gap)
        assert {(r["line_id"], r["chain_id"]) for r in coast.chain_lines(C._pieces(spark, SMALL), gap).collect()} == set(want.items())
    assert QUERIES["C-14"](spark, SMALL).count() == len(ends) and len(set(plain_chains(ends, 4000.0).values())) < len(ends)


def runs_inside(p, q, low=20000.5, high=59999.5):
    """Whether some point of the bridge lies inside the shrunken box: its middle between two neighbouring crossings of the edges does."""
    cuts = {0.0, 1.0} | {t for k in (0, 1) for edge in (low, high) if p[k] != q[k] for t in [(edge - p[k]) / (q[k] - p[k])] if 0 < t < 1}
    cuts = sorted(cuts)
    return any(all(low < p[k] + (a + b) / 2 * (q[k] - p[k]) < high for k in (0, 1)) for a, b in zip(cuts, cuts[1:]))


def test_bridges_by_brute_force(spark):
    ends = [tuple(r) for r in C._ends(spark, "/root/testdata/sf0.01").select("end_id", "origin", "x", "y").collect()]
    ends.sort()
    used, want = set(), set()
    xy = np.array([e[2:] for e in ends])
    for i, (a, origin, x, y) in enumerate(ends):
        if a in used:
            continue
        d = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        ways = [(d[j], ends[j][0]) for j in np.flatnonzero((d > 2.0) & (d <= 2500.0)) if ends[j][0] > a and ends[j][1] != origin and ends[j][0] not in used and not runs_inside((x, y), xy[j])]
        if ways:
            used |= {a, min(ways)[1]}
            want.add((a, min(ways)[1]))
    start = time.time()
    assert {(r["a_end_id"], r["b_end_id"]) for r in QUERIES["C-19"](spark, "/root/testdata/sf0.01").collect()} == want
    assert time.time() - start < 60 and len(want) > 500


def test_simplified_lines_by_brute_force(spark):
    def keep(p, a, b):
        if b - a < 2:
            return set()
        (x0, y0), (x1, y1) = p[a], p[b]
        size = (x1 - x0) ** 2 + (y1 - y0) ** 2

        def away(q):
            t = min(1.0, max(0.0, ((q[0] - x0) * (x1 - x0) + (q[1] - y0) * (y1 - y0)) / size)) if size else 0.0
            u, v = q[0] - x0 - t * (x1 - x0), q[1] - y0 - t * (y1 - y0)
            return float(np.sqrt(u * u + v * v))  # vertices as far as one another are told apart by rounding alone, so it is that of the operator

        d, i = max((away(p[i]), -i) for i in range(a + 1, b))
        return {-i} | keep(p, a, -i) | keep(p, -i, b) if d > 120.0 else set()

    lines, want = {}, set()
    for r in sorted(C.vertices(spark, SMALL).collect()):
        lines.setdefault(r["line_id"], []).append((r["pos"], r["x"], r["y"]))
    for line, p in lines.items():
        want |= {(line, p[i][0]) for i in {0, len(p) - 1} | keep([q[1:] for q in p], 0, len(p) - 1)}
    assert {(r["line_id"], r["pos"]) for r in QUERIES["C-23"](spark, SMALL).collect()} == want


def test_equal_radius_points_lie_on_circles(spark):
    lines, found = {}, {}
    for r in sorted(C.vertices(spark, SMALL).collect()):
        lines.setdefault(r["line_id"], []).append((r["x"], r["y"]))
    for r in QUERIES["P-04"](spark, SMALL).collect():
        found.setdefault(r["line_id"], []).append((r["point_order"], r["x"], r["y"]))
    assert found.keys() == lines.keys()
    for line, points in found.items():
        p = np.array(sorted(points))[:, 1:]
        step = np.hypot(*np.diff(p, axis=0).T)
        assert np.allclose(step[:-1], 200.0, atol=1e-6) and step[-1] <= 200.0 + 1e-6
        v = np.array(lines[line])
        assert (p[0] == v[0]).all() and (p[-1] == v[-1]).all()
        # between one point and the next the line stays in the circle; dense samples show that none left it before
        at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(v, axis=0).T))])
        dense = np.arange(0, at[-1], 1.0)
        q, here = np.stack([np.interp(dense, at, v[:, 0]), np.interp(dense, at, v[:, 1])], axis=1), 0
        for a, b in zip(p, p[1:], strict=False):
            out = here + np.argmax(np.hypot(*(q[here:] - a).T) > 200.0 + 1e-6)
            if np.hypot(*(q[out] - a)) <= 200.0 + 1e-6:
                break
            assert np.hypot(*(q[out] - b)) <= 2.0
            here = out


def test_ends_of_geodesics(spark):
    points = {r["point_id"]: r for r in view(spark, SMALL, "v_points").collect()}
    for r in QUERIES["G-11"](spark, SMALL).collect():
        p = points[r["point_id"]]
        d = geodesy.distance(*(np.array([x]) for x in (p["lon"], p["lat"], r["lon2"], r["lat2"])))
        assert d[0] == pytest.approx(20_000.0, abs=1e-3)
    assert QUERIES["G-11"](spark, SMALL).count() == len(points)
