"""Plans that have to hold at any size: what is not broadcast, how rows are dealt out."""

from pyspark.sql import functions as F

from tidewright.operators import bathymetry as B
from tidewright.operators import coast as L
from tidewright.operators import fetch as G


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_vertices(spark):
    """Two lines; Spark expects few bytes of them, as of coordinates that are computed from a key."""
    return spark.range(200).select((F.col("id") % 2).alias("line_id"), F.floor(F.col("id") / 2).alias("pos"), (F.col("id") * 3.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))


def test_vertices_are_not_broadcast(spark):
    v = some_vertices(spark)
    for df in (L.snap_vertices(v, 60.0), L.protected_vertices(v, v.where("pos % 10 = 0")), L.simplify_by_anchors(v, v.where("pos % 10 = 0"))):
        assert "Broadcast" not in plan_of(df)


def test_transects_of_one_file_are_many_tasks(spark):
    points = spark.range(64).coalesce(1).select(F.col("id").alias("point_id"), F.lit(37.0).alias("lon"), F.lit(43.0).alias("lat"))
    assert B.transects(points, [45.0]).select(F.spark_partition_id()).distinct().count() > 3


def test_depths_are_not_gathered(spark):
    """Points meet their cell once: no row for each corner and no grouping of the points; equal points stay two rows."""
    grid = spark.createDataFrame([(x, y, float(10 * x + y)) for x in range(3) for y in range(3)], "ix long, iy long, z double")
    points = spark.createDataFrame([(1, 0.5, 0.25), (1, 0.5, 0.25), (2, 2.0, 2.0), (3, 2.5, 0.0)], "point_id int, lon double, lat double")
    found = B.depth_at(points, grid, 0.0, 0.0, 1.0, 3, 3)
    assert sorted((r["point_id"], r["z"], r["outside"]) for r in found.collect() if not r["outside"]) == [(1, 5.25, False), (1, 5.25, False), (2, 22.0, False)]
    assert [(r["point_id"], r["z"]) for r in found.collect() if r["outside"]] == [(3, None)]


def test_geodesic_rays_that_have_hit_go_no_farther(spark, monkeypatch):
    """Three of four rays hit coast nearby; only the fourth is walked to its end, and all are dealt out."""
    points = spark.range(40).coalesce(1).select(F.col("id").alias("point_id"), F.lit(0.0).alias("normal_azimuth_deg"), (37 + F.col("id") * 0.001).alias("lon"), F.lit(43.0).alias("lat"))
    coast = spark.createDataFrame([(36.0, 43.004, 38.0, 43.004), (36.0, 42.97, 38.0, 42.97)], "x0 double, y0 double, x1 double, y1 double")
    seen, steps = [], G.geodesic_steps
    monkeypatch.setattr(G, "geodesic_steps", lambda *a: seen.append(steps(*a)) or seen[-1])
    found = {(r["point_id"], r["direction_id"]): r for r in G.geodesic_fetch(points, coast, [0.0, 180.0, 90.0], 1000.0, 10, 1.0, False).collect()}
    assert len(found) == 120 and [sum(r["hit_found"] for k, r in found.items() if k[1] == d) for d in range(3)] == [40, 40, 0]
    assert abs(found[0, 0]["fetch_m"] - 444.4) < 1 and abs(found[0, 1]["fetch_m"] - 3333) < 10 and found[0, 2]["fetch_m"] == 10_000
    assert {r["direction_id"] for r in seen[0].select("direction_id").distinct().collect()} == {2}
    assert steps(points, [0.0]).select(F.spark_partition_id()).distinct().count() > 3
