"""Queries of shore lines (C), points (P), sources (S) and sinks (K)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geodesy
from ..operators import bathymetry as B
from ..operators import coast as L
from ..operators import exposure as X
from ..operators import fetch as G
from ..operators import graph as Q
from ..operators import noding as D
from ..shared import shared_path
from ..sources import files as S
from ..streaming.backfill import SeriesStore, backfill
from .climate import daily
from .fixtures import Registry, view, views, with_views
from .space import GQ, GV, traced

registry = Registry()
add = registry.add

VERT = "SELECT CAST(seg_id % 7 AS BIGINT) AS line_id, CAST(floor(seg_id / 7) AS BIGINT) AS pos, floor(seg_id / 7) * 100.0 + (seg_id * 7919) % 50 AS x, CAST((seg_id * 10473) % 300 AS {d}) + (seg_id % 7) * 200 AS y FROM v_segments"


def vertices(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, "v_segments")
    pos = F.floor(F.col("seg_id") / 7)
    return v.select((F.col("seg_id") % 7).alias("line_id"), pos.cast("long").alias("pos"), (pos * 100.0 + (F.col("seg_id") * 7919) % 50).cast("double").alias("x"), ((F.col("seg_id") * 10473) % 300 + (F.col("seg_id") % 7) * 200).cast("double").alias("y"))


VQ = {"v": "SELECT line_id, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (" + VERT.format(d="DOUBLE") + ")"}
SEGS = {"segs": "SELECT *, sum(length) OVER (PARTITION BY line_id ORDER BY pos) - length AS start FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM (SELECT line_id, pos, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE x1 IS NOT NULL)"}


def tree(s, d):
    """A fixed tree over all segments: node i hangs on i div 2, lengths from the fixture; 0 is the root."""
    v = view(s, d, "v_segments").where("seg_id > 0")
    return v.select(F.floor(F.col("seg_id") / 2).alias("u"), F.col("seg_id").alias("v"), (F.col("seg_id") * 37 % 101 + 1).cast("double").alias("weight"))


EDGES = {"e": "SELECT * FROM v_edges"}
CC = {"cc": "SELECT node, min(seen) AS component FROM (WITH RECURSIVE reach(node, seen) AS (SELECT u, u FROM e UNION SELECT v, v FROM e UNION SELECT b.b, r.seen FROM reach r JOIN (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e) b ON b.a = r.node) SELECT * FROM reach) GROUP BY node"}
TREE = {"t": "SELECT CAST(floor(seg_id / 2) AS BIGINT) AS u, seg_id AS v, CAST(seg_id * 37 % 101 + 1 AS DOUBLE) AS weight FROM v_segments WHERE seg_id > 0"}

# ---- C ------------------------------------------------------------------------------------------------------------

add("C-01", lambda s, d: L.snap_vertices(vertices(s, d), 60.0).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)}), with_views("""SELECT a.line_id, a.pos, round(coalesce(m.b.x, a.x), 6) AS x, round(coalesce(m.b.y, a.y), 6) AS y, m.b IS NOT NULL AS is_snapped FROM v a LEFT JOIN
    (SELECT a.line_id, a.pos, arg_min(struct_pack(x := b.x, y := b.y), row(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.line_id, b.pos)) AS b FROM v a JOIN v b ON a.line_id <> b.line_id AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60
     WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60 GROUP BY 1, 2) m ON m.line_id = a.line_id AND m.pos = a.pos""", "v_segments", **VQ))
# snap rounding in whole millimetres: floor(a / b) of whole numbers is (a - ((a % b) + b) % b) // b
_FLOOR = lambda n, m: f"CAST((({n}) - ((({n}) % ({m})) + ({m})) % ({m})) // ({m}) AS BIGINT)"
_SIDE = lambda i, j: f"((ex - ax) * (2 * (py - ay) + {j}) - (ey - ay) * (2 * (px - ax) + {i}))"
NODING = {
    "px": "SELECT seg_id, " + ", ".join(f"CAST(floor(({c}) / 0.001::DOUBLE + 0.5) AS BIGINT) AS {n}" for c, n in (("x0", "ax"), ("y0", "ay"), ("x0 + (x1 - x0) * 15", "ex"), ("y0 + (seg_id % 51 - 25) * 150", "ey"))) + " FROM v_segments",
    "pairs": """SELECT a.ax, a.ay, a.ex - a.ax AS rx, a.ey - a.ay AS ry, b.ex - b.ax AS sx, b.ey - b.ay AS sy, b.ax - a.ax AS qx, b.ay - a.ay AS qy FROM px a JOIN px b ON a.seg_id < b.seg_id
        AND least(a.ax, a.ex) <= greatest(b.ax, b.ex) AND least(b.ax, b.ex) <= greatest(a.ax, a.ex) AND least(a.ay, a.ey) <= greatest(b.ay, b.ey) AND least(b.ay, b.ey) <= greatest(a.ay, a.ey)""",
    "met": "SELECT ax, ay, rx, ry, CAST(abs(den) AS HUGEINT) AS den, CAST(t * sign(den) AS HUGEINT) AS t FROM (SELECT *, rx * sy - ry * sx AS den, qx * sy - qy * sx AS t, qx * ry - qy * rx AS u FROM pairs) WHERE den <> 0 AND t * sign(den) BETWEEN 0 AND abs(den) AND u * sign(den) BETWEEN 0 AND abs(den)",
    "hot": f"SELECT DISTINCT px, py FROM (SELECT ax AS px, ay AS py FROM px WHERE ax <> ex OR ay <> ey UNION ALL SELECT ex, ey FROM px WHERE ax <> ex OR ay <> ey UNION ALL SELECT ax + {_FLOOR('2 * t * rx + den', '2 * den')}, ay + {_FLOOR('2 * t * ry + den', '2 * den')} FROM met)",
    "passed": f"""SELECT seg_id, px, py, (px - ax) * (ex - ax) + (py - ay) * (ey - ay) AS along FROM px JOIN hot ON px BETWEEN least(ax, ex) AND greatest(ax, ex) AND py BETWEEN least(ay, ey) AND greatest(ay, ey)
        WHERE (ax <> ex OR ay <> ey) AND (least({_SIDE(-1, -1)}, {_SIDE(-1, 1)}, {_SIDE(1, -1)}, {_SIDE(1, 1)}) < 0 AND greatest({_SIDE(-1, -1)}, {_SIDE(-1, 1)}, {_SIDE(1, -1)}, {_SIDE(1, 1)}) > 0 OR {_SIDE(-1, -1)} = 0)""",
}
def _crossing_segments(s, d):
    """Longer segments from the same places in all directions, which cross one another."""
    v = view(s, d, "v_segments")
    return v.withColumns({"x1": F.col("x0") + (F.col("x1") - F.col("x0")) * 15, "y1": F.col("y0") + (F.col("seg_id") % 51 - 25) * 150})


add("C-02", lambda s, d: D.node_pieces(_crossing_segments(s, d)), with_views("SELECT * FROM (SELECT seg_id, row_number() OVER w AS piece, px AS ux, py AS uy, lead(px) OVER w AS vx, lead(py) OVER w AS vy FROM passed WINDOW w AS (PARTITION BY seg_id ORDER BY along, px, py)) WHERE vx IS NOT NULL", "v_segments", **NODING))
add("C-03", lambda s, d: Q.build_edges(view(s, d, "v_edges").unionByName(view(s, d, "v_edges").select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("weight") * 2).alias("weight")))), with_views("SELECT u, v, weight * 2 AS weight FROM v_edges", "v_edges"))
add("C-04", lambda s, d: Q.components(view(s, d, "v_edges")), with_views("SELECT node, component FROM cc", "v_edges", **EDGES, **CC))
# edge by edge, the heaviest first: one that joins two different labels is taken, and its labels become one
KRUSKAL = """SELECT edge.u AS u, edge.v AS v, edge.weight AS weight FROM (
    WITH RECURSIVE node AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS i FROM (SELECT u AS node FROM e UNION SELECT v FROM e)),
    ranked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY weight DESC, u, v) AS n, u, v, weight, a.i AS iu, b.i AS iv FROM e JOIN node a ON a.node = e.u JOIN node b ON b.node = e.v),
    g(edge, labels) AS (SELECT CAST(NULL AS STRUCT(n BIGINT, u BIGINT, v BIGINT, weight DOUBLE, iu BIGINT, iv BIGINT)), range(1, (SELECT count(*) + 1 FROM node)) UNION ALL
      SELECT x, list_transform(labels, lambda l: CASE WHEN l = labels[x.iv] THEN labels[x.iu] ELSE l END)
      FROM (SELECT arg_min(struct_pack(n := r.n, u := r.u, v := r.v, weight := r.weight, iu := r.iu, iv := r.iv), r.n) AS x, any_value(labels) AS labels FROM g JOIN ranked r ON (g.edge IS NULL OR r.n > g.edge.n) AND labels[r.iu] <> labels[r.iv]) WHERE x IS NOT NULL)
    SELECT edge FROM g WHERE edge IS NOT NULL)"""
add("C-05", lambda s, d: Q.maximum_spanning_forest(view(s, d, "v_edges")).select("u", "v", "weight"), with_views(KRUSKAL, "v_edges", **EDGES))
add("C-06", lambda s, d: Q.leaf_branches(tree(s, d)), with_views("""SELECT leaf, here AS "end", length FROM (WITH RECURSIVE w AS (SELECT u AS a, v AS b, weight FROM t UNION ALL SELECT v, u, weight FROM t), deg AS (SELECT a AS node, count(*) AS k FROM w GROUP BY 1),
    walk(leaf, came, here, length) AS (SELECT w.a, w.a, w.b, w.weight FROM w JOIN deg ON deg.node = w.a AND k = 1 UNION ALL SELECT leaf, here, w.b, length + w.weight FROM walk JOIN deg ON deg.node = here AND k = 2 JOIN w ON w.a = here AND w.b <> came)
    SELECT walk.* FROM walk JOIN deg ON deg.node = here AND k <> 2)""", "v_segments", **TREE))
add("C-07", lambda s, d: Q.prune_short_leaves(tree(s, d), 80.0))
add("C-08", lambda s, d: Q.diameter_path(tree(s, d)), with_views("""SELECT p.node AS node, p.distance AS distance FROM (SELECT unnest(path) AS p FROM (WITH RECURSIVE w AS (SELECT u AS a, v AS b, weight FROM t UNION ALL SELECT v, u, weight FROM t),
    one(node, came, distance) AS (SELECT min(a), CAST(NULL AS BIGINT), 0.0::DOUBLE FROM w UNION ALL SELECT w.b, one.node, distance + weight FROM one JOIN w ON w.a = one.node AND w.b IS DISTINCT FROM came),
    two(node, came, distance, path) AS (SELECT node, CAST(NULL AS BIGINT), 0.0::DOUBLE, [struct_pack(node := node, distance := 0.0::DOUBLE)] FROM (SELECT node FROM one ORDER BY distance DESC, node LIMIT 1)
      UNION ALL SELECT w.b, two.node, distance + weight, list_append(path, struct_pack(node := w.b, distance := distance + weight)) FROM two JOIN w ON w.a = two.node AND w.b IS DISTINCT FROM came)
    SELECT path FROM two ORDER BY distance DESC, node LIMIT 1))""", "v_segments", **TREE))
add("C-09", lambda s, d: Q.crossings(view(s, d, "v_edges"), 3), with_views("SELECT node, count(*) AS degree FROM (SELECT u AS node FROM v_edges UNION ALL SELECT v FROM v_edges) GROUP BY 1 HAVING count(*) >= 3", "v_edges"))
_anchors = lambda s, d: vertices(s, d).where("pos % 10 = 0").select((F.col("x") + 0.02).alias("x"), "y")
add("C-10", lambda s, d: L.protected_vertices(vertices(s, d), _anchors(s, d)).select("line_id", "pos"), with_views("SELECT line_id, pos FROM v WHERE pos % 10 = 0", "v_segments", **VQ))
BEND = {"b": "SELECT line_id, pos, x, y, least(t, 180 - t) AS bend FROM (SELECT *, abs(degrees(atan2(lead(y) OVER w - y, lead(x) OVER w - x)) - degrees(atan2(y - lag(y) OVER w, x - lag(x) OVER w))) % 180 AS t FROM v WINDOW w AS (PARTITION BY line_id ORDER BY pos))"}
add("C-11", lambda s, d: vertices(s, d).withColumn("bend", F.round(L.bend_deg(), 6)).select("line_id", "pos", "bend"), with_views("SELECT line_id, pos, round(bend, 6) AS bend FROM b", "v_segments", **VQ, **BEND))
add("C-12", lambda s, d: L.simplify_by_anchors(vertices(s, d), vertices(s, d).where("pos % 10 = 0"), 60.0).select("line_id", "pos"), with_views("SELECT line_id, pos FROM b WHERE bend IS NULL OR bend > 60 OR pos % 10 = 0", "v_segments", **VQ, **BEND))
ROLES = {"len": "SELECT line_id, sum(length) AS length_m FROM segs GROUP BY 1"}
add("C-13", lambda s, d: L.tag_main(vertices(s, d)).withColumn("length_m", F.round("length_m", 4)), with_views("SELECT l.line_id, n AS n_vertices, round(length_m, 4) AS length_m, CASE WHEN l.line_id = (SELECT arg_max(line_id, row(length_m, -line_id)) FROM len) THEN 'main' ELSE 'other' END AS coastline_role FROM len l JOIN (SELECT line_id, count(*) AS n FROM v GROUP BY 1) c ON c.line_id = l.line_id", "v_segments", **VQ, **SEGS, **ROLES))
_pieces = lambda s, d: view(s, d, "v_segments").select(F.col("seg_id").alias("line_id"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("line_id", "p.*")
add("C-14", lambda s, d: L.chain_lines(_pieces(s, d), 150.0))
add("C-15", lambda s, d: L.line_ends(vertices(s, d)).select(F.col("line_id"), L.join_mode((F.col("head.x"), F.col("head.y")), (F.col("tail.x"), F.col("tail.y")), (F.lit(0.0), F.lit(0.0)), (F.lit(30000.0), F.lit(500.0))).alias("j")).select("line_id", F.round("j.d", 6).alias("d"), F.col("j.mode").alias("mode")), with_views("""SELECT line_id, round(list_min(ds), 6) AS d, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS mode FROM (SELECT line_id, [sqrt(tx * tx + ty * ty), sqrt(pow(tx - 30000, 2) + pow(ty - 500, 2)), sqrt(hx * hx + hy * hy), sqrt(pow(hx - 30000, 2) + pow(hy - 500, 2))] AS ds
    FROM (SELECT line_id, arg_min(x, pos) AS hx, arg_min(y, pos) AS hy, arg_max(x, pos) AS tx, arg_max(y, pos) AS ty FROM v GROUP BY 1))""", "v_segments", **VQ))
BOX = (20000.0, 20000.0, 60000.0, 60000.0)
CLIP = {"ab": "SELECT seg_id, x0, y0, x1, y1, greatest(0, CASE WHEN x1 > x0 THEN (20000 - x0) / (x1 - x0) ELSE CASE WHEN x0 >= 20000 AND x0 <= 60000 THEN 0 ELSE 2 END END, CASE WHEN y1 > y0 THEN (20000 - y0) / (y1 - y0) ELSE CASE WHEN y0 >= 20000 AND y0 <= 60000 THEN 0 ELSE 2 END END) AS t0, least(1, CASE WHEN x1 > x0 THEN (60000 - x0) / (x1 - x0) ELSE 1 END, CASE WHEN y1 > y0 THEN (60000 - y0) / (y1 - y0) ELSE 1 END) AS t1 FROM v_segments",
        "inside": "SELECT * FROM ab WHERE t0 <= t1",
        "erased": "SELECT s.seg_id, 0.0::DOUBLE AS t0, coalesce(i.t0, 1) AS t1 FROM v_segments s LEFT JOIN inside i ON i.seg_id = s.seg_id WHERE coalesce(i.t0, 1) > 0 UNION ALL SELECT seg_id, t1, 1 FROM inside WHERE t1 < 1"}
_t = lambda df: df.withColumns({"t0": F.round("t0", 6), "t1": F.round("t1", 6)})
add("C-16", lambda s, d: _t(L.merge_with_replacement(view(s, d, "v_segments"), view(s, d, "v_segments"), BOX)).select("seg_id", "t0", "t1", "origin"), with_views("SELECT seg_id, round(t0, 6) AS t0, round(t1, 6) AS t1, 'outer' AS origin FROM erased UNION ALL SELECT seg_id, round(t0, 6), round(t1, 6), 'inner' FROM inside WHERE t1 > t0", "v_segments", **CLIP))
add("C-17", lambda s, d: _t(L.clip_segments(view(s, d, "v_segments"), *BOX)).select("seg_id", "t0", "t1"), with_views("SELECT seg_id, round(t0, 6)::DOUBLE AS t0, round(t1, 6)::DOUBLE AS t1 FROM inside", "v_segments", **CLIP))
_ends = lambda s, d: view(s, d, "v_segments").select(F.when(F.col("seg_id") % 2 == 0, "a").otherwise("b").alias("origin"), F.col("seg_id").alias("end_id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
ENDS = {"ends": "SELECT CASE WHEN seg_id % 2 = 0 THEN 'a' ELSE 'b' END AS origin, seg_id AS end_id, x0 AS x, y0 AS y FROM v_segments",
        "nearby": "SELECT *, CASE list_position(ds, list_min(ds)) WHEN 1 THEN 'west' WHEN 2 THEN 'east' WHEN 3 THEN 'south' ELSE 'north' END AS side FROM (SELECT *, [abs(x - 20000), abs(x - 60000), abs(y - 20000), abs(y - 60000)] AS ds FROM ends) WHERE list_min(ds) <= 400"}
add("C-18", lambda s, d: L.open_ends(_ends(s, d), BOX, 400.0).select("origin", "end_id", "side"), with_views("SELECT origin, end_id, side FROM nearby a WHERE NOT EXISTS (SELECT 1 FROM nearby b WHERE b.origin <> a.origin AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 400)", "v_segments", **ENDS))
# in the order of first ends; of candidates that run along neither outside nor edge of the box, the slab between entering and leaving it is empty
_SLAB = lambda c, o, f: f"{f}(CASE WHEN b.{c} <> a.{c} THEN {o}((20000.5 - a.{c}) / (b.{c} - a.{c}), (59999.5 - a.{c}) / (b.{c} - a.{c})) END, "
BRIDGES = {"near": f"""SELECT a.end_id AS a, b.end_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM ends a JOIN ends b ON a.origin <> b.origin AND a.end_id < b.end_id AND abs(a.x - b.x) <= 2500 AND abs(a.y - b.y) <= 2500
    WHERE NOT ({_SLAB("x", "least", "greatest")}{_SLAB("y", "least", "greatest")}0)) < {_SLAB("x", "greatest", "least")}{_SLAB("y", "greatest", "least")}1)) AND (a.x <> b.x OR a.x > 20000.5 AND a.x < 59999.5) AND (a.y <> b.y OR a.y > 20000.5 AND a.y < 59999.5))""",
    "c": "SELECT * FROM near WHERE d > 2 AND d <= 2500"}
add("C-19", lambda s, d: L.bridges(_ends(s, d), 2.0, 2500.0, BOX), with_views("""SELECT p.a AS a_end_id, p.b AS b_end_id, p.d AS d FROM (
    WITH RECURSIVE held AS MATERIALIZED (SELECT a, list_sort(list(struct_pack(d := d, b := b))) AS ways FROM c GROUP BY 1), chooser AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a) AS n, * FROM held),
    g(n, p, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS STRUCT(a BIGINT, b BIGINT, d DOUBLE)), CAST(repeat('0', (SELECT max(end_id) + 1 FROM ends)) AS BIT) UNION ALL
      SELECT n, CASE WHEN w IS NOT NULL THEN struct_pack(a := a, b := w.b, d := w.d) END, CASE WHEN w IS NULL THEN used ELSE set_bit(set_bit(used, CAST(a AS INTEGER), 1), CAST(w.b AS INTEGER), 1) END
      FROM (SELECT chooser.n, a, used, CASE WHEN get_bit(used, CAST(a AS INTEGER)) = 0 THEN list_filter(ways, lambda x: get_bit(used, CAST(x.b AS INTEGER)) = 0)[1] END AS w FROM g JOIN chooser ON chooser.n = g.n + 1))
    SELECT p FROM g WHERE p IS NOT NULL)""", "v_segments", **ENDS, **BRIDGES))
add("C-20", lambda s, d: L.contract_chains(tree(s, d)).select("n_edges", "length"), with_views("""SELECT n_edges, length FROM (WITH RECURSIVE w AS (SELECT u AS a, v AS b, weight FROM t UNION ALL SELECT v, u, weight FROM t), deg AS (SELECT a AS node, count(*) AS k FROM w GROUP BY 1),
    walk(start, came, here, n_edges, length) AS (SELECT w.a, w.a, w.b, 1, w.weight FROM w JOIN deg ON deg.node = w.a AND k <> 2 UNION ALL SELECT start, here, w.b, n_edges + 1, length + w.weight FROM walk JOIN deg ON deg.node = here AND k = 2 JOIN w ON w.a = here AND w.b <> came)
    SELECT CAST(n_edges AS BIGINT) AS n_edges, length FROM walk JOIN deg ON deg.node = here AND k <> 2 WHERE start < here)""", "v_segments", **TREE))
add("C-21", lambda s, d: L.line_summary(vertices(s, d)).withColumn("length_m", F.round("length_m", 4)), with_views("SELECT a.*, round(length_m, 4) AS length_m FROM (SELECT line_id, count(*) AS n_vertices, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM v GROUP BY 1) a JOIN len l ON l.line_id = a.line_id", "v_segments", **VQ, **SEGS, **ROLES))
add("C-22", lambda s, d: view(s, d, "v_points").select("point_id", geodesy.utm_epsg("lon", "lat").alias("epsg")), with_views("SELECT point_id, CAST(32601 + floor((lon + 180) / 6) AS INTEGER) AS epsg FROM v_points", "v_points"))
add("C-23", lambda s, d: L.simplify_lines(vertices(s, d), 120.0), with_views("""SELECT line_id, pos, x, y FROM v JOIN (SELECT DISTINCT line_id, unnest([a, b]) AS pos FROM (
    WITH RECURSIVE iv(line_id, a, b) AS (SELECT line_id, min(pos), max(pos) FROM v GROUP BY 1 UNION ALL
      SELECT line_id, p[1], p[2] FROM (SELECT line_id, unnest([[a, m], [m, b]]) AS p FROM (SELECT line_id, a, b, max(d) AS d, arg_max(pos, row(d, -pos)) AS m FROM (
        SELECT line_id, a, b, pos, sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)) AS d FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(least((px * dx + py * dy) / (dx * dx + dy * dy), 1), 0) ELSE 0 END AS t FROM (
          SELECT iv.line_id, a, b, v.pos, v.x - va.x AS px, v.y - va.y AS py, vb.x - va.x AS dx, vb.y - va.y AS dy FROM iv JOIN v ON v.line_id = iv.line_id AND v.pos > a AND v.pos < b JOIN v va ON va.line_id = iv.line_id AND va.pos = a JOIN v vb ON vb.line_id = iv.line_id AND vb.pos = b)))
        GROUP BY 1, 2, 3) WHERE d > 120))
    SELECT * FROM iv)) USING (line_id, pos)""", "v_segments", **VQ))


def normals(s, d):
    p, i = vertices(s, d), F.col("point_order").cast("long")
    # from 10,000 points of a line on, its numbers go on above those of the other lines
    number = F.col("line_id") * 10000 + i % 10000 + F.floor(i / 10000) * 70000
    pts = L.equal_step_points(p, 500.0, include_ends=False).select("line_id", "chainage_m", "x", "y", number.alias("point_id"))
    return L.shore_normals(p, pts)


LOC = "SELECT c.line_id, c.point_id, c.chainage_m, c.{k} AS k, s.x0 + least((c.{k} - start) / length, 1) * (x1 - x0) AS x, s.y0 + least((c.{k} - start) / length, 1) * (y1 - y0) AS y FROM chain c JOIN whole s ON s.line_id = c.line_id AND c.{k} >= start AND (c.{k} < start + length OR pos = last)"
NORMALS = {"whole": "SELECT *, max(pos) OVER (PARTITION BY line_id) AS last FROM segs",
           "chain": "SELECT *, greatest(chainage_m - 5, 0) AS a, least(chainage_m + 5, total) AS b FROM (SELECT line_id, total, line_id * 10000 + i % 10000 + CAST(floor(i / 10000) AS BIGINT) * 70000 AS point_id, i * 500.0::DOUBLE AS chainage_m FROM (SELECT *, unnest(range(0, CAST(floor(total / 500) AS BIGINT) + 1)) AS i FROM (SELECT line_id, sum(length) AS total FROM whole GROUP BY 1)))",
           "la": LOC.format(k="a"), "lb": LOC.format(k="b"), "lc": LOC.format(k="chainage_m"),
           "nrm": "SELECT point_id, line_id, chainage_m, tx, ty, ty AS nx, -tx AS ny, (degrees(atan2(ty, -tx)) + 360) % 360 AS az FROM (SELECT la.point_id, la.line_id, la.chainage_m, (lb.x - la.x) / sqrt(pow(lb.x - la.x, 2) + pow(lb.y - la.y, 2)) AS tx, (lb.y - la.y) / sqrt(pow(lb.x - la.x, 2) + pow(lb.y - la.y, 2)) AS ty FROM la JOIN lb ON lb.point_id = la.point_id)"}
NQ = VQ | SEGS | NORMALS
add("C-24", lambda s, d: L.validate_normals(normals(s, d)), with_views("SELECT count(*) AS n, 0 AS n_null, 0 AS n_bad_tangent, 0 AS n_bad_normal, 0 AS n_bad_azimuth, 0 AS n_repeated, true AS is_monotone, true AS is_valid FROM nrm", "v_segments", **NQ))
add("C-25", lambda s, d: L.normals_summary(normals(s, d)).withColumn("azimuth_mean", F.round("azimuth_mean", 5)), with_views("SELECT count(*) AS n, min(chainage_m) AS chainage_min, max(chainage_m) AS chainage_max, round(avg(az), 5) AS azimuth_mean, 'right' AS sea_sides FROM nrm", "v_segments", **NQ))
add("C-26", lambda s, d: view(s, d, "v_points").select("point_id", "chainage_m").orderBy("chainage_m"), with_views("SELECT point_id, chainage_m FROM v_points ORDER BY chainage_m", "v_points"))
add("C-27", lambda s, d: L.normal_lines(normals(s, d)).select("point_id", F.round("end_x", 4).alias("end_x"), F.round("end_y", 4).alias("end_y")), with_views("SELECT n.point_id, round(lc.x + nx * 200, 4) AS end_x, round(lc.y + ny * 200, 4) AS end_y FROM nrm n JOIN lc ON lc.point_id = n.point_id", "v_segments", **NQ))
add("C-28", lambda s, d: L.tag_main(vertices(s, d)).where("coastline_role = 'main'").select("line_id", F.round("length_m", 4).alias("length_m")), with_views("SELECT arg_max(line_id, row(length_m, -line_id)) AS line_id, round(max(length_m), 4) AS length_m FROM len", "v_segments", **VQ, **SEGS, **ROLES))
add("C-29", lambda s, d: normals(s, d).select("point_id", "chainage_m", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "nx", "ny")], F.round("normal_azimuth_deg", 4).alias("normal_azimuth_deg")), with_views("SELECT point_id, chainage_m, round(tx, 6) AS tx, round(ty, 6) AS ty, round(nx, 6) AS nx, round(ny, 6) AS ny, round(az, 4) AS normal_azimuth_deg FROM nrm", "v_segments", **NQ))
add("C-30", lambda s, d: X.shore_normal_from_fetch(view(s, d, "v_trace")), with_views("SELECT point_id, arg_max(direction, row(round(sm, 6), -direction)) AS normal_deg FROM (SELECT *, avg(fetch_m) OVER (PARTITION BY point_id ORDER BY direction ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS sm FROM v_trace) GROUP BY 1", "v_trace"))

# ---- P ------------------------------------------------------------------------------------------------------------

_roles = lambda s, d: vertices(s, d).join(L.tag_main(vertices(s, d)).select("line_id", "coastline_role"), "line_id")
add("P-01", lambda s, d: _roles(s, d).where("coastline_role = 'main'").select("line_id", "pos", "x", "y"), with_views("SELECT line_id, pos, x, y FROM v WHERE line_id = (SELECT arg_max(line_id, row(length_m, -line_id)) FROM len)", "v_segments", **VQ, **SEGS, **ROLES))
_coarse = lambda s, d: vertices(s, d).withColumns({"x": F.round(F.col("x") / 500), "y": F.round(F.col("y") / 500)})
add("P-02", lambda s, d: L.node_points(_coarse(s, d)), with_views("SELECT line_id, pos, x, y FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY line_id, pos) AS nth FROM (SELECT line_id, pos, round(x / 500) AS x, round(y / 500) AS y FROM v)) WHERE nth = 1", "v_segments", **VQ))
STEP = {"tot": "SELECT line_id, sum(length) AS total, max(pos) AS last FROM segs GROUP BY 1", "marks": "SELECT line_id, last, unnest(range(0, CAST(floor(total / 700) AS BIGINT) + 1)) * 700.0::DOUBLE AS c FROM tot UNION ALL SELECT line_id, last, total FROM tot WHERE total % 700 <> 0",
        "placed": "SELECT m.line_id, round(c, 4) AS chainage_m, round(x0 + least((c - start) / length, 1) * (x1 - x0), 3) AS x, round(y0 + least((c - start) / length, 1) * (y1 - y0), 3) AS y FROM marks m JOIN segs s ON s.line_id = m.line_id AND c >= start AND (c < start + length OR s.pos = last)"}
_steps = lambda s, d: L.equal_step_points(vertices(s, d), 700.0)
add("P-03", lambda s, d: _steps(s, d).select("line_id", F.round("chainage_m", 4).alias("chainage_m"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y")), with_views("SELECT * FROM placed", "v_segments", **VQ, **SEGS, **STEP))
add("P-04", lambda s, d: L.equal_radius_points(vertices(s, d), 200.0))
add("P-05", lambda s, d: L.combine_points(("nodes", L.node_points(_coarse(s, d))), ("vertices", _coarse(s, d).where("pos > 3"))).groupBy("source_strategy").count(), with_views("SELECT 'nodes' AS source_strategy, count(*) AS count FROM (SELECT DISTINCT round(x / 500), round(y / 500) FROM v)", "v_segments", **VQ))
add("P-06", lambda s, d: _steps(s, d).agg(F.lit("equal_step").alias("strategy"), F.count(F.lit(1)).alias("n_points"), F.countDistinct("line_id").alias("n_lines")), with_views("SELECT 'equal_step' AS strategy, count(*) AS n_points, count(DISTINCT line_id) AS n_lines FROM placed", "v_segments", **VQ, **SEGS, **STEP))
add("P-07", lambda s, d: L.line_summary(vertices(s, d)).select("line_id", "n_vertices", F.round("length_m", 3).alias("length_m")), with_views("SELECT l.line_id, n AS n_vertices, round(length_m, 3) AS length_m FROM len l JOIN (SELECT line_id, count(*) AS n FROM v GROUP BY 1) c ON c.line_id = l.line_id", "v_segments", **VQ, **SEGS, **ROLES))

# ---- F on geometry --------------------------------------------------------------------------------------------------

_parts = lambda s, d: S.lines_of(vertices(s, d)).select("line_id", F.array(F.slice("coords", 1, F.when(F.col("line_id") % 2 == 0, 1).otherwise(5)), "coords").alias("parts"))
add("F-16", lambda s, d: L.parts_of(_parts(s, d)).select("line_id", "part", F.size("coords").alias("n")), with_views("SELECT line_id, 1 AS part, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT line_id, 0, 5 FROM v WHERE line_id % 2 = 1 GROUP BY 1", "v_segments", **VQ))
SHAPES = [("Point", "[1.5,2]"), ("LineString", "[[0,0],[1,1]]"), ("MultiLineString", "[[[0,0],[1,1]],[[2,2],[3,3],[4,4]]]"), ("Polygon", "[[[0,0],[1,0],[1,1],[0,0]]]"), ("MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]"), ("Unknown", "[]")]
_shapes = lambda s: s.createDataFrame(SHAPES, "kind string, coordinates string")
add("F-17", lambda s, d: _shapes(s).select("kind", S.flatten_geometry(F.col("kind"), F.col("coordinates")).alias("parts")).select("kind", F.coalesce(F.when(F.col("parts").isNotNull(), F.size("parts")), F.lit(0)).alias("n")), "SELECT * FROM (VALUES ('Point', 1), ('LineString', 1), ('MultiLineString', 2), ('Polygon', 1), ('MultiPolygon', 2), ('Unknown', 0)) t(kind, n)")
add("F-18", lambda s, d: L.parts_of(_parts(s, d).withColumn("natural", F.lit("coastline"))).groupBy("line_id").agg(F.count(F.lit(1)).alias("n_parts")), with_views("SELECT line_id, 1 + max(line_id % 2) AS n_parts FROM v GROUP BY 1", "v_segments", **VQ))

# ---- S: sources. Files are written to the shared folder first and read back. --------------------------------------------


def collection(s, d, name):
    """The fixture's points as one GeoJSON file."""
    feature = S.feature_json(["point_id", "sea_side"], S.point_geometry())
    whole = view(s, d, "v_points").select(feature.alias("f")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    path = shared_path(s, name)
    whole.coalesce(1).write.text(path)
    return path


_prop = lambda df: df.select(F.col("properties")["point_id"].cast("long").alias("point_id"), F.round(F.col("parts")[0][0]["x"], 6).alias("x"), F.round(F.col("parts")[0][0]["y"], 6).alias("y"))
PTS = "SELECT point_id, round(lon, 6) AS x, round(lat, 6) AS y FROM v_points"
add("S-01", lambda s, d: _prop(S.read_coastline(s, collection(s, d, "s01"), None)), with_views(PTS, "v_points"))
add("S-02", lambda s, d: _prop(S.read_geojson_any_encoding(s, collection(s, d, "s02"))), with_views(PTS, "v_points"))
add("S-03", lambda s, d: _prop(S.extract_box(S.read_geojson(s, collection(s, d, "s03")), 37.0, 43.5, 38.5, 45.0)), with_views(PTS + " WHERE lon BETWEEN 37.0 AND 38.5 AND lat BETWEEN 43.5 AND 45.0", "v_points"))


def _overpass(s, d):
    nodes = view(s, d, "v_segments").select(F.to_json(F.struct(F.lit("node").alias("type"), F.col("seg_id").alias("id"), F.col("y0").alias("lat"), F.col("x0").alias("lon"))).alias("j"))
    ways = view(s, d, "v_segments").select(F.to_json(F.struct(F.lit("way").alias("type"), F.col("seg_id").alias("id"), F.array("seg_id", F.col("seg_id") + 1, F.col("seg_id") + 1000000).alias("nodes"))).alias("j"))
    return nodes.unionByName(ways).agg(F.concat(F.lit('{"elements":['), F.array_join(F.collect_list("j"), ","), F.lit("]}")).alias("payload"))


add("S-04", lambda s, d: S.parse_overpass(_overpass(s, d)).select("way_id", F.size("coords").alias("n")), with_views("SELECT a.seg_id AS way_id, 2 AS n FROM v_segments a JOIN v_segments b ON b.seg_id = a.seg_id + 1 ", "v_segments"))


def _ways(s, d):
    v = view(s, d, "v_segments")
    ways = v.select(F.col("seg_id").alias("way_id"), F.when(F.col("seg_id") % 2 == 0, F.array("seg_id", F.col("seg_id") + 1)).otherwise(F.array("seg_id", F.lit(-1), F.col("seg_id") + 1)).alias("node_ids"))
    return S.ways_to_lines(ways, v.select(F.col("seg_id").alias("node_id"), F.col("x0").alias("lon"), F.col("y0").alias("lat")), whole_only=True).select("way_id", F.size("coords").alias("n"))


add("S-05", _ways, with_views("SELECT a.seg_id AS way_id, 2 AS n FROM v_segments a JOIN v_segments b ON b.seg_id = a.seg_id + 1 WHERE a.seg_id % 2 = 0", "v_segments"))
add("S-06", lambda s, d: L.clip_segments(view(s, d, "v_segments"), *BOX).where("t1 > t0").agg(F.count(F.lit(1)).alias("n")), with_views("SELECT count(*) AS n FROM inside WHERE t1 > t0", "v_segments", **CLIP))
_batches = lambda s, d: view(s, d, "v_points").withColumns({"lat": F.col("lat") + 1e-5, "lon": F.col("lon") + 1e-5}).withColumn("batch", F.floor(F.col("point_id") / 25).cast("int"))
add("S-07", lambda s, d: S.archive_parameters(_batches(s, d), "2024-01-01", "2024-01-31"), with_views("SELECT CAST(floor(point_id / 25) AS INTEGER) AS batch, string_agg(printf('%.3f', lat + 1e-5), ',' ORDER BY point_id) AS latitude, string_agg(printf('%.3f', lon + 1e-5), ',' ORDER BY point_id) AS longitude, '2024-01-01' AS start_date, '2024-01-31' AS end_date FROM v_points GROUP BY 1", "v_points"))


def _archive(s, d):
    daily_rows = view(s, d, "v_wind").groupBy("point_id", "date").agg(F.max("ws_kmh").alias("ws"), F.min("direction").cast("double").alias("wd"))
    held = daily_rows.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("date", "ws", "wd"))).alias("a"))
    body = F.struct(F.lit(43.0).alias("latitude"), F.struct(F.transform("a", lambda x: x["date"].cast("string")).alias("time"), F.transform("a", lambda x: x["ws"]).alias("wind_speed_10m_max"), F.transform("a", lambda x: x["wd"]).alias("wind_direction_10m_dominant")).alias("daily"))
    return held.select("point_id", F.to_json(body).alias("payload"))


def _backfilled(s, d):
    """Payloads land in three deliveries, the third of which is the first again; the series are read from the stream's state."""
    folder, sent = shared_path(s, "s08"), F.lit("2024-03-01 00:00:00").cast("timestamp")
    payloads = _archive(s, d).withColumn("sent", sent).withColumn("path_seq", F.lit(1).cast("long"))
    for name, rows in (("1", payloads.where("point_id % 2 = 0")), ("2", payloads.where("point_id % 2 = 1")), ("3", payloads.where("point_id % 2 = 0"))):
        rows.write.parquet(f"{folder}/landed/delivery={name}")
    landed = s.readStream.schema(payloads.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/landed/*")
    parsed = S.parse_archive(landed, keep=("sent", "path_seq")).withColumnRenamed("date", "obs_date")
    store = SeriesStore(s, f"{folder}/state", StructType.fromDDL("point_id bigint, obs_date date, ws double, wd double, path_seq bigint"))
    query = backfill(parsed, store, f"{folder}/checkpoint")
    query.awaitTermination()
    store.compact()
    return store.series().select("point_id", F.col("obs_date").alias("date"), "ws", "wd")


add("S-08", _backfilled, with_views("SELECT point_id, date, max(ws_kmh) AS ws, CAST(min(direction) AS DOUBLE) AS wd FROM v_wind GROUP BY 1, 2", "v_wind"))
add("S-09", lambda s, d: view(s, d, "v_cached").agg(F.greatest(F.min("obs_date"), F.lit("1940-01-01").cast("date")).alias("date_start"), F.least(F.max("obs_date"), F.lit("2024-01-24").cast("date")).alias("date_end")), with_views("SELECT greatest(min(obs_date), DATE '1940-01-01') AS date_start, least(max(obs_date), DATE '2024-01-24') AS date_end FROM v_cached", "v_cached"))


def _raster(s, d):
    rows = S.north_up(view(s, d, "v_grid").withColumn("z", F.when(F.col("ix") != 3, F.col("z"))))
    return S.raster_rows(rows, 36.5, 42.9, 39.0, 45.4).select("iy", "ix", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "z")


GRID_SQL = "SELECT iy, ix, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN ix <> 3 THEN z END AS z FROM v_grid"
for name in ("S-10", "S-11"):
    add(name, _raster, with_views(GRID_SQL, "v_grid"))


def _grid_file(s, d, name):
    path = shared_path(s, name)
    view(s, d, "v_grid").write.parquet(path)
    return S.read_grid(s, path, 37.0, 43.0, 38.0, 44.0).select("ix", "iy", "z")


for name in ("S-12", "S-13", "S-14"):
    add(name, lambda s, d, n=name: _grid_file(s, d, n), with_views("SELECT ix, iy, z FROM v_grid WHERE lon BETWEEN 37.0 AND 38.0 AND lat BETWEEN 43.0 AND 44.0", "v_grid"))


def _csv(s, d):
    path = shared_path(s, "s16")
    view(s, d, "v_trace").write.option("header", "true").csv(path)
    return S.read_csv(s, path, "point_id long, direction int, fetch_m double")


add("S-16", _csv, with_views("SELECT * FROM v_trace", "v_trace"))
add("S-17", lambda s, d: _prop(S.read_geojson(s, collection(s, d, "s17"))).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("point_id").isNull()).alias("n_null")), with_views("SELECT count(*) AS n, 0 AS n_null FROM v_points", "v_points"))
add("S-18", lambda s, d: S.read_geojson(s, collection(s, d, "s18")).groupBy("geometry_type").count(), with_views("SELECT 'Point' AS geometry_type, count(*) AS count FROM v_points", "v_points"))

# ---- K: sinks, written and read back ------------------------------------------------------------------------------------


def _round_trip(df, name, properties, geometry, by=None):
    path = shared_path(df.sparkSession, name)
    S.write_geojson_lines(df, path, properties, geometry, by)
    return S.read_geojson_lines(df.sparkSession, path)


_pts = lambda s, d, name: _prop(_round_trip(view(s, d, "v_points"), name, ["point_id", "sea_side"], S.point_geometry()))
for name in ("K-01", "K-04", "K-05"):
    add(name, lambda s, d, n=name: _pts(s, d, n), with_views(PTS, "v_points"))
_lines = lambda s, d: S.lines_of(vertices(s, d)).join(L.tag_main(vertices(s, d)), "line_id")
_line_counts = lambda df: df.select(F.col("properties")["line_id"].cast("long").alias("line_id"), F.col("properties")["coastline_role"].alias("role"), F.size(F.col("parts")[0]).alias("n"))
LINES = with_views("SELECT c.line_id, CASE WHEN c.line_id = (SELECT arg_max(line_id, row(length_m, -line_id)) FROM len) THEN 'main' ELSE 'other' END AS role, n FROM (SELECT line_id, count(*) AS n FROM v GROUP BY 1) c", "v_segments", **VQ, **SEGS, **ROLES)
for name, by in (("K-02", "coastline_role"), ("K-03", None), ("K-16", None)):
    add(name, lambda s, d, n=name, b=by: _line_counts(_round_trip(_lines(s, d).withColumn("role", F.col("coastline_role")), n, ["line_id", "coastline_role"], S.line_geometry(), "role" if b else None)), LINES)


def _weather_files(s, d):
    path = shared_path(s, "k06")
    view(s, d, "v_wind").repartition(3, "point_id").write.parquet(path)
    return S.manifest(s.read.parquet(path)).agg(F.sum("n").alias("n"))


add("K-06", _weather_files, with_views("SELECT CAST(count(*) AS BIGINT) AS n FROM v_wind", "v_wind"))


def _partitioned(df, name, by):
    return _split(df.repartition(by), name, by)


def _split(df, name, by):
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


add("K-07", lambda s, d: _partitioned(view(s, d, "v_wind"), "k07", "point_id").select(F.col("point_id").cast("long").alias("point_id"), "date", "ws_kmh"), with_views("SELECT point_id, date, ws_kmh FROM v_wind", "v_wind"))
_FETCH = "SELECT point_id, azimuth_deg, round(fetch_length_m, 3) AS fetch_length_m, hit_found FROM traced"
add("K-08", lambda s, d: _split(G.split_by_direction(traced(s, d)), "k08", "azimuth_deg").select("point_id", F.col("azimuth_deg").cast("double").alias("azimuth_deg"), F.round("fetch_length_m", 3).alias("fetch_length_m"), "hit_found"), with_views(_FETCH, *GV, **GQ))
add("K-09", lambda s, d: S.read_csv(s, _saved_csv(s, G.trace_fetch(*views(s, d, *GV), [90.0]).select("point_id", "azimuth_deg", F.round("fetch_length_m", 3).alias("fetch_length_m"), "hit_found"), "k09"), "point_id long, azimuth_deg double, fetch_length_m double, hit_found boolean"), with_views(_FETCH + " WHERE azimuth_deg = 90", *GV, **GQ))


def _saved_csv(s, df, name):
    path = shared_path(s, name) + ".csv"
    S.save(df, path, [], F.lit(None))
    return path


add("K-10", lambda s, d: S.north_up(view(s, d, "v_grid")).select("row", F.size("z").alias("n"), F.col("z")[0].alias("first")), with_views("SELECT 20 - iy AS row, 21 AS n, z AS first FROM v_grid WHERE ix = 0", "v_grid"))
add("K-12", lambda s, d: S.profile_csv_rows(view(s, d, "v_points").select((F.col("chainage_m") / 3).alias("distance_m"), F.col("x").alias("z"), "lat", "lon")), with_views("SELECT printf('%.6f', chainage_m / 3) AS distance_m, printf('%.6f', x) AS z, printf('%.6f', lat) AS lat, printf('%.6f', lon) AS lon FROM v_points", "v_points"))


def _daily_file(s, d):
    path = shared_path(s, "k13")
    daily(s, d).write.parquet(path)
    return s.read.parquet(path).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


add("K-13", _daily_file, with_views("SELECT w.point_id, count(*) AS n FROM v_wind w WHERE ws_kmh >= 0.1 AND point_id IN (SELECT point_id FROM v_trace) AND point_id IN (SELECT point_id FROM v_points) GROUP BY 1", "v_wind", "v_trace", "v_points"))
add("K-14", lambda s, d: _prop(_round_trip(X.exposure_index(daily(s, d)).join(view(s, d, "v_points").select("point_id", "lon", "lat"), "point_id"), "k14", ["point_id", "WER"], S.point_geometry())), with_views(PTS + " WHERE point_id IN (SELECT point_id FROM v_wind WHERE ws_kmh >= 0.1) AND point_id IN (SELECT point_id FROM v_trace)", "v_points", "v_wind", "v_trace"))
add("K-15", lambda s, d: s.createDataFrame([(3.0,), (12.5,), (100.0,), (0.25,)], "tolerance double").select("tolerance", S.tolerance_label("tolerance").alias("label")), "SELECT * FROM (VALUES (3.0::DOUBLE, '3m'), (12.5, '12p5m'), (100.0, '100m'), (0.25, '0p25m')) t(tolerance, label)")
add("K-17", lambda s, d: B.grid_summary(view(s, d, "v_grid")).select("west", "east", "south", "north", F.greatest(F.abs("z_min"), F.abs("z_max")).alias("limit")), with_views("SELECT min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north, max(abs(z)) AS \"limit\" FROM v_grid", "v_grid"))
add("K-18", lambda s, d: s.createDataFrame([(json.dumps({"rotation": "10 MB", "retention": "10 days", "compression": "zip"}),)], "settings string").select(F.get_json_object("settings", "$.rotation").alias("rotation"), F.get_json_object("settings", "$.retention").alias("retention"), F.get_json_object("settings", "$.compression").alias("compression")), "SELECT '10 MB' AS rotation, '10 days' AS retention, 'zip' AS compression")
