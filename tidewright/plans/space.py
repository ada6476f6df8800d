"""Queries of weather (T), fetch tracing (G) and depths (B)."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import geodesy
from ..operators import bathymetry as B
from ..operators import fetch as G
from ..operators import normalise as N
from ..operators import weather as T
from .fixtures import Registry, pmod, view, views, with_views

registry = Registry()
add = registry.add

# ---- T: weather ---------------------------------------------------------------------------------------------------

AXIS = "CAST(ceil(({a} - 0.125 - 0.25 - 0.125) / 0.25) AS INTEGER), CAST(floor(({b} + 0.125 + 0.25 - 0.125) / 0.25) AS INTEGER) + 1"
add("T-01", lambda s, d: view(s, d, "v_points").agg(F.min("lat").alias("a"), F.max("lat").alias("b")).select(F.explode(T.axis_centers("a", "b")).alias("lat")), with_views(f"SELECT round(0.125::DOUBLE + 0.25 * unnest(range({AXIS.format(a='min(lat)', b='max(lat)')})), 6) AS lat FROM v_points", "v_points"))
_rings = "CASE WHEN {i} = 0 THEN -1 WHEN {i} = {n} - 1 THEN 1 ELSE 0 END"
add("T-02", lambda s, d: T.weather_grid(view(s, d, "v_points")), with_views(
    f"""SELECT iy * nx + ix + 1 AS point_id, lat, lon, {_rings.format(i='iy', n='ny')} AS ring_y, {_rings.format(i='ix', n='nx')} AS ring_x FROM
        (SELECT *, row_number() OVER (ORDER BY lat) - 1 AS iy, count(*) OVER () AS ny FROM ys), (SELECT *, row_number() OVER (ORDER BY lon) - 1 AS ix, count(*) OVER () AS nx FROM xs)""", "v_points",
    ys=f"SELECT round(0.125::DOUBLE + 0.25 * unnest(range({AXIS.format(a='min(lat)', b='max(lat)')})), 6) AS lat FROM v_points", xs=f"SELECT round(0.125::DOUBLE + 0.25 * unnest(range({AXIS.format(a='min(lon)', b='max(lon)')})), 6) AS lon FROM v_points"))
EXT = "SELECT floor(min(lat) / 0.25) * 0.25 - 0.25 AS s, ceil(max(lat) / 0.25) * 0.25 + 0.25 AS n, floor(min(lon) / 0.25) * 0.25 - 0.25 AS w, ceil(max(lon) / 0.25) * 0.25 + 0.25 AS e FROM v_points"
add("T-03", lambda s, d: T.grid_lines(view(s, d, "v_points")), with_views("SELECT 'parallel' AS kind, round(s + 0.25 * unnest(range(0, CAST(round((n - s) / 0.25) AS INTEGER) + 1)), 6) AS at, w AS start, e AS \"end\" FROM ext UNION ALL SELECT 'meridian', round(w + 0.25 * unnest(range(0, CAST(round((e - w) / 0.25) AS INTEGER) + 1)), 6), s, n FROM ext", "v_points", ext=EXT))


def _clamped(s, d):
    r = view(s, d, "v_cached").groupBy("point_id").agg(F.date_sub(F.min("obs_date"), 30000).alias("a"), F.max("obs_date").alias("b"))
    start, end, ok = T.clamp_range(F.col("a"), F.col("b"), F.lit("1997-06-30").cast("date"))
    return r.select("point_id", start.alias("start_date"), end.alias("end_date"), ok.alias("is_valid"))


add("T-04", _clamped, with_views("SELECT point_id, greatest(CAST(min(obs_date) - 30000 AS DATE), DATE '1940-01-01') AS start_date, least(max(obs_date), DATE '1997-06-23') AS end_date, greatest(CAST(min(obs_date) - 30000 AS DATE), DATE '1940-01-01') <= least(max(obs_date), DATE '1997-06-23') AS is_valid FROM v_cached GROUP BY 1", "v_cached"))
GAPS = """SELECT point_id, min(obs_date) AS start_date, max(obs_date) AS end_date FROM (SELECT *, obs_date - CAST(row_number() OVER (PARTITION BY point_id ORDER BY obs_date) AS INTEGER) AS island FROM
          (SELECT p.point_id, CAST(c.x AS DATE) AS obs_date FROM (SELECT DISTINCT point_id FROM v_cached) p, generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY) c(x) EXCEPT SELECT point_id, obs_date FROM v_cached)) GROUP BY point_id, island"""
_gaps = lambda s, d: T.missing_ranges(view(s, d, "v_cached"), view(s, d, "v_cached"), "1992-01-01", "1998-12-31")
add("T-05", _gaps, with_views(GAPS, "v_cached"))
add("T-06", lambda s, d: T.merge_segments(view(s, d, "v_segments_cache").where("obs_date between '1992-01-01' and '1998-12-31'"), "1992-01-01", "1998-12-31"), with_views(
    """SELECT p.point_id, CAST(c.x AS DATE) AS obs_date, value, l.point_id IS NULL AS is_missing FROM (SELECT DISTINCT point_id FROM v_segments_cache WHERE obs_date BETWEEN '1992-01-01' AND '1998-12-31') p CROSS JOIN generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY) c(x)
       LEFT JOIN (SELECT point_id, obs_date, arg_max(value, path_seq) AS value FROM v_segments_cache GROUP BY 1, 2) l ON l.point_id = p.point_id AND l.obs_date = c.x""", "v_segments_cache"))
add("T-07", lambda s, d: T.download_tasks(_gaps(s, d), 3), with_views("SELECT start_date, end_date, batch, list_sort(list(point_id)) AS points FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY start_date, end_date ORDER BY point_id) - 1) / 3) AS INTEGER) AS batch FROM gaps) GROUP BY ALL", "v_cached", gaps=GAPS))
add("T-08", lambda s, d: view(s, d, "v_points").select("point_id", T.variables_key(F.array(F.concat(F.lit("v"), F.col("point_id").cast("string")), F.lit("a"))).alias("key")), with_views("SELECT point_id, substr(sha256('a|v' || point_id), 1, 12) AS key FROM v_points", "v_points"))
NEAREST = "SELECT * FROM (SELECT point_id, grid_id, sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS distance_m, row_number() OVER (PARTITION BY point_id ORDER BY sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)), grid_id) AS rank FROM v_points p, v_grid_nodes g) WHERE rank <= 4"
PN = ("v_points", "v_grid_nodes", "v_grid_series")
add("T-09", lambda s, d: T.assign_nearest(*views(s, d, *PN)).withColumns({"weather_distance_m": F.round("weather_distance_m", 5), "ws": F.round("ws", 9)}), with_views("SELECT point_id, n.grid_id AS source_grid_point_id, round(distance_m, 5) AS weather_distance_m, date, round(ws, 9) AS ws, wd FROM nearest n JOIN v_grid_series s ON s.grid_id = n.grid_id WHERE rank = 1", *PN, nearest=NEAREST))
IDW = f"""SELECT point_id, date, CASE WHEN count(ws) = 4 THEN sum(ws / (distance_m * distance_m)) / sum(1 / (distance_m * distance_m)) END AS ws,
    CASE WHEN count(ws) = 4 THEN {pmod('degrees(atan2(sum(sin(radians(wd)) / (distance_m * distance_m)), sum(cos(radians(wd)) / (distance_m * distance_m))))', 360)} END AS wd, count(*) AS neighbours
    FROM (SELECT point_id, date, grid_id, greatest(distance_m, 1e-9) AS distance_m, ws, wd, min(distance_m) OVER (PARTITION BY point_id) AS closest FROM nearest n JOIN v_grid_series s USING (grid_id)) WHERE closest > 1e-9 GROUP BY 1, 2
    UNION ALL SELECT point_id, date, ws, wd, 1 FROM nearest n JOIN v_grid_series s USING (grid_id) WHERE rank = 1 AND distance_m <= 1e-9"""
_round_w = lambda df: df.withColumns({"ws": F.round("ws", 9), "wd": F.round("wd", 6)})
add("T-10", lambda s, d: _round_w(T.assign_idw(*views(s, d, *PN))), with_views("SELECT point_id, date, round(ws, 9) AS ws, round(wd, 6) AS wd, neighbours FROM idw", *PN, nearest=NEAREST, idw=IDW))
add("T-11", lambda s, d: _round_w(T.assign_weather(*views(s, d, *PN)).unionByName(T.assign_weather(*views(s, d, *PN), strategy="nearest"))), with_views("SELECT point_id, date, round(ws, 9) AS ws, round(wd, 6) AS wd, 'idw' AS weather_strategy FROM idw UNION ALL SELECT point_id, date, round(ws, 9), round(wd, 6), 'nearest' FROM nearest JOIN v_grid_series USING (grid_id) WHERE rank = 1", *PN, nearest=NEAREST, idw=IDW))
add("T-12", lambda s, d: view(s, d, "v_wide").agg(F.count(F.lit(1)).alias("points"), F.countDistinct(F.size("dates")).alias("lengths"), F.max(F.size("dates")).alias("records"), F.min(F.size("dates") == F.size("wind_speed")).alias("is_equal")), with_views("SELECT count(*) AS points, count(DISTINCT len(dates)) AS lengths, max(len(dates)) AS records, bool_and(len(dates) = len(wind_speed)) AS is_equal FROM v_wide", "v_wide"))
add("T-13", lambda s, d: T.weather_summary(T.assign_weather(*views(s, d, *PN), strategy="nearest")).withColumns({"mean_speed": F.round("mean_speed", 6), "max_speed": F.round("max_speed", 6)}), with_views("SELECT point_id, count(*) AS n_records, round(avg(ws), 6) AS mean_speed, round(max(ws), 6) AS max_speed FROM nearest JOIN v_grid_series USING (grid_id) WHERE rank = 1 GROUP BY 1", *PN, nearest=NEAREST))
add("T-14", lambda s, d: N.wide_to_long(view(s, d, "v_wide"), ["point_id"], {"dates": "date", "wind_speed": "ws"}).groupBy("date").agg(F.count("ws").alias("n"), F.round(F.sum("ws"), 4).alias("total")), with_views("SELECT date, count(ws) AS n, round(sum(ws), 4) AS total FROM (SELECT unnest(dates) AS date, unnest(wind_speed) AS ws FROM v_wide) GROUP BY 1", "v_wide"))
add("T-15", lambda s, d: T.wide_series(T.assign_weather(*views(s, d, *PN), strategy="nearest")).select("point_id", F.size("dates").alias("n"), F.element_at("dates", 1).alias("first"), F.round(F.element_at("wind_speed", -1), 6).alias("last_ws")), with_views("SELECT point_id, count(*) AS n, CAST(min(date) AS VARCHAR) AS first, round(arg_max(ws, date), 6) AS last_ws FROM nearest JOIN v_grid_series USING (grid_id) WHERE rank = 1 GROUP BY 1", *PN, nearest=NEAREST))
add("T-16", lambda s, d: view(s, d, "v_uv").select("id", *[F.round(c, 6).alias(n) for n, c in zip(("speed", "direction"), T.uv_to_wind("u", "v"), strict=True)]), with_views(f"SELECT id, round(sqrt(u * u + v * v), 6) AS speed, round({pmod('270 - degrees(atan2(v, u))', 360)}, 6) AS direction FROM v_uv", "v_uv"))

# ---- G: fetch -----------------------------------------------------------------------------------------------------

AZ = list(range(360))
RAYS = "SELECT p.*, CAST(a AS DOUBLE) AS azimuth_deg, CAST(a AS INTEGER) + 1 AS direction_id, x + 10 * sin(radians(normal_azimuth_deg)) AS start_x, y + 10 * cos(radians(normal_azimuth_deg)) AS start_y FROM v_points p, range(360) r(a)"
TURN = pmod("azimuth_deg - normal_azimuth_deg", 360)
SEA = f"SELECT *, round((start_x + 100000 * sin(radians(azimuth_deg))) / 0.05) * 0.05 AS end_x, round((start_y + 100000 * cos(radians(azimuth_deg))) / 0.05) * 0.05 AS end_y FROM rays WHERE NOT ({TURN} >= 90 AND {TURN} < 270)"
HITS = """SELECT point_id, direction_id, x, y, start_x, start_y, start_x + t * rx AS hit_x, start_y + t * ry AS hit_y FROM (
    SELECT *, (qx * sy - qy * sx) / cr AS t, (qx * ry - qy * rx) / cr AS u FROM (SELECT *, rx * sy - ry * sx AS cr FROM (
      SELECT r.*, r.end_x - r.start_x AS rx, r.end_y - r.start_y AS ry, s.x1 - s.x0 AS sx, s.y1 - s.y0 AS sy, s.x0 - r.start_x AS qx, s.y0 - r.start_y AS qy FROM sea r, v_segments s
      WHERE s.x0 <= greatest(r.start_x, r.end_x) AND s.x1 >= least(r.start_x, r.end_x) AND s.y0 <= greatest(r.start_y, r.end_y) AND s.y1 >= least(r.start_y, r.end_y))) WHERE abs(cr) >= 1e-9)
    WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1"""
FIRST = "SELECT point_id, direction_id, min(sqrt(pow(hit_x - start_x, 2) + pow(hit_y - start_y, 2))) AS d, arg_min(row(hit_x, hit_y), sqrt(pow(hit_x - start_x, 2) + pow(hit_y - start_y, 2))) AS h FROM hits WHERE sqrt(pow(hit_x - start_x, 2) + pow(hit_y - start_y, 2)) > 1 AND sqrt(pow(hit_x - x, 2) + pow(hit_y - y, 2)) > 1 GROUP BY 1, 2"
TRACED = f"""SELECT r.point_id, r.direction_id, normal_azimuth_deg, azimuth_deg, x, y, start_x, start_y, CASE WHEN {TURN} >= 90 AND {TURN} < 270 THEN 10 ELSE coalesce(d, 100000) END::DOUBLE AS fetch_length_m, d IS NOT NULL AS hit_found, h[1] AS hit_x, h[2] AS hit_y,
    d IS NULL AS used_default_value, {TURN} >= 90 AND {TURN} < 270 AS skipped_by_land_sector FROM rays r LEFT JOIN first_hit f ON f.point_id = r.point_id AND f.direction_id = r.direction_id"""
GV = ("v_points", "v_segments")
GQ = {"rays": RAYS, "sea": SEA, "hits": HITS, "first_hit": FIRST, "traced": TRACED}
_COORDS = ("x", "y", "start_x", "start_y", "hit_x", "hit_y", "end_x", "end_y", "fetch_length_m")


def _r(df, n=3):
    return df.withColumns({c: F.round(c, n) for c in _COORDS if c in df.columns})


def _sql_r(names, n=3):
    return ", ".join(f"round({c}, {n}) + 0 AS {c}" if c in _COORDS else c for c in names)  # + 0: no negative zero


def traced(s, d):
    return G.trace_fetch(*views(s, d, *GV), AZ)


_rays = lambda s, d: G.point_azimuths(G.shifted_starts(view(s, d, "v_points")), AZ)
add("G-01", lambda s, d: G.point_azimuths(view(s, d, "v_points").select("point_id"), AZ), with_views("SELECT point_id, azimuth_deg, direction_id FROM rays", "v_points", rays=RAYS))
add("G-02", lambda s, d: _r(G.shifted_starts(view(s, d, "v_points"))).select("point_id", "start_x", "start_y"), with_views("SELECT DISTINCT point_id, round(start_x, 3) + 0 AS start_x, round(start_y, 3) + 0 AS start_y FROM rays", "v_points", rays=RAYS))
add("G-03", lambda s, d: G.long_frame(G.land_fetch(view(s, d, "v_points"), AZ)).select("point_id", "direction_id", "fetch_length_m", "hit_found", "used_default_value"), with_views("SELECT point_id, direction_id, fetch_length_m, hit_found, used_default_value FROM traced WHERE skipped_by_land_sector", *GV, **GQ))
add("G-04", lambda s, d: _r(G.ray_ends(G.split_land_sector(_rays(s, d))[0]), 2).select("point_id", "direction_id", "end_x", "end_y"), with_views("SELECT point_id, direction_id, round(end_x, 2) AS end_x, round(end_y, 2) AS end_y FROM sea", "v_points", rays=RAYS, sea=SEA))
CELLS = "SELECT seg_id, cx, unnest(range(CAST(floor(least(y0, y1) / 5000) AS BIGINT), CAST(floor(greatest(y0, y1) / 5000) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(floor(least(x0, x1) / 5000) AS BIGINT), CAST(floor(greatest(x0, x1) / 5000) AS BIGINT) + 1)) AS cx FROM v_segments)"
add("G-05", lambda s, d: G.segment_cells(view(s, d, "v_segments"), 5000.0).select("seg_id", "cx", "cy"), with_views("SELECT * FROM cells", "v_segments", cells=CELLS))
add("G-06", lambda s, d: G.fan_hits(*views(s, d, *GV)), with_views("SELECT DISTINCT point_id, direction_id, round(hit_x, 3) + 0 AS hit_x, round(hit_y, 3) + 0 AS hit_y FROM hits", *GV, rays=RAYS, sea=SEA, hits=HITS))
add("G-07", lambda s, d: _r(traced(s, d)).where("not skipped_by_land_sector").select("point_id", "direction_id", "fetch_length_m", "hit_found", "used_default_value"), with_views("SELECT point_id, direction_id, round(fetch_length_m, 3) AS fetch_length_m, hit_found, used_default_value FROM traced WHERE NOT skipped_by_land_sector", *GV, **GQ))


def _coast(s, d):
    """The segments in degrees, by the formula of v_points."""
    degrees = {f"{c}{k}": F.lit(o) + F.col(f"{c}{k}") / m for c, o, m in (("x", 36.6, 41666.0), ("y", 43.0, 50000.0)) for k in (0, 1)}
    return view(s, d, "v_segments").select(*[v.alias(k) for k, v in degrees.items()])


add("G-08", lambda s, d: G.geodesic_fetch(view(s, d, "v_points"), _coast(s, d), list(range(0, 360, 45))))
add("G-09", lambda s, d: G.geodesic_fetch(view(s, d, "v_points"), _coast(s, d), [90.0], land_sector=False))
add("G-10", lambda s, d: G.geodesic_fetch(view(s, d, "v_points").repartition(4, "point_id"), _coast(s, d), list(range(0, 360, 90))))


def _direct(s, d):
    p = view(s, d, "v_points")
    lon, lat = geodesy.geodesic_destination("lon", "lat", "normal_azimuth_deg", 20_000.0)
    return p.select("point_id", F.round(lon, 9).alias("lon2"), F.round(lat, 9).alias("lat2"))


add("G-11", _direct)
_offsets = lambda rays: _r(G.offset_segments(rays)).join(G.source_points(rays).select("point_id"), "point_id")
add("G-12", lambda s, d: _r(G.ray_layer(traced(s, d))).select("point_id", "direction_id", "end_x", "end_y"), with_views("SELECT point_id, direction_id, round(coalesce(hit_x, start_x + fetch_length_m * sin(radians(azimuth_deg))), 3) AS end_x, round(coalesce(hit_y, start_y + fetch_length_m * cos(radians(azimuth_deg))), 3) AS end_y FROM traced", *GV, **GQ))
add("G-13", lambda s, d: _r(G.long_frame(traced(s, d))), with_views(f"SELECT {_sql_r(G.LONG)} FROM traced", *GV, **GQ))
add("G-14", lambda s, d: G.fetch_by_point(*views(s, d, *GV), AZ, digits=3).select("point_id", F.size(N.number_list("fetch_lengths_m")).alias("n"), F.round(F.aggregate(N.number_list("fetch_lengths_m"), F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.round(N.number_list("azimuths_deg")[5], 3).alias("sixth"), F.size(F.filter(N.number_list("hit_xs"), lambda x: x.isNotNull())).alias("hits")),
    with_views("SELECT point_id, count(*) AS n, round(sum(round(fetch_length_m, 3)), 2) AS total, 5.0::DOUBLE AS sixth, count(hit_x) AS hits FROM traced GROUP BY 1", *GV, **GQ))
add("G-15", lambda s, d: _offsets(traced(s, d)), with_views("SELECT DISTINCT point_id, round(x, 3) AS x, round(y, 3) AS y, round(start_x, 3) + 0 AS start_x, round(start_y, 3) + 0 AS start_y FROM traced", *GV, **GQ))
add("G-16", lambda s, d: _r(G.hit_points(traced(s, d))).select("point_id", "direction_id", "hit_x", "hit_y"), with_views("SELECT point_id, direction_id, round(hit_x, 3) + 0 AS hit_x, round(hit_y, 3) + 0 AS hit_y FROM traced WHERE hit_found", *GV, **GQ))
add("G-17", lambda s, d: _r(G.ray_layer(traced(s, d))), with_views("SELECT point_id, direction_id, round(start_x, 3) + 0 AS start_x, round(start_y, 3) + 0 AS start_y, round(coalesce(hit_x, start_x + fetch_length_m * sin(radians(azimuth_deg))), 3) AS end_x, round(coalesce(hit_y, start_y + fetch_length_m * cos(radians(azimuth_deg))), 3) AS end_y FROM traced", *GV, **GQ))
add("G-18", lambda s, d: view(s, d, "v_points").select("point_id", (F.col("point_id").isNotNull() & F.col("normal_azimuth_deg").between(0, 360)).alias("is_valid")), with_views("SELECT point_id, true AS is_valid FROM v_points", "v_points"))


def _there_and_back(s, d):
    p = view(s, d, "v_points").withColumn("zone", geodesy.utm_zone("lon"))
    e, n = geodesy.utm_forward("lon", "lat", F.col("zone"))
    p = p.withColumn("e", e).withColumn("n", n)
    lon, lat = geodesy.utm_inverse("e", "n", F.col("zone"))
    return p.select("point_id", "zone", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


add("G-19", _there_and_back, with_views("SELECT point_id, CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS zone, round(lon, 7) AS lon, round(lat, 7) AS lat FROM v_points", "v_points"))
add("G-20", lambda s, d: G.long_frame(G.trace_fetch(*views(s, d, *GV), [0.0, 90.0], offset_m=0.1)).groupBy("azimuth_deg").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit_found").alias("hits")), with_views(
    "SELECT azimuth_deg, count(*) AS n, count(*) FILTER (hit_found) AS hits FROM traced WHERE azimuth_deg IN (0, 90) GROUP BY 1", *GV, **(GQ | {"rays": RAYS.replace("10 * sin", "0.1 * sin").replace("10 * cos", "0.1 * cos")})))

# ---- B: depths ----------------------------------------------------------------------------------------------------

GRID = {"west": 36.5, "south": 42.9, "step": 0.125, "nx": 21, "ny": 21}
BILINEAR = """SELECT p.point_id, CASE WHEN fx < 0 OR fx > 20 OR fy < 0 OR fy > 20 THEN NULL ELSE (1 - tx) * (1 - ty) * a.z + tx * (1 - ty) * b.z + (1 - tx) * ty * c.z + tx * ty * e.z END AS z, fx < 0 OR fx > 20 OR fy < 0 OR fy > 20 AS outside
    FROM (SELECT *, fx - ix AS tx, fy - iy AS ty FROM (SELECT *, least(floor(fx), 19) AS ix, least(floor(fy), 19) AS iy FROM (SELECT point_id, (lon - 36.5) / 0.125 AS fx, (lat - 42.9) / 0.125 AS fy FROM {p}))) p
    LEFT JOIN v_grid a ON a.ix = p.ix AND a.iy = p.iy LEFT JOIN v_grid b ON b.ix = p.ix + 1 AND b.iy = p.iy LEFT JOIN v_grid c ON c.ix = p.ix AND c.iy = p.iy + 1 LEFT JOIN v_grid e ON e.ix = p.ix + 1 AND e.iy = p.iy + 1"""
add("B-01", lambda s, d: s.createDataFrame([("EMODnet_WCS", 1, False), ("GEBCO_OpenTopography", 2, True)], "source string, priority int, is_cached boolean").where("is_cached").orderBy("priority").limit(1), "SELECT 'GEBCO_OpenTopography' AS source, 2 AS priority, true AS is_cached")
add("B-02", lambda s, d: view(s, d, "v_points").select("point_id", B.box_key(F.col("lat"), F.col("lon"), F.col("lat") + 1, F.col("lon") + 1, F.lit("GEBCO")).alias("key")), with_views("SELECT point_id, sha256(concat_ws('|', printf('%.6f', lat), printf('%.6f', lon), printf('%.6f', lat + 1), printf('%.6f', lon + 1), 'GEBCO')) AS key FROM v_points", "v_points"))
add("B-03", lambda s, d: B.grid_summary(view(s, d, "v_grid")), with_views("SELECT min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north, min(z) AS z_min, max(z) AS z_max, count(z) AS n FROM v_grid", "v_grid"))
_wider = lambda s, d: view(s, d, "v_points").withColumn("lon", F.col("lon") + (F.col("point_id") % 2) * 0.4)
WIDER = "SELECT point_id, lon + (point_id % 2) * 0.4 AS lon, lat FROM v_points"
add("B-04", lambda s, d: B.depth_at(_wider(s, d), view(s, d, "v_grid"), **GRID).withColumn("z", F.round("z", 6)), with_views("SELECT point_id, round(z, 6) AS z, outside FROM bi", "v_points", "v_grid", wider=WIDER, bi=BILINEAR.format(p="wider")))
_profile = lambda s, d, surface="sphere": B.transects(view(s, d, "v_points"), [45.0, 225.0], surface=surface)


def _line_profiles(s, d):
    """Profiles with depths of the lines from each point to its ends on the ellipsoid."""
    p = view(s, d, "v_points").select("point_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.explode(F.array(F.lit(45.0), F.lit(225.0))).alias("direction"))
    lon, lat = geodesy.geodesic_destination("lon0", "lat0", "direction", 20_000.0)
    found = B.line_profiles(p.withColumns({"lon1": lon, "lat1": lat}), view(s, d, "v_grid"), GRID)
    return found.withColumns({"distance_m": F.round("distance_m", 4), "lon": F.round("lon", 9), "lat": F.round("lat", 9), "z": F.round("z", 6)})


add("B-05", _line_profiles)
add("B-06", lambda s, d: B.profile_summary(view(s, d, "v_profile").withColumn("distance_m", F.col("step") * 100.0), ("profile_id",)), with_views("SELECT profile_id, max(step) * 100.0::DOUBLE AS length_m, min(z) AS z_min, max(z) AS z_max, count(*) AS n FROM v_profile GROUP BY 1", "v_profile"))


def _sphere(s, d):
    lon, lat = geodesy.sphere_destination("lon", "lat", "normal_azimuth_deg", 20_000.0)
    return view(s, d, "v_points").select("point_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


SPHERE = "degrees(asin(sin(radians({lat})) * cos(dd) + cos(radians({lat})) * sin(dd) * cos(radians({az}))))"
LAM = "{lon} + degrees(atan2(sin(radians({az})) * sin(dd) * cos(radians({lat})), cos(dd) - sin(radians({lat})) * sin(radians(lat2))))"
_on = {"lat": "lat", "lon": "lon", "az": "normal_azimuth_deg"}
add("B-07", _sphere, with_views(f"SELECT point_id, round({LAM.format(**_on)}, 8) AS lon, round(lat2, 8) AS lat FROM (SELECT *, {SPHERE.format(**_on)} AS lat2 FROM (SELECT *, 20000.0 / 6371000.0 AS dd FROM v_points))", "v_points"))
add("B-08", lambda s, d: _profile(s, d, "ellipsoid").where("step = 199").withColumns({"lon": F.round("lon", 9), "lat": F.round("lat", 9)}))
CLIP = "SELECT point_id, greatest(least(lon, 39.0 - 1e-4), 36.5 + 1e-4) AS lon, greatest(least(lat, 45.4 - 1e-4), 42.9 + 1e-4) AS lat FROM wider"
add("B-09", lambda s, d: B.depth_at(B.clip_into(_wider(s, d), 36.5, 42.9, 39.0, 45.4), view(s, d, "v_grid"), **GRID).withColumn("z", F.round("z", 6)), with_views("SELECT point_id, round(z, 6) AS z, outside FROM bi", "v_points", "v_grid", wider=WIDER, clip=CLIP, bi=BILINEAR.format(p="clip")))
add("B-10", lambda s, d: B.depth_at(_wider(s, d), view(s, d, "v_grid"), **GRID).select("point_id", F.round(B.signed_depth(F.col("z"), "abs"), 6).alias("depth")), with_views("SELECT point_id, round(abs(z), 6) AS depth FROM bi", "v_points", "v_grid", wider=WIDER, bi=BILINEAR.format(p="wider")))
add("B-11", lambda s, d: B.depth_at(view(s, d, "v_points"), view(s, d, "v_grid"), **GRID, method="nearest").select("point_id", B.signed_depth(F.col("z"), "negate_land_null").alias("depth")), with_views("SELECT point_id, CASE WHEN z < 0 THEN -z END AS depth FROM v_points p LEFT JOIN v_grid g ON g.ix = round_even((p.lon - 36.5) / 0.125, 0) AND g.iy = round_even((p.lat - 42.9) / 0.125, 0)", "v_points", "v_grid"))
add("B-12", lambda s, d: view(s, d, "v_grid").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")), with_views("SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM v_grid", "v_grid"))


def _service(s, d):
    """Profiles with depths: out of the grid is null."""
    p = _profile(s, d)
    return B.depth_at(p, view(s, d, "v_grid"), **GRID, keys=("point_id", "direction", "step", "distance_m")).withColumns({"z": F.round("z", 4), "distance_m": F.round("distance_m", 4)})


_at = {"lat": "lat", "lon": "lon", "az": "direction"}
TRANSECT = f"SELECT point_id, direction, step, distance_m, {LAM.format(**_at)} AS lon, lat2 AS lat FROM (SELECT *, {SPHERE.format(**_at)} AS lat2 FROM (SELECT point_id, lon, lat, a::DOUBLE AS direction, i AS step, i * (20000.0::DOUBLE / 199) AS distance_m, i * (20000.0::DOUBLE / 199) / 6371000.0 AS dd FROM v_points, (VALUES (45.0), (225.0)) v(a), range(200) r(i)))"
add("B-13", _service, with_views("SELECT t.point_id, t.direction, CAST(t.step AS INTEGER) AS step, round(t.distance_m, 4) AS distance_m, round(z, 4) AS z, outside FROM transect t JOIN bi ON bi.point_id = t.point_id * 1000000 + CAST(t.direction AS BIGINT) * 1000 + t.step", "v_points", "v_grid", transect=TRANSECT, keyed="SELECT point_id * 1000000 + CAST(direction AS BIGINT) * 1000 + step AS point_id, lon, lat FROM transect", bi=BILINEAR.format(p="keyed")))
add("K-11", lambda s, d: view(s, d, "v_profile").select("profile_id", "step", B.sea_land_split("z")[0].alias("sea"), B.sea_land_split("z")[1].alias("land")), with_views("SELECT profile_id, step, CASE WHEN z < 0 THEN z END AS sea, CASE WHEN z >= 0 THEN z END AS land FROM v_profile", "v_profile"))
add("S-15", lambda s, d: view(s, d, "v_points").select("point_id", B.source_for_box(F.col("lat") - F.col("point_id") % 40, F.col("lon"), F.col("lat"), F.col("lon") + F.col("point_id") % 9).alias("source")), with_views("SELECT point_id, CASE WHEN lat - point_id % 40 >= 15 AND lon >= -36 AND lat <= 90 AND lon + point_id % 9 <= 43 THEN 'EMODnet_WCS' ELSE 'GEBCO_OpenTopography' END AS source FROM v_points", "v_points"))
add("S-19", lambda s, d: view(s, d, "v_points").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")), with_views("SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM v_points", "v_points"))
add("S-20", lambda s, d: T.request_parameters(s, 36.6, 43.0, 39.0, 89.9), "SELECT 42.75::DOUBLE AS south, 36.35::DOUBLE AS west, 90.0::DOUBLE AS north, 39.25::DOUBLE AS east")
