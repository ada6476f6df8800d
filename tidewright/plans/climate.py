"""Queries of normalisation (F), wave physics (W), statistics and index (A), and wind roses (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles, waves
from ..operators import climate as C
from ..operators import exposure as X
from ..operators import normalise as N
from ..operators import rose as R
from ..operators.rasters import Frame
from .fixtures import Registry, pmod, view, views, with_views

registry = Registry()
add = registry.add

# ---- F: normalisation -------------------------------------------------------------------------------------------

TRACE_SQL = "SELECT point_id, CAST({} AS INTEGER) AS direction, max(coalesce(fetch_m, 0)) AS fetch_m FROM t GROUP BY 1, 2"
RAW_TRACE = "SELECT point_id, direction + 359.5::DOUBLE AS azimuth, CASE WHEN direction % 7 = 0 THEN NULL ELSE fetch_m END AS fetch_m FROM v_trace"


def _raw_trace(s, d):
    return view(s, d, "v_trace").select("point_id", (F.col("direction") + 359.5).alias("azimuth"), F.when(F.col("direction") % 7 != 0, F.col("fetch_m")).alias("fetch_length_m"))


add("F-01", lambda s, d: N.normalise_trace(_raw_trace(s, d), ["point_id"], "a"), with_views(TRACE_SQL.format(pmod("round_even(azimuth, 0)", 360)), "v_trace", t=RAW_TRACE))
add("F-02", lambda s, d: N.normalise_trace(_raw_trace(s, d).withColumnRenamed("fetch_length_m", "distance"), ["point_id"], "b"), with_views(TRACE_SQL.format(pmod("round_even(azimuth, 0)", 360)), "v_trace", t=RAW_TRACE))
WIND_SQL = "SELECT point_id, date, coalesce(CASE WHEN direction % 11 = 0 THEN NULL ELSE ws_kmh END, 0) AS ws_kmh, CAST({} AS INTEGER) AS direction FROM v_wind WHERE direction % 13 <> 0"


def _raw_wind(s, d, speed, direction, date):
    w = view(s, d, "v_wind")
    return w.select("point_id", F.col("date").alias(date), F.when(F.col("direction") % 11 != 0, F.col("ws_kmh")).alias(speed), F.when(F.col("direction") % 13 != 0, F.col("direction") + 0.5).alias(direction))


add("F-03", lambda s, d: N.normalise_wind(_raw_wind(s, d, "wind_speed_10m_max", "wind_dir", "dates"), ["point_id"], "a"), with_views(WIND_SQL.format(pmod("round_even(direction + 0.5, 0)", 360)), "v_wind"))
add("F-04", lambda s, d: N.normalise_wind(_raw_wind(s, d, "windspeed10mmax", "wind_direction_10m_dominant", "date"), ["point_id"], "b"), with_views(WIND_SQL.format(pmod("round_even(direction + 0.5, 0)", 360)), "v_wind"))
add("F-05", lambda s, d: N.rename_index_columns(view(s, d, "v_wind").select("point_id", F.col("ws_kmh").alias("cwef"), F.col("direction").alias("wind_dir"))), with_views('SELECT point_id, ws_kmh AS "CWEF_W_m", direction FROM v_wind', "v_wind"))
add("F-06", lambda s, d: view(s, d, "v_points").select("point_id", N.point_number(F.when(F.col("point_id") % 2 == 0, F.format_string("point_%05d", "point_id")).otherwise(F.concat(F.col("point_id").cast("string"), F.lit(".7")))).alias("number")), with_views("SELECT point_id, point_id AS number FROM v_points", "v_points"))
add("F-07", lambda s, d: view(s, d, "v_points").select("point_id", F.size(N.number_list(F.format_string("[%d, null, 2.5]", "point_id"))).alias("n"), N.number_list(F.format_string("[%d, null, 2.5]", "point_id"))[0].alias("first"), F.size(N.number_list(F.lit("nonsense"))).alias("none")), with_views("SELECT point_id, 3 AS n, CAST(point_id AS DOUBLE) AS first, 0 AS none FROM v_points", "v_points"))
add("F-08", lambda s, d: view(s, d, "v_trace").select("point_id", "direction", F.when(F.col("direction") > 100, F.col("fetch_m")).alias("a"), F.lit(-1.0).alias("b")).select("point_id", "direction", N.first_present("a", "b").alias("value")), with_views("SELECT point_id, direction, CASE WHEN direction > 100 THEN fetch_m ELSE -1.0::DOUBLE END AS value FROM v_trace", "v_trace"))
add("F-09", lambda s, d: N.wide_to_long(view(s, d, "v_wide"), ["point_id"], {"dates": "date", "wind_speed": "ws"}).withColumn("ws", F.round("ws", 6)), with_views("SELECT point_id, unnest(dates) AS date, round(unnest(wind_speed), 6) AS ws FROM v_wide", "v_wide"))


def _fetch_wide(s, d):
    t = view(s, d, "v_trace").groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("direction", "fetch_m"))).alias("a"))
    t = t.select("point_id", F.transform("a", lambda x: x["direction"].cast("double") + 360).alias("azimuths_deg"), F.transform("a", lambda x: x["fetch_m"]).alias("fetch_lengths_m"), F.lit(1).alias("seq"))
    return t.unionByName(t.select("point_id", "azimuths_deg", F.transform("fetch_lengths_m", lambda x: F.greatest(x - 2000, F.lit(0.0))).alias("fetch_lengths_m"), F.lit(2).alias("seq")))


add("F-10", lambda s, d: N.fetch_wide_to_long(_fetch_wide(s, d), "seq"), with_views("SELECT point_id, direction, fetch_m - 2000 AS fetch_m FROM v_trace WHERE fetch_m - 2000 > 0.1", "v_trace"))
add("F-11", lambda s, d: N.normalise_weather_grid(view(s, d, "v_wide").withColumn("wd", F.transform("wind_speed", lambda x: x * 1000)).withColumnRenamed("wind_speed", "ws").withColumnRenamed("dates", "date")).select("point_id", F.size("dates").alias("n"), F.round(F.array_max("wind_dir"), 4).alias("wd_max"), F.round(F.array_min("wind_dir"), 4).alias("wd_min")),
    with_views(f"SELECT point_id, len(dates) AS n, round(list_max(list_transform(wind_speed, lambda x: {pmod('x * 1000', 360)})), 4) AS wd_max, round(list_min(list_transform(wind_speed, lambda x: {pmod('x * 1000', 360)})), 4) AS wd_min FROM v_wide", "v_wide"))
add("F-12", lambda s, d: N.drop_calm(view(s, d, "v_wind")), with_views("SELECT * FROM v_wind WHERE ws_kmh >= 0.1", "v_wind"))
add("F-13", lambda s, d: N.valid_pairs(_raw_wind(s, d, "ws", "wd", "date"), "ws", "wd").groupBy("point_id").count(), with_views("SELECT point_id, count(*) AS count FROM v_wind WHERE direction % 11 <> 0 AND direction % 13 <> 0 GROUP BY 1", "v_wind"))
add("F-14", lambda s, d: view(s, d, "v_profile").where(N.valid_depth("z")), with_views("SELECT * FROM v_profile WHERE z > 0", "v_profile"))
add("F-15", lambda s, d: N.between_chainages(view(s, d, "v_points"), 1000.0, 5000.0).select("point_id", "chainage_m"), with_views("SELECT point_id, chainage_m FROM v_points WHERE chainage_m BETWEEN 1000 AND 5000", "v_points"))
add("F-19", lambda s, d: N.land_sector(N.land_sector(view(s, d, "v_points").crossJoin(s.range(0, 360, 15).select(F.col("id").cast("double").alias("azimuth_deg")))).withColumnRenamed("is_land", "half_open"), "closed").select("point_id", "azimuth_deg", "half_open", F.col("is_land").alias("closed")),
    with_views(f"SELECT point_id, CAST(a AS DOUBLE) AS azimuth_deg, {pmod('a - normal_azimuth_deg', 360)} >= 90 AND {pmod('a - normal_azimuth_deg', 360)} < 270 AS half_open, abs({pmod('a - normal_azimuth_deg', 360)} - 180) <= 90 AS closed FROM v_points, range(0, 360, 15) r(a)", "v_points"))
add("F-20", lambda s, d: view(s, d, "v_urls").select("page_id", N.slug("url").alias("slug"), N.slug(F.lit("///")).alias("none")), with_views("SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g'), '_+', '_', 'g'), '_') AS slug, 'unknown' AS none FROM v_urls", "v_urls"))
add("F-21", lambda s, d: view(s, d, "v_trace").groupBy("point_id").agg(F.collect_list((F.col("direction") * 7 - 500).cast("double")).alias("a")).select("point_id", N.distinct_azimuths("a").alias("azimuths")),
    with_views(f"SELECT point_id, list_sort(list(DISTINCT CAST({pmod('direction * 7 - 500', 360)} AS DOUBLE))) AS azimuths FROM v_trace GROUP BY 1", "v_trace"))
add("F-22", lambda s, d: s.createDataFrame([(k, n, i) for k, names in N.WEATHER_ALIASES.items() for i, n in enumerate(names, 1)], "quantity string, alias string, priority int"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', {i})" for k, names in N.WEATHER_ALIASES.items() for i, n in enumerate(names, 1)) + ") t(quantity, alias, priority)")
add("F-23", lambda s, d: N.carry_columns(view(s, d, "v_wind").groupBy("point_id").agg(F.round(F.avg("ws_kmh"), 6).alias("mean")), view(s, d, "v_points").select("point_id", "sea_side", "x")), with_views("SELECT w.point_id, mean, sea_side, x FROM (SELECT point_id, round(avg(ws_kmh), 6) AS mean FROM v_wind GROUP BY 1) w LEFT JOIN v_points p ON p.point_id = w.point_id", "v_wind", "v_points"))

# ---- W: physics -------------------------------------------------------------------------------------------------

DENSE = """SELECT point_id, g.d AS direction, arg_min(fetch_m, row(least(abs(t.direction - g.d), 360 - abs(t.direction - g.d)), t.direction)) AS fetch_m
           FROM v_trace t, range(0, 360) g(d) GROUP BY 1, 2"""
add("W-01", lambda s, d: C.densify_fetch(view(s, d, "v_trace")), with_views("SELECT point_id, CAST(direction AS INTEGER) AS direction, fetch_m FROM dense", "v_trace", dense=DENSE))
add("W-02", lambda s, d: C.lookup_fetch(view(s, d, "v_wind").select("point_id", "direction").distinct(), view(s, d, "v_trace").withColumn("direction", F.when(F.col("direction") == 0, 360).otherwise(F.col("direction")))), with_views("SELECT DISTINCT w.point_id, w.direction, fetch_m FROM v_wind w JOIN dense f ON f.point_id = w.point_id AND f.direction = w.direction", "v_trace", "v_wind", dense=DENSE))
add("W-03", lambda s, d: C.lookup_with_offset(view(s, d, "v_points").select("point_id"), view(s, d, "v_trace").where("point_id % 3 <> 0"), 1), with_views("SELECT p.point_id, coalesce(a.point_id, b.point_id) AS fetch_id FROM v_points p LEFT JOIN ids a ON a.point_id = p.point_id + 1 LEFT JOIN ids b ON b.point_id = p.point_id WHERE coalesce(a.point_id, b.point_id) IS NOT NULL", "v_points", "v_trace", ids="SELECT DISTINCT point_id FROM v_trace WHERE point_id % 3 <> 0"))
U = "greatest(ws_kmh / 3.6 * 1.1, 0.5)"
XF = "(9.81 * greatest(fetch_m, 1) / (u * u))"
HS, TP = f"0.283 * (u * u / 9.81) * tanh(0.53 * pow({XF}, 0.75))", f"7.54 * (u / 9.81) * tanh(0.833 * pow({XF}, 0.375))"


def _growth(s, d, capped):
    j = C.lookup_fetch(view(s, d, "v_wind"), view(s, d, "v_trace"))
    h, t = waves.fetch_limited_growth(waves.wind_over_water("ws_kmh"), F.col("fetch_m"), capped)
    return j.select("point_id", "date", "direction", "ws_kmh", F.round(h, 6).alias("hs"), F.round(t, 6).alias("tp"))


GROWN = f"SELECT *, {U} AS u FROM (SELECT w.*, fetch_m FROM v_wind w JOIN dense f ON f.point_id = w.point_id AND f.direction = w.direction)"
for name, capped in (("W-04", False), ("W-05", True)):
    add(name, lambda s, d, c=capped: _growth(s, d, c), with_views(f"SELECT point_id, date, direction, ws_kmh, round({HS}, 6) AS hs, round({TP}, 6) AS tp FROM grown", "v_trace", "v_wind", dense=DENSE, grown=GROWN))
DELTA = f"({pmod('direction - normal_azimuth_deg + 180', 360)} - 180)"
_wp = lambda s, d: view(s, d, "v_wind").join(view(s, d, "v_points"), "point_id")
WP = "SELECT w.*, normal_azimuth_deg FROM v_wind w JOIN v_points p ON p.point_id = w.point_id"
add("W-06", lambda s, d: _wp(s, d).select("point_id", "date", "direction", angles.signed_difference("direction", "normal_azimuth_deg").alias("delta")), with_views(f"SELECT point_id, date, direction, {DELTA} AS delta FROM wp", "v_wind", "v_points", wp=WP))
add("W-07", lambda s, d: _wp(s, d).select("point_id", "date", "direction", F.round(angles.shoreward_cosine(angles.signed_difference("direction", "normal_azimuth_deg")), 6).alias("cosine")), with_views(f"SELECT point_id, date, direction, round(greatest(cos(radians({DELTA})), 0), 6) AS cosine FROM wp", "v_wind", "v_points", wp=WP))
_sc = lambda s, d: C.profile_scalars(view(s, d, "v_profile"), ("profile_id",))
SCALARS = """SELECT profile_id, min(h) FILTER (h > 0) AS h_min, max(h) FILTER (h > 0) AS h_max, arg_min(CASE WHEN h IS NULL THEN -1 ELSE h END, step) AS h0, arg_min(h, step) FILTER (h > 0) AS first_valid
             FROM (SELECT *, CASE WHEN z < 0 THEN -z END AS h FROM v_profile) GROUP BY 1"""
add("W-08", lambda s, d: _sc(s, d).where("h_max is not null").select("profile_id", F.round(waves.shoaling(F.col("h_max"), F.col("h_min")), 6).alias("ks")), with_views("SELECT profile_id, round(pow(h_max / greatest(h_min, 0.1), 0.25), 6) AS ks FROM sc WHERE h_max IS NOT NULL", "v_profile", sc=SCALARS))
add("W-09", lambda s, d: _sc(s, d).where("h_max is not null").select("profile_id", F.round(waves.shoaling(F.col("h_min"), F.col("h_max"), clamp=True), 6).alias("ks_low"), F.round(waves.shoaling(F.col("h_max"), F.col("h_min"), clamp=True), 6).alias("ks")), with_views("SELECT profile_id, round(1.0::DOUBLE, 6) AS ks_low, round(pow(greatest(h_max, greatest(h_min, 0.1)) / greatest(h_min, 0.1), 0.25), 6) AS ks FROM sc WHERE h_max IS NOT NULL", "v_profile", sc=SCALARS))
add("W-10", lambda s, d: _wp(s, d).select("point_id", "date", "direction", F.round(waves.shallow_refraction(angles.signed_difference("direction", "normal_azimuth_deg"), F.lit(3.0), F.lit(20.0)), 6).alias("cosine")), with_views(f"SELECT point_id, date, direction, round(cos(asin(least(sin(radians(abs({DELTA}))) * sqrt(9.81 * 3.0) / sqrt(9.81 * 20.0), 1))), 6) AS cosine FROM wp", "v_wind", "v_points", wp=WP))
add("W-11", lambda s, d: s.range(1, 13).select(F.col("id").cast("double").alias("t")).crossJoin(s.range(1, 21).select(F.col("id").cast("double").alias("h"))).select("t", "h", F.round(waves.phase_speed(F.col("t"), F.col("h")), 5).alias("c")),
    """WITH RECURSIVE k(t, h, i, k, done) AS (
         SELECT t::DOUBLE, h::DOUBLE, 0, pow(2 * pi() / t, 2) / 9.81, false FROM range(1, 13) a(t), range(1, 21) b(h)
         UNION ALL SELECT t, h, i + 1, CASE WHEN done OR abs(n - k) < 1e-8 THEN k ELSE n END, done OR abs(n - k) < 1e-8
         FROM (SELECT *, pow(2 * pi() / t, 2) / (9.81 * tanh(k * h)) AS n FROM k) WHERE i < 50)
       SELECT t, h, round(2 * pi() / t / k, 5) AS c FROM k WHERE i = 50""")
NEAR = "SELECT *, coalesce(h_max, 20) AS hd, coalesce(CASE WHEN h0 > 0 THEN h0 END, first_valid, 3) AS hp, 0.2 + (profile_id % 50) / 10.0::DOUBLE AS hs FROM sc"


def _nearshore(s, d):
    sc = _sc(s, d).withColumn("hs", 0.2 + (F.col("profile_id") % 50) / F.lit(10.0))
    n = C.nearshore(F.col("hs"), F.lit(30.0), F.col("h_min"), F.col("h_max"), F.col("h_first"), F.col("first_valid"))
    return sc.select("profile_id", F.round(n["ks"], 6).alias("ks"), F.round(n["h_break"], 6).alias("h_break"), F.round(n["height"], 6).alias("height"))


add("W-12", _nearshore, with_views("""SELECT profile_id, round(pow(hd / greatest(hp, 0.1), 0.25), 6) AS ks, round(hb, 6) AS h_break, round(least(hs * pow(hd / greatest(hp, 0.1), 0.25), 0.55 * hb), 6) AS height
    FROM (SELECT *, CASE WHEN hs * pow(hd / h_min, 0.25) >= 0.55 * h_min THEN h_min ELSE hp END AS hb FROM near)""", "v_profile", sc=SCALARS, near=NEAR))
add("W-13", lambda s, d: _sc(s, d).select("profile_id", F.round(C.breaking_limit(F.lit(4.0), F.col("h_min"))[0], 6).alias("height"), F.round(C.breaking_limit(F.lit(4.0), F.col("h_min"))[1], 6).alias("depth")), with_views("SELECT profile_id, round(coalesce(0.55 * h_min, least(4.0, 5.5)), 6)::DOUBLE AS height, round(coalesce(h_min, 10), 6)::DOUBLE AS depth FROM sc", "v_profile", sc=SCALARS))


def _nearshore_b(s, d):
    sc = _sc(s, d).where("h_max is not null and h_first > 0").withColumn("hs", 0.2 + (F.col("profile_id") % 50) / F.lit(10.0))
    n = C.nearshore_b(F.col("hs"), F.lit(6.0), F.lit(30.0), F.col("h_min"), F.col("h_max"), F.col("h_first"))
    return sc.select("profile_id", *[F.round(n[k], 4).alias(k) for k in ("ks", "height", "h_break", "angle", "cosine")])


add("W-14", _nearshore_b, with_views("""SELECT n.profile_id, round(pow(greatest(h_max, greatest(h0, 0.1)) / greatest(h0, 0.1), 0.25), 4) AS ks, round(least(hs * pow(greatest(h_max, greatest(h0, 0.1)) / greatest(h0, 0.1), 0.25), 0.55 * h_min), 4) AS height,
    round(h_min, 4) AS h_break, round(degrees(asin(least(sin(radians(30)) * b.k / a.k, 1))), 4) AS angle, round(cos(asin(least(sin(radians(30)) * b.k / a.k, 1))), 4) AS cosine
    FROM near n JOIN wave a ON a.h = n.h_min JOIN wave b ON b.h = n.h_max WHERE h_max IS NOT NULL AND h0 > 0""", "v_profile", sc=SCALARS, near=NEAR,
    wave="""SELECT h, k FROM (WITH RECURSIVE k(h, i, k, done) AS (
         SELECT h::DOUBLE, 0, pow(2 * pi() / 6.0, 2) / 9.81, false FROM range(1, 60) b(h)
         UNION ALL SELECT h, i + 1, CASE WHEN done OR abs(n - k) < 1e-8 THEN k ELSE n END, done OR abs(n - k) < 1e-8
         FROM (SELECT *, pow(2 * pi() / 6.0, 2) / (9.81 * tanh(k * h)) AS n FROM k) WHERE i < 50) SELECT h, k FROM k WHERE i = 50)"""))
add("W-15", lambda s, d: view(s, d, "v_wind").select("point_id", "date", "ws_kmh", F.round(waves.wave_power(F.col("ws_kmh") / 100, F.lit(5.0)), 3).alias("power")), with_views("SELECT point_id, date, ws_kmh, round(1025.0 * 9.81 * 9.81 * (ws_kmh / 100) * (ws_kmh / 100) * 5.0 / (64 * pi()), 3) AS power FROM v_wind", "v_wind"))
add("W-16", lambda s, d: _wp(s, d).select("point_id", "date", "direction", F.round(F.greatest(F.lit(0.0), 100.0 * F.cos(F.radians(angles.signed_difference("direction", "normal_azimuth_deg")))), 5).alias("floored"), F.round(100.0 * waves.shallow_refraction(angles.signed_difference("direction", "normal_azimuth_deg"), F.lit(3.0), F.lit(20.0)), 5).alias("plain")),
    with_views(f"SELECT point_id, date, direction, round(greatest(0, 100.0 * cos(radians({DELTA}))), 5) AS floored, round(100.0 * cos(asin(least(sin(radians(abs({DELTA}))) * sqrt(9.81 * 3.0) / sqrt(9.81 * 20.0), 1))), 5) AS plain FROM wp", "v_wind", "v_points", wp=WP))
DAILY = f"""SELECT point_id, date, direction, normal_azimuth_deg AS shore_normal_deg, round(fetch_m, 1) AS fetch_m, round(ws_kmh / 3.6 * 1.1, 3) AS "U10_ms", round(hs, 4) AS "Hs_offshore_m", round(hn, 4) AS "Hs_nearshore_m",
    round(tp, 4) AS "Tp_s", round(ks, 4) AS "Ks", round(3.0::DOUBLE, 3) AS "h_breaking_m", round(cs, 4) AS cos_shore, round(pw, 3) AS "WavePower_W_m", round(pw * cs, 3) AS "CWEF_W_m"
    FROM (SELECT *, 1025.0 * 9.81 * 9.81 * hn * hn * tp / (64 * pi()) AS pw FROM (SELECT *, least(hs * ks, 0.55 * 3.0) AS hn FROM (
      SELECT *, {HS} AS hs, {TP} AS tp, pow(20.0 / 3.0, 0.25) AS ks, cos(asin(least(sin(radians(abs({DELTA}))) * (sqrt(9.81 * 3.0) / sqrt(9.81 * 20.0)), 1))) AS cs
      FROM (SELECT g.*, normal_azimuth_deg FROM grown g JOIN v_points p ON p.point_id = g.point_id WHERE ws_kmh >= 0.1))))"""
DV = ("v_trace", "v_wind", "v_points")
DQ = {"dense": DENSE, "grown": GROWN, "daily": DAILY}


def daily(s, d, **options):
    return C.daily_waves(*views(s, d, "v_wind", "v_trace", "v_points"), **options)


add("W-17", daily, with_views("SELECT * FROM daily", *DV, **DQ))
add("W-18", lambda s, d: daily(s, d).groupBy("point_id").agg(F.count(F.lit(1)).alias("n_days")), with_views("SELECT point_id, count(*) AS n_days FROM daily GROUP BY 1", *DV, **DQ))


FRAME = Frame(west=36.2, south=42.7, step=0.03, nx=101, ny=101, tile=16)
ORIGIN = "greatest(least({c}, {high} - 1e-4), {low} + 1e-4)"
USED = "SELECT DISTINCT g.point_id, g.direction FROM grown g WHERE ws_kmh >= 0.1"
# 200 samples of 20 km, on the sphere
SAMPLES = f"""SELECT point_id, direction, step, (lon - 36.2) / 0.03 AS fx, (degrees(phi2) - 42.7) / 0.03 AS fy FROM (
    SELECT *, lon0 + degrees(atan2(sin(az) * sin(dd) * cos(phi), cos(dd) - sin(phi) * sin(phi2))) AS lon FROM (
      SELECT *, asin(sin(phi) * cos(dd) + cos(phi) * sin(dd) * cos(az)) AS phi2 FROM (
        SELECT u.point_id, u.direction, i AS step, i * (20000.0::DOUBLE / 199) / 6371000.0 AS dd, radians(u.direction) AS az, {ORIGIN.format(c="lon", low="36.2::DOUBLE", high="39.2::DOUBLE")} AS lon0, radians({ORIGIN.format(c="lat", low="42.7::DOUBLE", high="45.7::DOUBLE")}) AS phi
        FROM used u JOIN v_points p ON p.point_id = u.point_id, range(200) r(i))))"""
SOUNDED = """SELECT s.point_id, s.direction, s.step, outside, CASE WHEN NOT outside THEN (1 - tx) * (1 - ty) * a.z + tx * (1 - ty) * b.z + (1 - tx) * ty * c.z + tx * ty * e.z END AS z
    FROM (SELECT *, fx - ix AS tx, fy - iy AS ty FROM (SELECT *, fx < 0 OR fx > 100 OR fy < 0 OR fy > 100 AS outside, least(floor(fx), 99) AS ix, least(floor(fy), 99) AS iy FROM samples)) s
    LEFT JOIN v_raster a ON a.ix = s.ix AND a.iy = s.iy LEFT JOIN v_raster b ON b.ix = s.ix + 1 AND b.iy = s.iy LEFT JOIN v_raster c ON c.ix = s.ix AND c.iy = s.iy + 1 LEFT JOIN v_raster e ON e.ix = s.ix + 1 AND e.iy = s.iy + 1"""
TRANSECTS = """SELECT point_id, direction, bool_or(outside) AS outside, min(h) FILTER (h > 0) AS h_min, max(h) FILTER (h > 0) AS h_max, max(h) FILTER (step = 0) AS h_first, arg_min(h, step) FILTER (h > 0) AS first_valid
    FROM (SELECT *, CASE WHEN z < 0 THEN -z END AS h FROM sounded) GROUP BY 1, 2"""
DEPTHS = "SELECT point_id, direction, coalesce(h_max, 20) AS hd, coalesce(CASE WHEN h_first > 0 THEN h_first END, first_valid, 3) AS hp, h_min FROM transects WHERE point_id NOT IN (SELECT point_id FROM transects WHERE outside)"
DAILY_DEPTHS = f"""SELECT point_id, date, direction, normal_azimuth_deg AS shore_normal_deg, round(fetch_m, 1) AS fetch_m, round(ws_kmh / 3.6 * 1.1, 3) AS "U10_ms", round(hs, 4) AS "Hs_offshore_m", round(hn, 4) AS "Hs_nearshore_m",
    round(tp, 4) AS "Tp_s", round(ks, 4) AS "Ks", round(hb, 3) AS "h_breaking_m", round(cs, 4) AS cos_shore, round(pw, 3) AS "WavePower_W_m", round(pw * cs, 3) AS "CWEF_W_m"
    FROM (SELECT *, 1025.0 * 9.81 * 9.81 * hn * hn * tp / (64 * pi()) AS pw FROM (SELECT *, least(hs * ks, 0.55 * hb) AS hn FROM (
      SELECT *, pow(hd / greatest(hp, 0.1), 0.25) AS ks, CASE WHEN hs * pow(hd / h_min, 0.25) >= 0.55 * h_min THEN h_min ELSE hp END AS hb,
        greatest(cos(asin(least(sin(radians(abs({DELTA}))) * (sqrt(9.81 * greatest(hp, 0.1)) / sqrt(9.81 * hd)), 1))), 0) AS cs FROM (
          SELECT g.*, normal_azimuth_deg, hd, hp, h_min, {HS} AS hs, {TP} AS tp FROM grown g JOIN v_points p ON p.point_id = g.point_id JOIN depths d ON d.point_id = g.point_id AND d.direction = g.direction WHERE ws_kmh >= 0.1))))"""
RV = (*DV, "v_raster")
RQ = {"dense": DENSE, "grown": GROWN, "used": USED, "samples": SAMPLES, "sounded": SOUNDED, "transects": TRANSECTS, "depths": DEPTHS}


def daily_over_raster(s, d, **options):
    return C.waves_over_raster(*views(s, d, "v_wind", "v_trace", "v_points", "v_raster"), FRAME, **options)


add("W-19", daily_over_raster, with_views("SELECT * FROM daily", *RV, **RQ, daily=DAILY_DEPTHS))
POLICIES = ("raw", "abs", "negate_land_null")
add("W-20", lambda s, d: s.createDataFrame([(p,) for p in POLICIES], "policy string").crossJoin(s.range(1).select()).join(
    C.profile_scalars(view(s, d, "v_profile"), ("profile_id",), sign_policy="raw").select(F.lit("raw").alias("policy"), "profile_id", "h_min").unionByName(C.profile_scalars(view(s, d, "v_profile"), ("profile_id",), sign_policy="abs").select(F.lit("abs").alias("policy"), "profile_id", "h_min")).unionByName(_sc(s, d).select(F.lit("negate_land_null").alias("policy"), "profile_id", "h_min")), "policy").groupBy("policy").agg(F.count("h_min").alias("n"), F.sum("h_min").alias("total")),
    with_views("SELECT policy, count(h) AS n, sum(h) AS total FROM (SELECT 'raw' AS policy, min(z) FILTER (z > 0) AS h FROM v_profile GROUP BY profile_id UNION ALL SELECT 'abs', min(abs(z)) FILTER (z <> 0) FROM v_profile GROUP BY profile_id UNION ALL SELECT 'negate_land_null', min(-z) FILTER (z < 0) FROM v_profile GROUP BY profile_id) GROUP BY 1", "v_profile"))

# ---- A: statistics and index --------------------------------------------------------------------------------------

STATS = """SELECT point_id, count(*) AS n_days_total, count(*) FILTER ("CWEF_W_m" > 0) AS n_days_active, avg("CWEF_W_m") AS mean_W_m, quantile_cont("CWEF_W_m", 0.5) AS median_W_m, stddev_samp("CWEF_W_m") AS std_W_m,
    quantile_cont("CWEF_W_m", 0.75) AS p75_W_m, quantile_cont("CWEF_W_m", 0.9) AS p90_W_m, quantile_cont("CWEF_W_m", 0.95) AS p95_W_m, quantile_cont("CWEF_W_m", 0.99) AS p99_W_m, max("CWEF_W_m") AS max_W_m,
    sum("CWEF_W_m") * 86400 / 1e6 AS total_energy_MJ_m, avg("Hs_nearshore_m") AS Hs_mean_m, max("Hs_nearshore_m") AS Hs_max_m FROM daily GROUP BY 1"""
STORMS = 'SELECT d.point_id, count(*) FILTER ("CWEF_W_m" >= p90_W_m) AS n_storm_days_p90 FROM daily d JOIN stats s ON s.point_id = d.point_id GROUP BY 1'
_KEYS = ("mean_W_m", "median_W_m", "std_W_m", "p75_W_m", "p90_W_m", "p95_W_m", "p99_W_m", "max_W_m", "total_energy_MJ_m", "Hs_mean_m", "Hs_max_m")
_rounded = lambda df: df.withColumns({k: F.round(k, 8) for k in _KEYS})
ROUNDED = ", ".join(f'round({k}, 8) AS "{k}"' for k in _KEYS)
add("A-01", lambda s, d: _rounded(C.cwef_summary(daily(s, d))), with_views(f"SELECT s.point_id, n_days_total, n_days_active, n_storm_days_p90, {ROUNDED} FROM stats s JOIN storms t ON t.point_id = s.point_id", *DV, **DQ, stats=STATS, storms=STORMS))
add("A-02", lambda s, d: _rounded(C.cwef_summary_all(view(s, d, "v_points"), daily(s, d).where("point_id % 4 <> 0"))), with_views(f"SELECT p.point_id, coalesce(n_days_total, 0) AS n_days, n_days_active, n_storm_days_p90, {ROUNDED} FROM v_points p LEFT JOIN stats s ON s.point_id = p.point_id AND p.point_id % 4 <> 0 LEFT JOIN storms t ON t.point_id = s.point_id", *DV, **DQ, stats=STATS, storms=STORMS))
GROUPED = 'round(avg("CWEF_W_m"), 6) AS cwef_mean, round(sum("CWEF_W_m"), 3) AS cwef_sum, round(avg("Hs_nearshore_m"), 8) AS hs_mean, max("Hs_nearshore_m") AS hs_max, count("CWEF_W_m") AS n'
_grouped = lambda df: df.withColumns({"cwef_mean": F.round("cwef_mean", 6), "cwef_sum": F.round("cwef_sum", 3), "hs_mean": F.round("hs_mean", 8)})
add("A-03", lambda s, d: _grouped(C.cwef_by_direction(daily(s, d))).orderBy(F.desc("cwef_sum")), with_views(f"SELECT direction, {GROUPED} FROM daily GROUP BY 1", *DV, **DQ))
SECTOR = "CAST(floor((direction + 11.25) / 22.5) AS INTEGER) % 16"
NAMES = "['" + "', '".join(angles.COMPASS_16) + "']"
add("A-04", lambda s, d: _grouped(C.cwef_by_sector(daily(s, d))).withColumn("cos_mean", F.round("cos_mean", 6)).orderBy("sector_no"), with_views(f"SELECT {SECTOR} AS sector_no, {NAMES}[{SECTOR} + 1] AS sector, round(avg(cos_shore), 6) AS cos_mean, {GROUPED} FROM daily GROUP BY 1, 2", *DV, **DQ))
add("A-05", lambda s, d: C.annual_extremes(daily(s, d)).withColumn("cwef_mean", F.round("cwef_mean", 6)), with_views('SELECT CAST(year(date) AS INTEGER) AS year, max("Hs_nearshore_m") AS hs_max, max("CWEF_W_m") AS cwef_max, round(avg("CWEF_W_m"), 6) AS cwef_mean FROM daily GROUP BY 1', *DV, **DQ))
add("A-06", lambda s, d: s.range(0, 720).select((F.col("id") / 2.0).alias("direction")).select("direction", angles.sector_number("direction").alias("no"), angles.sector_name("direction").alias("sector")), f"SELECT direction, {SECTOR} AS no, {NAMES}[{SECTOR} + 1] AS sector FROM (SELECT i / 2.0::DOUBLE AS direction FROM range(0, 720) t(i))")
RING = f'SELECT point_id, {SECTOR} AS s, sum("CWEF_W_m") AS e FROM daily GROUP BY 1, 2'
TOP = """SELECT point_id, i, coalesce(sum(e) FILTER (s = i), 0) + coalesce(sum(e) FILTER (s = (i + 1) % 16), 0) + coalesce(sum(e) FILTER (s = (i + 2) % 16), 0) AS three, sum(e) AS total FROM ring, range(16) r(i) GROUP BY 1, 2"""
BEST = "SELECT point_id, arg_max(i, row(round(three, 6), -i)) AS i, max(three) AS three, max(total) AS total FROM top GROUP BY 1"
NAME3 = f"concat_ws(',', {NAMES}[i % 16 + 1], {NAMES}[(i + 1) % 16 + 1], {NAMES}[(i + 2) % 16 + 1])"
add("A-07", lambda s, d: X.top_sectors(daily(s, d)).select("point_id", "top_start", "top3_sectors"), with_views(f"SELECT point_id, CAST(i AS INTEGER) AS top_start, {NAME3} AS top3_sectors FROM best", *DV, **DQ, ring=RING, top=TOP, best=BEST))
add("A-08", lambda s, d: X.top_sectors(daily(s, d)).select("point_id", F.round("K_dir", 6).alias("K_dir")), with_views('SELECT point_id, round(three / total, 6) AS "K_dir" FROM best', *DV, **DQ, ring=RING, top=TOP, best=BEST))
METRICS = f"""SELECT b.point_id, round(mean, 3) AS "mean_CWEF_Wm", round(coalesce(e, 0), 3) AS "E_storm_MJm", round(thr, 3) AS "storm_threshold_Wm", round(three / total, 4) AS "K_dir", {NAME3} AS top3_sectors,
    round(CASE WHEN mean = 0 THEN 0 ELSE std / mean END, 4) AS "CV", n AS n_days, n_storm AS n_storm_days
    FROM (SELECT point_id, avg("CWEF_W_m") AS mean, stddev_samp("CWEF_W_m") AS std, count("CWEF_W_m") AS n, quantile_cont("CWEF_W_m", 0.9) AS thr FROM daily GROUP BY 1) b
    JOIN (SELECT d.point_id, sum("CWEF_W_m") FILTER ("CWEF_W_m" > thr) * 86400 / 1e6 AS e, count(*) FILTER ("CWEF_W_m" > thr) AS n_storm FROM daily d JOIN (SELECT point_id, quantile_cont("CWEF_W_m", 0.9) AS thr FROM daily GROUP BY 1) q ON q.point_id = d.point_id GROUP BY 1) s ON s.point_id = b.point_id
    JOIN best t ON t.point_id = b.point_id"""
MQ = DQ | {"ring": RING, "top": TOP, "best": BEST, "metrics": METRICS}
add("A-09", lambda s, d: X.exposure_metrics(daily(s, d)).select("point_id", "CV"), with_views('SELECT point_id, "CV" FROM metrics', *DV, **MQ))
add("A-10", lambda s, d: X.exposure_metrics(daily(s, d)).select("point_id", "storm_threshold_Wm", "E_storm_MJm", "n_days", "n_storm_days"), with_views('SELECT point_id, "storm_threshold_Wm", "E_storm_MJm", n_days, n_storm_days FROM metrics', *DV, **MQ))
add("A-11", lambda s, d: X.annual_metrics(daily(s, d)), with_views("SELECT *, 2024 AS year FROM metrics", *DV, **MQ))
RANKED = " , ".join(f"""CASE WHEN "{m}" <= q{i}[1] THEN 1 WHEN "{m}" <= q{i}[2] THEN 2 WHEN "{m}" <= q{i}[3] THEN 3 WHEN "{m}" <= q{i}[4] THEN 4 WHEN "{m}" IS NOT NULL THEN 5 END AS "R{i}" """ for i, m in enumerate(X.METRICS, 1))
BOUNDS = "SELECT " + ", ".join(f'quantile_cont("{m}", [0.2, 0.4, 0.6, 0.8]) AS q{i}' for i, m in enumerate(X.METRICS, 1)) + " FROM metrics"
INDEX = 'SELECT *, round(pow("R1" * "R2" * "R3" * "R4", 0.25), 3) AS "WER" FROM ranked'
IQ = MQ | {"bounds": BOUNDS, "ranked": f"SELECT metrics.*, {RANKED} FROM metrics, bounds"}
add("A-12", lambda s, d: X.quintile_ranks(X.exposure_metrics(daily(s, d)), {m: f"R{i}" for i, m in enumerate(X.METRICS, 1)}).select("point_id", "R1", "R2", "R3", "R4"), with_views('SELECT point_id, "R1", "R2", "R3", "R4" FROM ranked', *DV, **IQ))
add("A-13", lambda s, d: X.exposure_index(daily(s, d)).select("point_id", "WER"), with_views(f'SELECT point_id, "WER" FROM ({INDEX})', *DV, **IQ))
LEFT_INDEX = """SELECT CAST(p.point_id AS VARCHAR) AS point_id, i."mean_CWEF_Wm", i."E_storm_MJm", i."storm_threshold_Wm", i."K_dir", i.top3_sectors, i."CV", coalesce(i.n_days, 0) AS n_days, coalesce(i.n_storm_days, 0) AS n_storm_days, "R1", "R2", "R3", "R4", "WER" FROM v_points p LEFT JOIN (""" + INDEX + ") i ON i.point_id = p.point_id"


def flagship(s, d):
    return X.exposure_index(daily_over_raster(s, d), view(s, d, "v_points"))


add("A-14", flagship, with_views(LEFT_INDEX, *RV, **(RQ | IQ | {"daily": DAILY_DEPTHS})))
add("A-15", lambda s, d: X.empty_indices(view(s, d, "v_points").unionByName(view(s, d, "v_points").withColumn("point_id", F.col("point_id") + 100000)), daily(s, d)), with_views('SELECT point_id + 100000 AS point_id, 0 AS n_days, 0 AS n_storm_days, NULL::DOUBLE AS "mean_CWEF_Wm", NULL::DOUBLE AS "E_storm_MJm", NULL::DOUBLE AS "K_dir", NULL::DOUBLE AS "CV" FROM v_points UNION ALL SELECT point_id, 0, 0, NULL, NULL, NULL, NULL FROM v_points WHERE point_id NOT IN (SELECT point_id FROM daily)', *DV, **DQ))

# ---- R: wind roses ------------------------------------------------------------------------------------------------

ROSE = "SELECT {k} s.i AS sector, s.i * 22.5::DOUBLE AS center_deg, round(coalesce(n, 0) / total, 8) AS frequency, round(coalesce(mean, 0), 6) AS mean_speed FROM {base} LEFT JOIN (SELECT {k} CAST(floor(((direction % 360) + 11.25) % 360 / 22.5) AS INTEGER) AS sector, count(*) AS n, avg(ws_kmh) AS mean FROM v_wind GROUP BY ALL) c ON c.sector = s.i {on}"
_rose = lambda df: df.withColumns({"frequency": F.round("frequency", 8), "mean_speed": F.round("mean_speed", 6)})
add("R-01", lambda s, d: _rose(R.wind_rose(view(s, d, "v_wind"))), with_views(ROSE.format(k="", base="range(16) s(i) CROSS JOIN (SELECT count(*)::DOUBLE AS total FROM v_wind) t", on=""), "v_wind").replace("s.i AS sector", "CAST(s.i AS INTEGER) AS sector"))
add("R-02", lambda s, d: _rose(R.wind_rose(view(s, d, "v_wind"), ("point_id",))), with_views(ROSE.format(k="point_id,", base="range(16) s(i) CROSS JOIN (SELECT point_id AS pid, count(*)::DOUBLE AS total FROM v_wind GROUP BY 1) t", on="AND c.point_id = t.pid").replace("SELECT point_id, s.i", "SELECT pid AS point_id, s.i"), "v_wind"))
TABLE = "SELECT CAST(least(floor(ws_kmh / (top / 6)), 5) AS INTEGER) AS speed_bin, CAST(floor((direction + 11.25) % 360 / 22.5) AS INTEGER) AS sector FROM v_wind, (SELECT max(ws_kmh) AS top FROM v_wind)"
add("R-03", lambda s, d: R.rose_table(view(s, d, "v_wind")).withColumn("percent", F.round("percent", 6)), with_views("SELECT speed_bin, sector, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM t), 6) AS percent, CAST(grouping(speed_bin) AS TINYINT) AS is_marginal FROM t GROUP BY GROUPING SETS ((sector, speed_bin), (sector))", "v_wind", t=TABLE))
add("R-04", lambda s, d: view(s, d, "v_wind").crossJoin(F.broadcast(view(s, d, "v_wind").agg(F.max("ws_kmh").alias("top")))).groupBy(R.speed_class("ws_kmh", F.col("top")).alias("speed_bin"), R.speed_class_edges("ws_kmh", (0.0, 5.0, 10.0, 20.0, 50.0)).alias("edge_bin")).count(),
    with_views("SELECT CAST(least(floor(ws_kmh / (top / 6)), 5) AS INTEGER) AS speed_bin, CASE WHEN ws_kmh < 0 OR ws_kmh > 50 THEN NULL WHEN ws_kmh < 5 THEN 0 WHEN ws_kmh < 10 THEN 1 WHEN ws_kmh < 20 THEN 2 ELSE 3 END AS edge_bin, count(*) AS count FROM v_wind, (SELECT max(ws_kmh) AS top FROM v_wind) GROUP BY 1, 2", "v_wind"))
add("R-05", lambda s, d: s.range(0, 16).select(F.col("id").cast("int").alias("i")).select("i", (F.col("i") * 22.5).alias("edge"), (F.col("i") * 22.5 + 11.25).alias("center"), R.direction_label("i").alias("label"), R.direction_label(F.pmod("i", F.lit(12)).cast("int"), 12).alias("label12")), f"SELECT CAST(i AS INTEGER) AS i, i * 22.5::DOUBLE AS edge, i * 22.5::DOUBLE + 11.25 AS center, {NAMES}[i + 1] AS label, concat(CAST(i % 12 * 30 AS VARCHAR), '°') AS label12 FROM range(16) t(i)")
add("R-06", lambda s, d: R.calm_counts(view(s, d, "v_wind").withColumn("ws_kmh", F.when(F.col("ws_kmh") > 1, F.col("ws_kmh"))), ("point_id",)), with_views("SELECT point_id, count(*) FILTER (ws_kmh <= 1) AS calm_count, count(*) AS sample_count FROM v_wind GROUP BY 1", "v_wind"))
