"""Weather grids, cached series, and their assignment to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import wrap360
from ..shared import written
from .dealing import dealt


def axis_centers(low: Column | str, high: Column | str, step: float = 0.25, offset: float = 0.125, border: int = 1) -> Column:
    """Array of cell centres covering [low, high] with border cells on both sides."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    half, extra = step / 2, border * step
    first = F.ceil((low - half - extra - offset) / step)
    last = F.floor((high + half + extra - offset) / step)
    return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.round(offset + i * step, 6))).otherwise(F.array().cast("array<double>"))


def weather_grid(points: DataFrame, step: float = 0.25, offset: float = 0.125, border: int = 1) -> DataFrame:
    """point_id, lat, lon, ring_y, ring_x (-1, 0, 1 x border on the outer rows and columns) for all cells around the points."""
    box = points.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    axes = box.select(axis_centers("s", "n", step, offset, border).alias("lats"), axis_centers("w", "e", step, offset, border).alias("lons"))
    rows = axes.select(F.posexplode("lats").alias("iy", "lat"), "lons", F.size("lats").alias("ny"))
    cells = rows.select("iy", "lat", "ny", F.posexplode("lons").alias("ix", "lon"), F.size("lons").alias("nx"))
    ring = lambda i, n: F.when(i < border, -border).when(i >= n - border, border).otherwise(0)
    return cells.select(
        (F.col("iy") * F.col("nx") + F.col("ix") + 1).cast("bigint").alias("point_id"), "lat", "lon", ring(F.col("iy"), F.col("ny")).alias("ring_y"), ring(F.col("ix"), F.col("nx")).alias("ring_x")
    )


def grid_lines(points: DataFrame, step: float = 0.25, border: int = 1, cover: bool = True) -> DataFrame:
    """Lines of the grid whose extent is the points' box snapped outwards (cover) or inwards, with a border."""
    box = points.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    down = lambda c: F.floor(F.col(c) / step) * step
    up = lambda c: F.ceil(F.col(c) / step) * step
    low, high = (down, up) if cover else (up, down)
    ext = box.select(*[(low(c) - border * step).alias(c) for c in ("s", "w")], *[(high(c) + border * step).alias(c) for c in ("n", "e")])
    steps = lambda a, b: F.transform(F.sequence(F.lit(0), F.round((F.col(b) - F.col(a)) / step).cast("int")), lambda i: F.round(F.col(a) + i * step, 6))
    h = ext.select(F.lit("parallel").alias("kind"), F.explode(steps("s", "n")).alias("at"), F.col("w").alias("start"), F.col("e").alias("end"))
    v = ext.select(F.lit("meridian").alias("kind"), F.explode(steps("w", "e")).alias("at"), F.col("s").alias("start"), F.col("n").alias("end"))
    return h.unionByName(v)


def clamp_range(start: Column, end: Column, today: Column, first: str = "1940-01-01", lag_days: int = 7) -> tuple[Column, Column, Column]:
    """Start and end kept to what the archive has, and whether anything is left."""
    s, e = F.greatest(start, F.lit(first).cast("date")), F.least(end, F.date_sub(today, lag_days))
    return s, e, s <= e


def missing_ranges(points: DataFrame, cached: DataFrame, start: str, end: str) -> DataFrame:
    """point_id, start_date, end_date of the runs of days that are not cached."""
    calendar = points.select("point_id").distinct().withColumn("obs_date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    gaps = calendar.join(cached.select("point_id", "obs_date"), ["point_id", "obs_date"], "left_anti")
    island = F.date_sub("obs_date", F.row_number().over(Window.partitionBy("point_id").orderBy("obs_date")))
    return gaps.withColumn("island", island).groupBy("point_id", "island").agg(F.min("obs_date").alias("start_date"), F.max("obs_date").alias("end_date")).drop("island")


def merge_segments(segments: DataFrame, start: str, end: str) -> DataFrame:
    """point_id, obs_date, value, is_missing: the last segment of each day, for the whole calendar of each point."""
    last = segments.groupBy("point_id", "obs_date").agg(F.max_by("value", "path_seq").alias("value"), F.lit(True).alias("held"))
    calendar = segments.select("point_id").distinct().withColumn("obs_date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return calendar.join(last, ["point_id", "obs_date"], "left").select("point_id", "obs_date", "value", F.col("held").isNull().alias("is_missing"))


def download_tasks(ranges: DataFrame, size: int = 25) -> DataFrame:
    """start_date, end_date, batch, points: requests of at most size points with one date range."""
    nth = F.row_number().over(Window.partitionBy("start_date", "end_date").orderBy("point_id")) - 1
    return ranges.withColumn("batch", F.floor(nth / size).cast("int")).groupBy("start_date", "end_date", "batch").agg(F.array_sort(F.collect_list("point_id")).alias("points"))


def variables_key(names: Column | str) -> Column:
    """First 12 hexadecimal digits of the SHA-256 of the sorted names."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.col(names) if isinstance(names, str) else names), "|"), 256), 1, 12)


def nearest_nodes(points: DataFrame, nodes: DataFrame, k: int = 1, cell: float = 25000.0) -> DataFrame:
    """point_id, grid_id, distance_m, rank: the k nearest nodes of each point (x, y in metres; ties by grid_id).

    Nodes are dealt into square cells. A point looks into its own cell and the eight around it; it is done once its k-th
    neighbour is no farther than a cell is wide, which nothing outside can beat. The others look again among cells of
    twice the width, until one is as wide as all points and nodes together. So a point has nine rows a round, however far
    its nodes are, and meets only nodes that are at most about four times as far away as the ones it takes.
    """
    p = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"))
    box = p.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first() + nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if None in box:
        return p.join(nodes.select("grid_id"), F.lit(False)).select("point_id", "grid_id", F.lit(0.0).alias("distance_m"), F.lit(0).alias("rank"))
    widest = max(max(box[1], box[5]) - min(box[0], box[4]), max(box[3], box[7]) - min(box[2], box[6]))
    order = Window.partitionBy("point_id").orderBy("distance_m", "grid_id")
    found = None
    while True:
        at = lambda c, width=cell: F.floor(F.col(c) / width)
        around = F.explode(F.array(*[F.struct((at("px") + i).alias("cx"), (at("py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        cells = nodes.select("grid_id", "x", "y", at("x").alias("cx"), at("y").alias("cy"))
        pairs = p.select("point_id", "px", "py", around.alias("c")).select("point_id", "px", "py", "c.*").join(cells, ["cx", "cy"])
        pairs = pairs.select("point_id", "grid_id", F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))).alias("distance_m"))
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        last = cell >= widest
        if not last:
            done = ranked.groupBy("point_id").agg(F.max("distance_m").alias("d"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= k) & (F.col("d") <= cell)).select("point_id")
            ranked = ranked.join(done, "point_id", "left_semi")
            p = written(p.join(done, "point_id", "left_anti"), "points")  # else each round would find all those before it again
        found = ranked if found is None else found.unionByName(ranked)
        if last or p.isEmpty():
            return found
        cell *= 2


#: Points that meet the series of their nodes in one task's share, about.
SHARE = 1_000


def _with_series(points: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """points joined with series by key. Points of one key are dealt into shares and the series go to each of these, so the
    rows that points times dates make come in the task that returns them, and are not shuffled."""
    points = written(points, "nearest")
    shares = points.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("long").alias("shares"))
    held = points.join(shares, key).withColumn("share", F.pmod(F.xxhash64("point_id"), "shares")).drop("shares")
    sent = series.join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    return dealt(held, key, "share").join(sent.hint("merge"), [key, "share"]).drop("share")


def assign_nearest(points: DataFrame, nodes: DataFrame, series: DataFrame) -> DataFrame:
    """The series of the nearest node for every point."""
    found = nearest_nodes(points, nodes).select("point_id", "grid_id", "distance_m")
    return _with_series(found, series, "grid_id").select("point_id", F.col("grid_id").alias("source_grid_point_id"), F.col("distance_m").alias("weather_distance_m"), "date", "ws", "wd")


def assign_idw(points: DataFrame, nodes: DataFrame, series: DataFrame, k: int = 4, power: float = 2.0, floor: float = 1e-9) -> DataFrame:
    """point_id, date, ws, wd by inverse-distance weights of the k nearest nodes.

    Speeds are weighted means, directions weighted circular means; a day on which a neighbour has no value is null; a
    point on a node copies it. A point is one row with its weights; points with the same nodes meet one row a day, in which
    the values of these nodes lie side by side.
    """
    k = max(1, k)
    near = nearest_nodes(points, nodes, k)
    w = near.withColumn("w", 1 / F.pow(F.greatest("distance_m", F.lit(floor)), F.lit(power)))
    per_point = Window.partitionBy("point_id")
    w = w.withColumn("nearest", F.min("distance_m").over(per_point)).withColumn("n", F.count(F.lit(1)).over(per_point))
    w = w.where((F.col("nearest") > floor) | (F.col("rank") == 1)).withColumn("n", F.when(F.col("nearest") > floor, F.col("n")).otherwise(1))
    held = w.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("grid_id", "w"))).alias("a"), F.max("n").alias("n"))
    held = written(held.select("point_id", F.col("a.grid_id").alias("grid_ids"), F.col("a.w").alias("w"), "n"), "weights")
    of_day = {"c": F.count(F.lit(1)), "cs": F.count("ws"), "cd": F.count("wd"), "s": F.sum("ws"), "e": F.sum(F.sin(F.radians("wd"))), "o": F.sum(F.cos(F.radians("wd")))}
    daily = series.groupBy("grid_id", "date").agg(*[v.alias(c) for c, v in of_day.items()])
    places = held.select("grid_ids").distinct().select("grid_ids", F.posexplode("grid_ids").alias("i", "grid_id")).join(daily, "grid_id")
    together = places.groupBy("grid_ids", "date").agg(*[F.max(F.when(F.col("i") == i, F.struct(*of_day))).alias(f"v{i}") for i in range(k)])
    j = _with_series(held, together, "grid_ids")

    def total(of: str, weighted: bool = True) -> Column:
        parts = [F.coalesce((F.get("w", F.lit(i)) if weighted else F.lit(1)) * F.col(f"v{i}.{of}"), F.lit(0)) for i in range(k)]
        return sum(parts[1:], parts[0])

    whole = (total("cs", False) == F.col("n")) & (total("cd", False) == F.col("n"))
    return j.select(
        "point_id", "date", F.when(whole, total("s") / total("c")).alias("ws"), F.when(whole, wrap360(F.degrees(F.atan2(total("e"), total("o"))))).alias("wd"), total("c", False).alias("neighbours")
    )


def assign_weather(points: DataFrame, nodes: DataFrame, series: DataFrame, strategy: str = "idw", k: int = 4, power: float = 2.0) -> DataFrame:
    if strategy == "nearest":
        out = assign_nearest(points, nodes, series).select("point_id", "date", "ws", "wd")
    elif strategy == "idw":
        out = assign_idw(points, nodes, series, k, power).select("point_id", "date", "ws", "wd")
    else:
        raise ValueError(f"strategy is nearest or idw, not {strategy!r}")
    return out.withColumn("weather_strategy", F.lit(strategy))


def weather_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("point_id").agg(F.count(F.lit(1)).alias("n_records"), F.avg("ws").alias("mean_speed"), F.max("ws").alias("max_speed"))


def wide_series(assigned: DataFrame) -> DataFrame:
    """A row per point with parallel arrays in the order of dates."""
    held = assigned.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("date", "ws", "wd"))).alias("a"))
    return held.select("point_id", F.transform("a", lambda x: x["date"].cast("string")).alias("dates"), F.transform("a", lambda x: x["ws"]).alias("wind_speed"), F.transform("a", lambda x: x["wd"]).alias("wind_dir"))


def uv_to_wind(u: Column | str, v: Column | str) -> tuple[Column, Column]:
    """Speed, and the direction the wind comes from."""
    u, v = (F.col(c) if isinstance(c, str) else c for c in (u, v))
    return F.sqrt(u * u + v * v), wrap360(270.0 - F.degrees(F.atan2(v, u)))


def request_parameters(spark: SparkSession, west: float, south: float, east: float, north: float, pixels: int = 1, step: float = 0.25) -> DataFrame:
    """The bounding box of a request, wider by some pixels and kept to the world."""
    return spark.range(1).select(
        F.greatest(F.lit(south - pixels * step), F.lit(-90.0)).alias("south"), F.greatest(F.lit(west - pixels * step), F.lit(-180.0)).alias("west"),
        F.least(F.lit(north + pixels * step), F.lit(90.0)).alias("north"), F.least(F.lit(east + pixels * step), F.lit(180.0)).alias("east"),
    )
