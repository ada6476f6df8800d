"""Wind fetch: rays from shore points in all directions to the first piece of coast they meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import in_land_sector, offset_x, offset_y
from ..functions.geodesy import direct, distance
from ..shared import written
from .dealing import dealt

MAX_M = 100_000.0
OFFSET_M = 10.0
EXCLUSION_M = 1.0
PRECISION_M = 0.05
CELL_M = 2_000.0
DEGREE_M = 100_000.0


def snap(c: Column | str, precision: float = PRECISION_M) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c / precision) * precision


def point_azimuths(points: DataFrame, azimuths: range | list = range(360)) -> DataFrame:
    """Each point with each azimuth; direction_id counts from 1."""
    every = F.posexplode(F.array(*[F.lit(float(a)) for a in azimuths])).alias("at", "azimuth_deg")
    return points.select("*", every).withColumn("direction_id", F.col("at") + 1).drop("at")


def shifted_starts(points: DataFrame, offset_m: float = OFFSET_M) -> DataFrame:
    """start_x, start_y: the point moved along its normal."""
    return points.withColumn("start_x", F.col("x") + offset_x("normal_azimuth_deg", F.lit(offset_m))).withColumn("start_y", F.col("y") + offset_y("normal_azimuth_deg", F.lit(offset_m)))


def split_land_sector(rays: DataFrame, edge: str = "half_open") -> tuple[DataFrame, DataFrame]:
    """Rays to trace, and those that point to land."""
    flagged = rays.withColumn("is_land", in_land_sector("azimuth_deg", "normal_azimuth_deg", edge))
    return flagged.where(~F.col("is_land")).drop("is_land"), flagged.where("is_land").drop("is_land")


def _ray_end(azimuth: Column | str, length_m: float, precision: float) -> tuple[Column, Column]:
    return snap(F.col("start_x") + offset_x(azimuth, F.lit(length_m)), precision), snap(F.col("start_y") + offset_y(azimuth, F.lit(length_m)), precision)


def ray_ends(rays: DataFrame, length_m: float = MAX_M, precision: float = PRECISION_M) -> DataFrame:
    end_x, end_y = _ray_end("azimuth_deg", length_m, precision)
    return rays.withColumn("end_x", end_x).withColumn("end_y", end_y)


def segment_cells(segments: DataFrame, cell: float = CELL_M) -> DataFrame:
    """Each segment once for every cell that its box touches; long ones should be split before."""
    c = lambda a, b, f: F.floor(f(a, b) / cell).cast("bigint")
    return segments.select(
        "*", F.explode(F.sequence(c("x0", "x1", F.least), c("x0", "x1", F.greatest))).alias("cx"), c("y0", "y1", F.least).alias("_a"), c("y0", "y1", F.greatest).alias("_b")
    ).select("*", F.explode(F.sequence("_a", "_b")).alias("cy")).drop("_a", "_b")


def ray_cells(rays: DataFrame, cell: float = CELL_M, ends: tuple[str, str, str, str] = ("start_x", "start_y", "end_x", "end_y"), margin: float = 0.0) -> DataFrame:
    """Each ray, or stretch of a ray, once for every cell it may pass, or come as near as margin to: per column of cells,
    those between its heights there."""
    sx, sy, ex, ey = ends
    c0, c1 = F.floor((F.least(sx, ex) - margin) / cell).cast("bigint"), F.floor((F.greatest(sx, ex) + margin) / cell).cast("bigint")
    columns = rays.withColumn("cx", F.explode(F.sequence(c0, c1)))
    slope = F.try_divide(F.col(ey) - F.col(sy), F.col(ex) - F.col(sx))
    at = lambda x: F.col(sy) + slope * (x - F.col(sx))
    left = F.greatest(F.col("cx") * cell - margin, F.least(sx, ex))
    right = F.least((F.col("cx") + 1) * cell + margin, F.greatest(sx, ex))
    steep = F.abs(F.col(ex) - F.col(sx)) < 1e-9
    low = F.when(steep, F.least(sy, ey)).otherwise(F.least(at(left), at(right))) - margin
    high = F.when(steep, F.greatest(sy, ey)).otherwise(F.greatest(at(left), at(right))) + margin
    rows = columns.withColumn("_a", F.floor(low / cell - 1e-9).cast("bigint")).withColumn("_b", F.floor(high / cell + 1e-9).cast("bigint"))
    return rows.withColumn("cy", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def _crossing() -> tuple[Column, Column, Column]:
    """Of a ray (start, end) and a segment (x0, y0, x1, y1) in one row: the share t of the ray where they cross, null if
    nowhere; whether they lie on one line; the shares of the ends of the stretch that they then have in common."""
    rx, ry = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    sx, sy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    qx, qy = F.col("x0") - F.col("start_x"), F.col("y0") - F.col("start_y")
    cross = rx * sy - ry * sx
    t, u = F.try_divide(qx * sy - qy * sx, cross), F.try_divide(qx * ry - qy * rx, cross)
    length2 = rx * rx + ry * ry
    collinear = (F.abs(cross) < 1e-9) & (F.abs(qx * ry - qy * rx) <= 1e-6 * F.sqrt(length2))
    t0, t1 = (qx * rx + qy * ry) / length2, ((qx + sx) * rx + (qy + sy) * ry) / length2
    inside = lambda v: (v >= 0) & (v <= 1)
    shared = F.filter(F.array(t0, t1, F.when((t0 * t1 < 0), F.lit(0.0)), F.when((t0 - 1) * (t1 - 1) < 0, F.lit(1.0))), lambda v: v.isNotNull() & inside(v))
    return F.when((F.abs(cross) >= 1e-9) & inside(t) & inside(u), t), collinear, shared


def hits(rays: DataFrame, segments: DataFrame, cell: float = CELL_M, keys: tuple[str, ...] = ("point_id", "direction_id")) -> DataFrame:
    """keys, hit_x, hit_y of every crossing of a ray and a segment; of a shared stretch both ends."""
    pairs = ray_cells(rays, cell).join(segment_cells(segments, cell), ["cx", "cy"])
    t, collinear, shared = _crossing()
    found = F.when(collinear, shared).when(t.isNotNull(), F.array(t))
    rx, ry = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    at = pairs.select(*dict.fromkeys((*keys, "start_x", "start_y")), rx.alias("rx"), ry.alias("ry"), F.explode(found).alias("t"))
    return at.select(*keys, (F.col("start_x") + F.col("t") * F.col("rx")).alias("hit_x"), (F.col("start_y") + F.col("t") * F.col("ry")).alias("hit_y"))


#: Points whose rays meet a copy of the coast in one task, at most (6 KB each); side of the tiles in which the coast comes there.
FAN_POINTS, FAN_TILE_M = 4_096, 10_000.0
#: Pairs of a point and a segment that are looked at together.
FAN_PAIRS = 200_000


def fan_hits(points: DataFrame, segments: DataFrame, *, offset_m: float = OFFSET_M, max_m: float = MAX_M, precision: float = PRECISION_M, edge: str = "half_open") -> DataFrame:
    """point_id (a bigint), direction_id, hit_x, hit_y, rounded to millimetres, without repeats: hits() of the rays in all whole degrees that point to sea.

    Where every crossing of whole rays counts, cells save little, and a ray costs a row for each. Here a point meets each
    segment once: the directions in which the segment is seen are a stretch of whole degrees, and only these rays are tested.
    Points are dealt into shares; to each of these the segments go, tile by tile. A hit counts in the tile where it lies, so
    repeats are found there, and hits are not shuffled.
    """
    spark, tile = points.sparkSession, FAN_TILE_M
    azimuths = [float(a) for a in range(360)]
    numbered = F.array(*[F.lit(a) for a in azimuths])
    sea = F.filter(_numbers(azimuths), lambda i: ~_to_land(azimuths, edge)(i))
    starts = shifted_starts(points, offset_m).select(F.col("point_id").cast("long").alias("point_id"), "start_x", "start_y", sea.alias("sea"))
    open_rays = starts.groupBy("point_id", "start_x", "start_y").agg(F.array_distinct(F.flatten(F.collect_list("sea"))).alias("open")).where(F.size("open") > 0)
    n = max(CORE_SHARES * spark.sparkContext.defaultParallelism, -(-points.count() // FAN_POINTS))
    fans = open_rays.select(F.pmod(F.xxhash64("point_id"), F.lit(n)).cast("int").alias("share"), "point_id", "start_x", "start_y", "open")
    at = lambda f, c, m: F.floor((f(f"{c}0", f"{c}1") + m) / tile).cast("long")
    tiles = segments.select("x0", "y0", "x1", "y1").dropna().distinct()
    for c in ("x", "y"):
        tiles = tiles.withColumn(f"t{c}", F.explode(F.sequence(at(F.least, c, -0.01), at(F.greatest, c, 0.01))))
    coast = dealt(tiles, "x0", "y0", "x1", "y1").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    moved = fans.unionByName(coast, allowMissingColumns=True).repartitionById(n, "share").sortWithinPartitions("share", F.col("tx").isNotNull(), "tx", "ty")
    # computed behind the shuffle, which so moves the numbers of a point's rays only
    ends = F.transform("open", lambda i: F.struct(*[e.alias(c) for e, c in zip(_ray_end(numbered[i], max_m, precision), ("x", "y"), strict=True)]))
    given = moved.withColumn("ends", ends)
    rows = given.select("share", "point_id", "start_x", "start_y", F.transform("open", lambda i: i + 1).alias("i"), F.col("ends.x").alias("end_x"), F.col("ends.y").alias("end_y"), "x0", "y0", "x1", "y1", "tx", "ty")
    margin = 1e-4 + np.degrees(precision / max_m)

    def hits_of(fan: list[tuple], at: tuple, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = np.concatenate(parts, axis=1)
        step = max(1, FAN_PAIRS // held.shape[1])
        for k in range(0, len(fan), step):
            point, x, y, end_x, end_y = (np.array(c) for c in zip(*fan[k : k + step], strict=True))
            p, d, hit_x, hit_y = _fan_hits(x, y, end_x, end_y, *held, margin)
            hit_x, hit_y = _to_millimetres(hit_x), _to_millimetres(hit_y)
            here = np.flatnonzero((np.floor(hit_x / tile) == at[1]) & (np.floor(hit_y / tile) == at[2]))
            ray = p[here] * 360 + d[here]
            here, ray = (c[np.lexsort((hit_y[here], hit_x[here], ray))] for c in (here, ray))
            new = np.ones(len(here), bool)
            new[1:] = (ray[1:] != ray[:-1]) | (hit_x[here[1:]] != hit_x[here[:-1]]) | (hit_y[here[1:]] != hit_y[here[:-1]])
            here = here[new]
            columns = (point[p[here]], (d[here] + 1).astype(np.int32), hit_x[here], hit_y[here])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["point_id", "direction_id", "hit_x", "hit_y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fan, fan_of, now, parts = [], None, None, []
        for batch in batches:
            share, tx, ty = (batch.column(c).fill_null(0).to_numpy() for c in ("share", "tx", "ty"))
            is_coast = batch.column("tx").is_valid().to_numpy(zero_copy_only=False)
            new = np.ones(batch.num_rows + 1, bool)
            new[1:-1] = (share[1:] != share[:-1]) | (is_coast[1:] != is_coast[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])
            edges = np.flatnonzero(new).tolist() if batch.num_rows else []
            for a, b in zip(edges, edges[1:], strict=False):
                key = (share[a], tx[a], ty[a]) if is_coast[a] else None
                if parts and key != now:
                    yield from hits_of(fan if fan_of == now[0] else [], now, parts)
                    parts = []
                now, part = key, batch.slice(a, b - a)
                if is_coast[a]:
                    parts.append(np.array([part.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")]))
                    continue
                if fan_of != share[a]:
                    fan, fan_of = [], share[a]
                fan += [_fan(r) for r in part.select(["point_id", "start_x", "start_y", "i", "end_x", "end_y"]).to_pylist()]
        if parts:
            yield from hits_of(fan if fan_of == now[0] else [], now, parts)

    return rows.mapInArrow(run, "point_id long, direction_id int, hit_x double, hit_y double")


def _to_millimetres(v: np.ndarray) -> np.ndarray:
    """Like round(v, 3) in Spark: halves of the shortest decimal number go away from zero."""
    scaled = np.abs(v) * 1000.0
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = int(Decimal(repr(float(abs(v[i])))).scaleb(3).to_integral_value(ROUND_HALF_UP))
    return np.where(v < 0, -out, out) / 1000.0 + 0.0


def _fan(row: dict) -> tuple:
    """A point's place and the ends of its rays by direction_id - 1, NaN where none is traced."""
    end_x, end_y = np.full(360, np.nan), np.full(360, np.nan)
    i = np.array(row["i"], np.int64) - 1
    end_x[i], end_y[i] = row["end_x"], row["end_y"]
    return row["point_id"], row["start_x"], row["start_y"], end_x, end_y


def _fan_hits(x: np.ndarray, y: np.ndarray, end_x: np.ndarray, end_y: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, margin: float, azimuths: np.ndarray | None = None, within: float = np.inf) -> tuple[np.ndarray, ...]:
    """Which point, ray, hit_x, hit_y of every crossing of the points' rays and segments, by the formulas of _crossing().

    end_x, end_y: a row a point and a column a ray, NaN where none is traced. azimuths: of the columns, rising, from 0 to below
    360; all whole degrees if it is None. Segments that lie farther than within from a point are not looked at.
    """
    rays = end_x.shape[1]
    dx0, dy0, dx1, dy1 = ((c - at[:, None]).ravel() for c, at in ((x0, x), (y0, y), (x1, x), (y1, y)))
    near_x, near_y = (np.maximum(np.maximum(np.minimum(a, b), -np.maximum(a, b)), 0.0) for a, b in ((dx0, dx1), (dy0, dy1)))
    held = np.flatnonzero(near_x * near_x + near_y * near_y <= within * within)
    dx0, dy0, dx1, dy1 = dx0[held], dy0[held], dx1[held], dy1[held]
    a = np.degrees(np.arctan2(dx0, dy0))
    turn = (np.degrees(np.arctan2(dx1, dy1)) - a + 180.0) % 360.0 - 180.0
    near = (np.abs(turn) > 179.9) | (np.maximum(np.abs(dx0), np.abs(dy0)) < 1.0) | (np.maximum(np.abs(dx1), np.abs(dy1)) < 1.0)
    if azimuths is None:
        low = np.ceil(a + np.minimum(turn, 0.0) - margin).astype(np.int64)
        n = np.maximum(np.floor(a + np.maximum(turn, 0.0) + margin).astype(np.int64) - low + 1, 0)
        low %= rays
    else:
        begin, round_twice = (a + np.minimum(turn, 0.0) - margin) % 360.0, np.concatenate([azimuths, azimuths + 360.0])
        low = np.searchsorted(round_twice, begin)
        n = np.searchsorted(round_twice, begin + np.abs(turn) + 2 * margin, side="right") - low
    low[near], n[near] = 0, rays  # seen all round, or too near to tell
    traced = np.zeros((len(x), 2 * rays + 1), np.int64)
    np.cumsum(np.tile(~np.isnan(end_x), 2), axis=1, out=traced[:, 1:])
    p = held // max(len(x0), 1)
    n[traced[p, low + n] == traced[p, low]] = 0
    pair = np.repeat(np.arange(len(n)), n)
    d = (np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + low[pair]) % rays
    p = p[pair]
    sea = np.flatnonzero(~np.isnan(end_x[p, d]))
    pair, d, p = pair[sea], d[sea], p[sea]
    s = held[pair] - p * len(x0)
    rx, ry, qx, qy = end_x[p, d] - x[p], end_y[p, d] - y[p], dx0[pair], dy0[pair]
    sx, sy = x1[s] - x0[s], y1[s] - y0[s]
    cross, off = rx * sy - ry * sx, qx * ry - qy * rx
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (qx * sy - qy * sx) / cross, off / cross
        ok = np.flatnonzero((np.abs(cross) >= 1e-9) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    found, shares = [ok], [t[ok]]
    line = np.flatnonzero((np.abs(cross) < 1e-9) & (np.abs(off) <= 1e-6 * np.hypot(rx, ry)))
    if len(line):
        length2 = rx[line] * rx[line] + ry[line] * ry[line]
        t0 = (qx[line] * rx[line] + qy[line] * ry[line]) / length2
        t1 = ((qx[line] + sx[line]) * rx[line] + (qy[line] + sy[line]) * ry[line]) / length2
        for v, some in ((t0, True), (t1, True), (np.zeros(len(line)), t0 * t1 < 0), (np.ones(len(line)), (t0 - 1) * (t1 - 1) < 0)):
            i = np.flatnonzero((v >= 0) & (v <= 1) & some)
            found.append(line[i])
            shares.append(v[i])
    i, share = np.concatenate(found), np.concatenate(shares)
    return p[i], d[i], x[p[i]] + share * rx[i], y[p[i]] + share * ry[i]


#: Points with open rays in one task's share of a tile, at least and at most (15 KB each in the task), and shares that a core
#: gets if all points lie in one tile. Pairs of points and segments that are not worth another shell.
SHELL_POINTS, MOST_SHELL_POINTS, CORE_SHARES, SHELL_PAIRS = 32, 2_048, 4, 50_000_000
#: Segments in one row on their way to a tile's shares, about, and rows of them that are looked at together.
SHELL_ROW, SHELL_ROWS = 250, 40
#: Segments within the first shell of a point where coast is dense, about; how many times as deep each shell is as the one before.
NEAR_SEGMENTS, DEEPER = 100, 4.0


def _first_depth(coast: DataFrame, cell: float = CELL_M) -> float:
    """How far rays go at first: about NEAR_SEGMENTS lie within that of a point, at the density that segments themselves see."""
    of = lambda c: F.floor((F.col(f"{c}0") + F.col(f"{c}1")) / 2 / cell)
    n = F.col("n").cast("double")
    dense = coast.groupBy(of("x").alias("cx"), of("y").alias("cy")).agg(F.count("*").alias("n")).agg(F.sum(n * n) / F.sum(n)).first()[0]
    return cell * float(np.sqrt(NEAR_SEGMENTS / np.pi / dense)) if dense else float("inf")


def shell_hits(fans: DataFrame, coast: DataFrame, azimuths: list[float], far_m: float, *, ray_m: float = MAX_M, precision: float = PRECISION_M, exclusion_m: float = EXCLUSION_M, tile: float | None = None, of_points: int = 0) -> DataFrame:
    """row, open, and of the rays that hit up to far_m from their start: i, hit_x, hit_y, arrays of the first hits.

    fans: row, a point with x, y, start_x, start_y, and open, the numbers (from 0) in azimuths of its rays that are traced;
    coast: x0, y0, x1, y1. A point meets each segment of its surroundings once, whatever its rays, and stays one row; a tile
    of many points is dealt into shares, and its coast comes to each in rows of many segments. Shares hold more points where
    there are more (of_points, all of them), so copies of the coast stay few. Hits within the exclusion of the source or of the start do not count.
    """
    share_points = min(MOST_SHELL_POINTS, max(SHELL_POINTS, -(-of_points // (CORE_SHARES * fans.sparkSession.sparkContext.defaultParallelism))))
    tile = tile or 2 * far_m
    of = lambda c: F.coalesce(F.floor(F.col(f"row.{c}") / tile).cast("long"), F.lit(0).cast("long"))
    placed = fans.select(of("start_x").alias("cx"), of("start_y").alias("cy"), "row", "open")
    shares = placed.groupBy("cx", "cy").agg(F.ceil(F.count("*") / share_points).cast("long").alias("shares"))
    seen = ray_cells(coast, tile, ("x0", "y0", "x1", "y1"), far_m + 1.0).join(shares, ["cx", "cy"])
    parts = seen.groupBy("cx", "cy").agg(F.ceil(F.count("*") / SHELL_ROW).alias("parts"))
    part = F.pmod(F.xxhash64("x0", "y0", "x1", "y1"), "parts").alias("part")
    held = seen.join(parts, ["cx", "cy"]).groupBy("cx", "cy", "shares", part).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("coast"))
    sent = held.select("cx", "cy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "coast")
    points = placed.join(shares, ["cx", "cy"]).withColumn("share", F.pmod(F.xxhash64("row"), "shares")).drop("shares")
    rows = dealt(points.unionByName(sent, allowMissingColumns=True), "cx", "cy", "share").sortWithinPartitions("cx", "cy", "share", F.col("coast").isNotNull())
    numbered = F.array(*[F.lit(float(a)) for a in azimuths])
    source = rows.select("cx", "cy", "share", "coast", "row", "open", *[F.col(f"row.{c}").cast("double").alias(c) for c in ("x", "y", "start_x", "start_y")])
    ends = F.transform("open", lambda i: F.struct(*[e.alias(c) for e, c in zip(_ray_end(numbered[i], ray_m, precision), ("x", "y"), strict=True)]))
    # computed behind the shuffle, which so moves a point's numbers only
    given = source.withColumn("ends", ends).select(*source.columns, F.col("ends.x").alias("end_x"), F.col("ends.y").alias("end_y"))
    around = np.array(azimuths, float) % 360.0
    order = np.argsort(around, kind="stable")
    column = np.argsort(order, kind="stable")  # of each ray by its number
    degrees = None if len(around) == 360 and (around[order] == np.arange(360)).all() else around[order]
    margin = 1e-4 + np.degrees(precision / ray_m)

    def met(fan: dict, coast: list[np.ndarray]) -> None:
        """Takes the first hits with some segments into the fan's best ones, chunk by chunk of its points."""
        n, step = fan["x"].size, max(1, FAN_PAIRS // coast[0].size)
        for k in range(0, n, step):
            x, y, start_x, start_y, end_x, end_y = (fan[c][k : k + step] for c in ("x", "y", "start_x", "start_y", "end_x", "end_y"))
            p, r, hit_x, hit_y = _fan_hits(start_x, start_y, end_x, end_y, *coast, margin, degrees, far_m + 1.0)
            away = lambda a, b: np.sqrt((hit_x - a[p]) ** 2 + (hit_y - b[p]) ** 2)  # noqa: B023, E731
            d = away(start_x, start_y)
            ok = np.flatnonzero((d > exclusion_m) & (d <= far_m) & (away(x, y) > exclusion_m))
            p, r, d, hit_x, hit_y = p[ok] + k, r[ok], d[ok], hit_x[ok], hit_y[ok]
            ray = p * len(around) + r
            first = np.lexsort((hit_y, hit_x, d, ray))
            first = first[np.append(True, ray[first[1:]] != ray[first[:-1]])] if len(first) else first
            ray, d, hit_x, hit_y = ray[first], d[first], hit_x[first], hit_y[first]
            was, was_x, was_y = (fan[c].ravel()[ray] for c in ("d", "hit_x", "hit_y"))
            nearer = np.flatnonzero((d < was) | ((d == was) & ((hit_x < was_x) | ((hit_x == was_x) & (hit_y < was_y)))))
            for c, v in (("d", d), ("hit_x", hit_x), ("hit_y", hit_y)):
                fan[c].ravel()[ray[nearer]] = v[nearer]

    def opened(parts: list[pa.RecordBatch]) -> dict:
        fan = {c: np.concatenate([b.column(c).fill_null(np.nan).to_numpy() for b in parts]) for c in ("x", "y", "start_x", "start_y")}
        shape = (fan["x"].size, len(around))
        fan |= {c: np.full(shape, v) for c, v in (("end_x", np.nan), ("end_y", np.nan), ("d", np.inf), ("hit_x", np.nan), ("hit_y", np.nan))}
        flat = lambda c: np.concatenate([b.column(c).flatten().fill_null(np.nan if c != "open" else 0).to_numpy() for b in parts])
        sizes = np.concatenate([b.column("open").value_lengths().to_numpy() for b in parts])
        fan["p"], fan["i"], fan["rows"] = np.repeat(np.arange(shape[0]), sizes), flat("open"), pa.concat_arrays([b.column("row") for b in parts])
        at = (fan["p"], column[fan["i"]])
        fan["end_x"][at], fan["end_y"][at] = flat("end_x"), flat("end_y")
        return fan

    def closed(fan: dict) -> pa.RecordBatch:
        at = (fan["p"], column[fan["i"]])
        hit = np.isfinite(fan["d"][at])
        lists = lambda of, v: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(fan["p"][of], minlength=fan["x"].size))).astype(np.int32)), pa.array(v[of]))
        i = fan["i"].astype(np.int32)
        columns = [fan["rows"], lists(~hit, i), lists(hit, i), *[lists(hit, fan[c][at]) for c in ("hit_x", "hit_y")]]
        return pa.RecordBatch.from_arrays(columns, names=["row", "open", "i", "hit_x", "hit_y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, fan = None, [], None  # a share of a tile; its points as they come, and together once its coast begins
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("cx", "cy", "share")]
            is_coast = batch.column("coast").is_valid().to_numpy(zero_copy_only=False)
            new = np.any([k[1:] != k[:-1] for k in (*keys, is_coast)], axis=0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                key, part = tuple(int(k[a]) for k in keys), batch.slice(a, b - a)
                if key != now:
                    if fan or parts:
                        yield closed(fan or opened(parts))
                    now, parts, fan = key, [], None
                if is_coast[a]:
                    fan = fan or opened(parts)
                    for k in range(0, part.num_rows, SHELL_ROWS):
                        segments = part.column("coast").slice(k, SHELL_ROWS).flatten()
                        met(fan, [segments.field(c).to_numpy() for c in range(4)])
                else:
                    parts.append(part)
        if fan or parts:
            yield closed(fan or opened(parts))

    kind = fans.schema["row"].dataType.simpleString()
    return given.mapInArrow(run, f"row {kind}, open array<int>, i array<int>, hit_x array<double>, hit_y array<double>")


def _shells(points: DataFrame, segments: DataFrame, azimuths: list[float], *, offset_m: float, max_m: float, exclusion_m: float, edge: str, cell: float | None, first_m: float | None) -> tuple[list[DataFrame], DataFrame]:
    """What trace_fetch() writes: row, open, i, hit_x, hit_y of each shell; row and open of the points with rays that hit nothing."""
    starts = shifted_starts(points, offset_m)
    coast = written(segments.select(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).dropna().distinct(), "coast")
    fans = starts.select(F.struct(*starts.columns).alias("row"), F.filter(_numbers(azimuths), lambda i: ~_to_land(azimuths, edge)(i)).alias("open"))
    far, done, of_coast, of_points = _first_depth(coast) if first_m is None else first_m, [], coast.count(), fans.count()
    while True:
        last = far >= max_m or (first_m is None and of_points * of_coast <= SHELL_PAIRS)
        done.append(written(shell_hits(fans, coast, azimuths, 2 * max_m if last else far, ray_m=max_m, exclusion_m=exclusion_m, tile=cell, of_points=of_points), "fetch-shell"))
        fans = done[-1].where(F.size("open") > 0).select("row", "open")
        if last or not (of_points := fans.count()):
            return done, fans
        far *= DEEPER


def _numbers(azimuths: list[float]) -> Column:
    return F.sequence(F.lit(0), F.lit(len(azimuths) - 1))


def _to_land(azimuths: list[float], edge: str) -> Callable[[Column], Column]:
    numbered = F.array(*[F.lit(a) for a in azimuths])
    return lambda i: in_land_sector(numbered[i], "normal_azimuth_deg", edge)


def _away(hit_x: Column, hit_y: Column, start_x: Column, start_y: Column) -> Column:
    """The fetch of a ray, with the steps in which numpy compared it."""
    return F.sqrt((hit_x - start_x) * (hit_x - start_x) + (hit_y - start_y) * (hit_y - start_y))


def _ray_rows(rows: DataFrame, azimuths: list[float], length: Column, hit_x: Column | None = None, hit_y: Column | None = None, land: bool = False) -> DataFrame:
    """Rows of trace_fetch() from row (a point with its start) and i (the number of a ray)."""
    none, hit = F.lit(None).cast("double"), hit_x is not None
    ray = [*[F.col(f"row.{c}").alias(c) for c in rows.schema["row"].dataType.names], F.array(*[F.lit(a) for a in azimuths])[F.col("i")].alias("azimuth_deg"), (F.col("i") + 1).alias("direction_id")]
    found = [F.lit(hit).alias("hit_found"), (hit_x if hit else none).alias("hit_x"), (hit_y if hit else none).alias("hit_y"), F.lit(not hit).alias("used_default_value")]
    return rows.select(*ray, length.alias("fetch_length_m"), *found, F.lit(land).alias("skipped_by_land_sector"))


def land_fetch(points: DataFrame, azimuths: range | list = range(360), *, offset_m: float = OFFSET_M, edge: str = "half_open") -> DataFrame:
    """The rows of trace_fetch() whose rays point to land: they are not traced, so no coast is needed for them."""
    azimuths = [float(a) for a in azimuths]
    starts = shifted_starts(points, offset_m)
    land = starts.select(F.struct(*starts.columns).alias("row"), F.explode(F.filter(_numbers(azimuths), _to_land(azimuths, edge))).alias("i"))
    return _ray_rows(land, azimuths, F.lit(float(offset_m)), land=True)


def trace_fetch(points: DataFrame, segments: DataFrame, azimuths: range | list = range(360), *, offset_m: float = OFFSET_M, max_m: float = MAX_M, exclusion_m: float = EXCLUSION_M, edge: str = "half_open", cell: float | None = None, first_m: float | None = None) -> DataFrame:
    """A row per point and azimuth. points: point_id, x, y, normal_azimuth_deg; segments: x0, y0, x1, y1 (metres).

    Rays into the land sector are not traced: their fetch is the offset. The others advance from shell to shell, first_m deep
    (by the density of the coast if it is None) and then each time four times as deep; one that has hit leaves, and with its
    last ray its point, so what lies behind is not looked up. Once few points are left they meet all segments at once. Each
    shell is a written table of a row a point. cell: side of the tiles in which points and coast meet, twice a shell's depth if it is
    None. max_m may lie a little beyond what precision leaves of a ray's length.
    """
    azimuths = [float(a) for a in azimuths]
    done, left = _shells(points, segments, azimuths, offset_m=offset_m, max_m=max_m, exclusion_m=exclusion_m, edge=edge, cell=cell, first_m=first_m)
    traced = _ray_rows(left.select("row", F.explode("open").alias("i")), azimuths, F.lit(float(max_m)))
    for shell in done:
        hit = shell.select("row", F.inline(F.arrays_zip("i", "hit_x", "hit_y")))
        length = _away(F.col("hit_x"), F.col("hit_y"), F.col("row.start_x"), F.col("row.start_y"))
        traced = traced.unionByName(_ray_rows(hit, azimuths, length, F.col("hit_x"), F.col("hit_y")))
    return traced.unionByName(land_fetch(points, azimuths, offset_m=offset_m, edge=edge))


LONG = ("point_id", "direction_id", "normal_azimuth_deg", "azimuth_deg", "x", "y", "start_x", "start_y", "fetch_length_m", "hit_found", "hit_x", "hit_y", "used_default_value", "skipped_by_land_sector")


def long_frame(traced: DataFrame) -> DataFrame:
    return traced.select(*LONG)


def fetch_by_point(points: DataFrame, segments: DataFrame, azimuths: range | list = range(360), *, offset_m: float = OFFSET_M, max_m: float = MAX_M, exclusion_m: float = EXCLUSION_M, edge: str = "half_open", digits: int | None = None) -> DataFrame:
    """trace_fetch() as a row per point with JSON arrays in the order of azimuths; hits that are missing stay as nulls. digits: of metres.

    A point is gathered from its row in each shell: of a ray only its number and its hit move, and its number alone if it hits nothing.
    """
    azimuths = [float(a) for a in azimuths]
    numbered = F.array(*[F.lit(a) for a in azimuths])
    metres = lambda c: c if digits is None else F.round(c, digits)
    done, left = _shells(points, segments, azimuths, offset_m=offset_m, max_m=max_m, exclusion_m=exclusion_m, edge=edge, cell=None, first_m=None)
    starts = shifted_starts(points, offset_m)
    names = ("point_id", "normal_azimuth_deg", "x", "y", "start_x", "start_y")
    key = [f"k_{c}" for c in names]
    keyed = lambda at: [(metres(F.col(f"{at}{c}")) if c in names[2:] else F.col(f"{at}{c}")).alias(f"k_{c}") for c in names]
    length = lambda at: F.transform(F.arrays_zip("hit_x", "hit_y"), lambda h: metres(_away(h["hit_x"], h["hit_y"], F.col(f"{at}start_x"), F.col(f"{at}start_y"))))
    rounded = lambda c: c if digits is None else F.transform(c, lambda v: F.round(v, digits))
    rows = starts.select(*keyed(""), F.filter(_numbers(azimuths), _to_land(azimuths, edge)).alias("land")).unionByName(left.select(*keyed("row."), F.col("open").alias("missed")), allowMissingColumns=True)
    for shell in done:
        rows = rows.unionByName(shell.where(F.size("i") > 0).select(*keyed("row."), "i", length("row.").alias("d"), rounded("hit_x").alias("hit_x"), rounded("hit_y").alias("hit_y")), allowMissingColumns=True)
    lists = ("missed", "land", "i", "d", "hit_x", "hit_y")
    held = rows.groupBy(*key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])

    def ray(i: Column, d: Column, x: Column, y: Column, land: bool) -> Column:
        return F.struct(numbered[i].alias("azimuth_deg"), (i + 1).alias("direction_id"), d.alias("fetch_length_m"), x.isNotNull().alias("hit_found"), x.isNull().alias("used_default_value"), F.lit(land).alias("skipped_by_land_sector"), x.alias("hit_x"), y.alias("hit_y"))

    none = F.lit(None).cast("double")
    hits = F.transform(F.arrays_zip("i", "d", "hit_x", "hit_y"), lambda h: ray(h["i"], h["d"], h["hit_x"], h["hit_y"], False))
    each = F.concat(hits, F.transform("missed", lambda i: ray(i, F.lit(float(max_m)), none, none, False)), F.transform("land", lambda i: ray(i, F.lit(float(offset_m)), none, none, True)))
    held = held.select(*[F.col(f"k_{c}").alias(c) for c in names], F.array_sort(each).alias("a"))
    json = {"azimuth_deg": "azimuths_deg", "fetch_length_m": "fetch_lengths_m", "hit_found": "hit_found_list", "used_default_value": "used_default_value_list", "skipped_by_land_sector": "skipped_by_land_sector_list", "hit_x": "hit_xs", "hit_y": "hit_ys"}
    return held.select(*names, *[F.to_json(F.col(f"a.{f}"), {"ignoreNullFields": "false"}).alias(n) for f, n in json.items()])


def split_by_direction(traced: DataFrame, offset_m: float = OFFSET_M) -> DataFrame:
    """long_frame() with the rows of a direction together. What follows from other columns of a row is computed behind the shuffle."""
    moved = ("point_id", "direction_id", "normal_azimuth_deg", "azimuth_deg", "x", "y", "fetch_length_m", "hit_x", "hit_y", "skipped_by_land_sector")
    rows = shifted_starts(traced.select(*moved).repartition("azimuth_deg"), offset_m)
    return long_frame(rows.withColumns({"hit_found": F.col("hit_x").isNotNull(), "used_default_value": F.col("hit_x").isNull()}))


def source_points(traced: DataFrame) -> DataFrame:
    return traced.select("point_id", "x", "y").dropDuplicates(["point_id"])


def offset_segments(traced: DataFrame) -> DataFrame:
    return traced.select("point_id", "x", "y", "start_x", "start_y").distinct()


def hit_points(traced: DataFrame) -> DataFrame:
    return traced.where(F.col("hit_found") & F.col("hit_x").isNotNull() & F.col("hit_y").isNotNull())


def ray_layer(traced: DataFrame) -> DataFrame:
    """Rays with their ends: the hit, or the whole fetch along the azimuth."""
    return traced.select(
        "point_id", "direction_id", "start_x", "start_y", F.coalesce("hit_x", F.col("start_x") + offset_x("azimuth_deg", F.col("fetch_length_m"))).alias("end_x"),
        F.coalesce("hit_y", F.col("start_y") + offset_y("azimuth_deg", F.col("fetch_length_m"))).alias("end_y"),
    )


def _geodesic_rays(points: DataFrame, azimuths: list) -> DataFrame:
    every = F.posexplode(F.array(*[F.lit(float(a)) for a in azimuths])).alias("direction_id", "azimuth_deg")
    return points.select("point_id", F.col("normal_azimuth_deg").cast("double").alias("normal_azimuth_deg"), F.col("lon").cast("double").alias("lon0"), F.col("lat").cast("double").alias("lat0"), every)


def _track(rays: DataFrame, step_m: float, steps: int, offset_m: float) -> DataFrame:
    """The steps of rays; each task walks a share of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                held = batch.iloc[at : at + 1000]
                azimuth = held["azimuth_deg"].to_numpy()
                track = [direct(held["lon0"].to_numpy(), held["lat0"].to_numpy(), azimuth, offset_m)]
                for _ in range(steps):
                    track.append(direct(*track[-1], azimuth, step_m))
                lon, lat = np.array(track).transpose(1, 2, 0)
                out = held.loc[held.index.repeat(steps)].assign(i=np.tile(np.arange(steps), len(held)))
                yield out.assign(start_x=lon[:, :-1].ravel(), start_y=lat[:, :-1].ravel(), end_x=lon[:, 1:].ravel(), end_y=lat[:, 1:].ravel())

    kept = ", ".join(f"{n} {t}" for n, t in rays.dtypes)
    return dealt(rays, "point_id", "direction_id").mapInPandas(run, f"{kept}, i int, start_x double, start_y double, end_x double, end_y double")


def geodesic_steps(points: DataFrame, azimuths: list, step_m: float = 1000.0, steps: int = 200, offset_m: float = 1.0, only: DataFrame | None = None) -> DataFrame:
    """point_id, direction_id (from 0), azimuth_deg, normal_azimuth_deg, lon0, lat0, i, start_x, start_y, end_x, end_y: the steps of geodesic rays.

    The first step begins offset_m from the point along the ray; each step sets out at the ray's azimuth again. only:
    point_id and direction_id of the rays that are walked, all if it is None.
    """
    rays = _geodesic_rays(points, azimuths)
    if only is not None:
        rays = rays.join(only.select("point_id", "direction_id").hint("merge"), ["point_id", "direction_id"], "left_semi")
    return _track(rays, step_m, steps, offset_m)


#: Ends of the near stretches of a geodesic ray, in steps, and the share of a cell's width in which each is looked up.
NEAR_STEPS = ((1, 0.125), (5, 0.5))


def geodesic_fetch(points: DataFrame, coast: DataFrame, azimuths: list, step_m: float = 1000.0, steps: int = 200, offset_m: float = 1.0, land_sector: bool = True, cell: float = 0.02) -> DataFrame:
    """point_id, direction_id, azimuth_deg, fetch_m, hit_found, skipped_by_land_sector; coast has x0, y0, x1, y1 in degrees.

    fetch_m is the geodesic distance from the point to the first crossing of the ray's steps with the coast, or the
    whole length. Rays into the land sector (both edges included) are not traced: their fetch is the offset. Without
    land_sector all are traced. Rays advance by NEAR_STEPS, then at once to the end; one that has hit leaves, so what
    lies behind is not looked up. Where coast is dense nearly all hit in the first step, which meets small cells.
    """
    land = in_land_sector("azimuth_deg", "normal_azimuth_deg", "closed") if land_sector else F.lit(False)
    every = F.posexplode(F.array(*[F.lit(float(a)) for a in azimuths])).alias("direction_id", "azimuth_deg")
    rays = points.select("point_id", "normal_azimuth_deg", every).withColumn("skipped_by_land_sector", land)
    ends, of_ray = ("start_x", "start_y", "end_x", "end_y"), ["point_id", "direction_id", "lon0", "lat0"]
    scaled_coast = coast.select(*[(F.col(c) * DEGREE_M).alias(c) for c in ("x0", "y0", "x1", "y1")])

    def first_hits(track: DataFrame, cell: float) -> DataFrame:
        # hits() has its tolerances in metres; Spark takes the steps for as few rows as the points, and would broadcast them
        scaled = track.withColumns({c: F.col(c) * DEGREE_M for c in ends}).hint("merge")
        found = hits(scaled, scaled_coast, cell * DEGREE_M, (*of_ray, "i", "start_x", "start_y"))
        away = F.hypot(F.col("hit_x") - F.col("start_x"), F.col("hit_y") - F.col("start_y"))
        first = found.groupBy(*of_ray).agg(F.min(F.struct("i", away.alias("away"), "hit_x", "hit_y")).alias("hit"))
        return first.select(*of_ray, (F.col("hit.hit_x") / DEGREE_M).alias("lon1"), (F.col("hit.hit_y") / DEGREE_M).alias("lat1"))

    left, done, begin = _geodesic_rays(points, azimuths).where(~land), [], 0
    for end, share in NEAR_STEPS:
        if end >= steps:
            break
        done.append(written(first_hits(_track(left, step_m, end, offset_m).where(F.col("i") >= begin), cell * share), "geodesic-hits"))
        left, begin = written(left.join(done[-1].select(*of_ray).hint("merge"), of_ray, "left_anti"), "geodesic-rays"), end
    first = first_hits(geodesic_steps(points, azimuths, step_m, steps, offset_m, left).where(F.col("i") >= begin), cell)
    for near in done:
        first = first.unionByName(near)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["point_id", "direction_id"]].assign(hit_m=distance(*(b[c].to_numpy() for c in ("lon0", "lat0", "lon1", "lat1"))))

    kinds = dict(rays.dtypes)
    far = first.mapInPandas(measured, f"point_id {kinds['point_id']}, direction_id int, hit_m double")
    length = F.when(F.col("skipped_by_land_sector"), F.lit(float(offset_m))).otherwise(F.coalesce("hit_m", F.lit(float(steps * step_m))))
    return rays.join(far.hint("merge"), ["point_id", "direction_id"], "left").select("point_id", "direction_id", "azimuth_deg", length.alias("fetch_m"), F.col("hit_m").isNotNull().alias("hit_found"), "skipped_by_land_sector")
