"""Depth rasters in tiles, and what transects meet in them.

A transect of some hundred samples is cut into pieces, one for each tile that it passes; a piece and its tile meet in one
task, where the samples are interpolated and summed up. So a transect costs a row for each of a few tiles, not four grid
rows a sample, and no sample leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import sphere_direct, sphere_steps
from ..shared import written

#: Pieces in one task's share of a tile: a tile that more of them pass is sent to several tasks.
SHARE = 20_000
#: Margin in degrees by which origins outside the raster are moved into it.
MARGIN = 1e-4


@dataclass(frozen=True)
class Frame:
    """Where a raster's nodes lie: node (ix, iy) at west + ix * step, south + iy * step."""

    west: float
    south: float
    step: float
    nx: int
    ny: int
    tile: int = 32

    @property
    def east(self) -> float:
        return self.west + self.step * (self.nx - 1)

    @property
    def north(self) -> float:
        return self.south + self.step * (self.ny - 1)


def raster_tiles(nodes: DataFrame, frame: Frame) -> DataFrame:
    """tx, ty, z: the values of tile * tile cells, row by row, with one more row and column of nodes (a halo) above.

    nodes: ix, iy, z; null, NaN or missing nodes are null. Of repeated nodes the smallest value counts.
    """
    t = frame.tile
    of = lambda c: F.when((F.col(c) % t == 0) & (F.col(c) > 0), F.array(F.expr(f"{c} div {t}"), F.expr(f"{c} div {t} - 1"))).otherwise(F.array(F.expr(f"{c} div {t}")))
    given = nodes.where(F.col("z").isNotNull() & ~F.isnan("z")).select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("z").cast("double").alias("z"))
    placed = given.withColumn("tx", F.explode(of("ix"))).withColumn("ty", F.explode(of("iy")))
    at = ((F.col("iy") - F.col("ty") * t) * (t + 1) + F.col("ix") - F.col("tx") * t).cast("int")
    once = placed.groupBy("tx", "ty", at.alias("at")).agg(F.min("z").alias("z"))
    cells = once.groupBy("tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("at", "z"))).alias("m"))
    return cells.select("tx", "ty", F.transform(F.sequence(F.lit(0), F.lit((t + 1) ** 2 - 1)), lambda i: F.col("m")[i]).alias("z"))


def _samples(frame: Frame, lon: np.ndarray, lat: np.ndarray, azimuth: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, ...]:
    """Grid coordinates of samples, one row a transect, and whether each lies in the raster."""
    x, y = sphere_direct(lon[:, None], lat[:, None], azimuth[:, None], distances[None, :])
    fx, fy = (x - frame.west) / frame.step, (y - frame.south) / frame.step
    return fx, fy, (fx >= 0) & (fx <= frame.nx - 1) & (fy >= 0) & (fy <= frame.ny - 1)


def transect_pieces(rays: DataFrame, frame: Frame, radius_m: float, samples: int) -> DataFrame:
    """point_id, direction, lon, lat, tx, ty, first, last, outside: the steps of each transect in each tile.

    rays: point_id, direction, lon, lat. Where a transect is beyond the raster, outside is true and the tile -1.
    """
    distances = np.arange(samples) * (radius_m / (samples - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2000):
                b = batch.iloc[start : start + 2000]
                fx, fy, inside = _samples(frame, *(b[c].to_numpy(float) for c in ("lon", "lat", "direction")), distances)
                tx = np.where(inside, np.minimum(fx, frame.nx - 2).astype(np.int64) // frame.tile, -1)
                ty = np.where(inside, np.minimum(fy, frame.ny - 2).astype(np.int64) // frame.tile, -1)
                new = np.ones(tx.shape, bool)
                new[:, 1:] = (tx[:, 1:] != tx[:, :-1]) | (ty[:, 1:] != ty[:, :-1])
                ray, first = np.nonzero(new)
                last = np.append(first[1:], 0) - 1
                last[np.append(ray[1:] != ray[:-1], True)] = samples - 1
                out = b.iloc[ray].assign(tx=tx[ray, first], ty=ty[ray, first], first=first, last=last, outside=~inside[ray, first])
                yield out

    kinds = dict(rays.dtypes)
    schema = f"point_id {kinds['point_id']}, direction {kinds['direction']}, lon double, lat double, tx long, ty long, first int, last int, outside boolean"
    return rays.select("point_id", "direction", "lon", "lat").mapInPandas(run, schema)


_SCALARS = [("h_min", pa.float64()), ("h_max", pa.float64()), ("h_first", pa.float64()), ("valid_step", pa.int32()), ("first_valid", pa.float64())]


def transect_scalars(rays: DataFrame, tiles: DataFrame, frame: Frame, *, radius_m: float = 20_000.0, samples: int = 200, sign_policy: str = "negate_land_null", share: int = SHARE) -> DataFrame:
    """point_id, direction, outside, h_min, h_max, h_first, first_valid of each transect: profile_scalars() without profiles.

    rays: point_id, direction, lon, lat, distinct; tiles: raster_tiles() of the same frame. Origins beyond the raster are
    moved to its edge. outside: a sample lies beyond the raster. Depths are interpolated between the four nodes around; a
    missing node gives none. The transects are cut once, when this is called, into a written table. Samples are equally spaced on the sphere; those on the ellipsoid lie within half a metre of them.
    """
    kept = lambda c, low, high: F.greatest(F.least(F.col(c), F.lit(high - MARGIN)), F.lit(low + MARGIN))
    inside = rays.withColumns({"lon": kept("lon", frame.west, frame.east), "lat": kept("lat", frame.south, frame.north)})
    pieces = written(transect_pieces(inside, frame, radius_m, samples), "transect-pieces")  # they are read three times below
    met = pieces.where("not outside").drop("outside")
    shares = met.groupBy("tx", "ty").agg(F.ceil(F.count("*") / share).alias("shares"))
    dealt = met.join(shares, ["tx", "ty"]).withColumn("share", F.pmod(F.xxhash64("point_id", "direction"), "shares")).drop("shares")
    sent = tiles.join(shares, ["tx", "ty"]).select("tx", "ty", "z", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    kinds = dict(rays.dtypes)
    rows = dealt.select("tx", "ty", "share", F.lit(None).cast("array<double>").alias("z"), "point_id", "direction", "lon", "lat", "first", "last").unionByName(sent, allowMissingColumns=True)
    ordered = rows.repartition("tx", "ty", "share").sortWithinPartitions("tx", "ty", "share", F.col("z").isNull())
    distances = np.arange(samples) * (radius_m / (samples - 1))
    t = frame.tile

    def signed(z: np.ndarray) -> np.ndarray:
        return {"raw": z, "abs": np.abs(z), "negate_land_null": np.where(z < 0, -z, np.nan)}[sign_policy]

    def one_tile(tile: tuple[int, int], z: np.ndarray, b: pd.DataFrame) -> pd.DataFrame:
        """The scalars of a tile's pieces; samples of all of them lie in one flat array."""
        n = (b["last"] - b["first"]).to_numpy(np.int64) + 1
        piece = np.repeat(np.arange(len(b)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + b["first"].to_numpy(np.int64)[piece]
        x, y = sphere_steps(*(b[c].to_numpy(float) for c in ("lon", "lat", "direction")), distances, piece, step)
        fx, fy = (x - frame.west) / frame.step, (y - frame.south) / frame.step
        ix, iy = np.minimum(np.floor(fx), frame.nx - 2), np.minimum(np.floor(fy), frame.ny - 2)
        wx, wy = fx - ix, fy - iy
        at = ((iy - tile[1] * t) * (t + 1) + ix - tile[0] * t).astype(np.int64)
        h = signed((1 - wx) * (1 - wy) * z[at] + wx * (1 - wy) * z[at + 1] + (1 - wx) * wy * z[at + t + 1] + wx * wy * z[at + t + 2])
        valid = np.isfinite(h) & (h > 0)
        starts = np.cumsum(n) - n
        low, high = np.minimum.reduceat(np.where(valid, h, np.inf), starts), np.maximum.reduceat(np.where(valid, h, -np.inf), starts)
        place = np.minimum.reduceat(np.where(valid, np.arange(len(h)), len(h)), starts)
        some = place < len(h)
        held = np.minimum(place, len(h) - 1)
        first = np.where(step[starts] == 0, h[starts], np.nan)
        return pd.DataFrame({
            "point_id": b["point_id"].to_numpy(), "direction": b["direction"].to_numpy(), "h_min": np.where(some, low, np.nan), "h_max": np.where(some, high, np.nan),
            "h_first": first, "valid_step": pd.array(np.where(some, step[held], -1), "Int32"), "first_valid": np.where(some, h[held], np.nan),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, z = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            frame_rows = batch.to_pandas()
            keys = list(zip(frame_rows["tx"], frame_rows["ty"], strict=True))
            is_tile = frame_rows["z"].notna().to_numpy()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or is_tile[i] or is_tile[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if is_tile[a]:
                    tile, z = keys[a], np.array([np.nan if v is None else v for v in frame_rows["z"].iloc[a]], float)
                    continue
                here = z if tile == keys[a] else np.full((t + 1) ** 2, np.nan)  # a tile without any node
                out = one_tile(keys[a], here, frame_rows.iloc[a:b])
                yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    id_kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([("point_id", id_kinds[kinds["point_id"]]), ("direction", id_kinds[kinds["direction"]]), *_SCALARS])
    ddl = f"point_id {kinds['point_id']}, direction {kinds['direction']}, h_min double, h_max double, h_first double, valid_step int, first_valid double"
    parts = ordered.mapInArrow(run, ddl)
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    gone = pieces.where("outside").select("point_id", "direction", F.lit(True).alias("outside"))
    every = parts.withColumns({c: real(c) for c in ("h_min", "h_max", "h_first", "first_valid")}).withColumn("valid_step", F.when(F.col("valid_step") >= 0, F.col("valid_step")))
    return every.withColumn("outside", F.lit(False)).unionByName(gone, allowMissingColumns=True).groupBy("point_id", "direction").agg(
        F.max("outside").alias("outside"), F.min("h_min").alias("h_min"), F.max("h_max").alias("h_max"), F.max("h_first").alias("h_first"), F.min_by("first_valid", "valid_step").alias("first_valid"),
    )
