"""Noding of linework by snap rounding.

Coordinates are whole numbers of pixels. A pixel is hot if a segment ends or two segments cross in it; every segment then
runs through the centres of all hot pixels that it passes. So two segments that cross get one and the same node, segments
that lie on one another the same pieces, and pieces meet in nodes only. All tests are in whole numbers of 64 bits, so
nothing depends on how a division is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dealing import dealt

PIXEL_M = 0.001
#: Pixels that a segment may be long, so that products of differences fit 64 bits; longer ones should be split before.
MOST = 1 << 29
#: Side of the cells in which segments meet one another, and hot pixels.
CELL = 200_000


def to_pixels(segments: DataFrame, pixel: float = PIXEL_M) -> DataFrame:
    """seg_id, ax, ay, bx, by: segments (seg_id, x0, y0, x1, y1) in pixels; those that are then a point go."""
    at = lambda c: F.floor(F.col(c) / pixel + 0.5).cast("long")
    return segments.select("seg_id", at("x0").alias("ax"), at("y0").alias("ay"), at("x1").alias("bx"), at("y1").alias("by")).where("ax <> bx or ay <> by")


def _met(rows: DataFrame, cell: int) -> DataFrame:
    """rows (ax, ay, bx, by) once for every cell within a pixel of the segment: per column of cells, those between its heights there.

    Heights are computed with fractions, so two pixels more are taken for them. Rows come dealt out by their cells.
    """
    low, high = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    c = lambda v: F.floor(v / cell).cast("long")
    columns = dealt(rows, "seg_id").withColumn("cx", F.explode(F.sequence(c(low("ax", "bx") - 1), c(high("ax", "bx") + 1))))
    slope = F.try_divide((F.col("by") - F.col("ay")).cast("double"), (F.col("bx") - F.col("ax")).cast("double"))
    at = lambda x: F.col("ay") + slope * (x - F.col("ax"))
    left, right = at(F.greatest(F.col("cx") * cell - 1, low("ax", "bx"))), at(F.least((F.col("cx") + 1) * cell + 1, high("ax", "bx")))
    bottom = F.greatest(F.coalesce(F.least(left, right), low("ay", "by")), low("ay", "by")) - 3
    top = F.least(F.coalesce(F.greatest(left, right), high("ay", "by")), high("ay", "by")) + 3
    return dealt(columns.withColumn("cy", F.explode(F.sequence(c(bottom), c(top)))), "cx", "cy")


def crossing_pixels(met: DataFrame, cell: int = CELL) -> DataFrame:
    """px, py, cx, cy of the pixels in which two segments cross, and the cells of these; segments on one line cross at their ends, which are hot.

    met: segments by the cells that they pass. Two that meet in several cells count in that of their crossing alone.
    """
    of = ("ax", "ay", "bx", "by")
    b = met.select(F.col("seg_id").alias("other"), *[F.col(c).alias(f"o{c}") for c in of], "cx", "cy")
    apart = F.lit(False)
    for c in ("x", "y"):
        apart = apart | (F.greatest(f"a{c}", f"b{c}") < F.least(f"oa{c}", f"ob{c}")) | (F.greatest(f"oa{c}", f"ob{c}") < F.least(f"a{c}", f"b{c}"))
    pairs = met.join(b.hint("merge"), ["cx", "cy"]).where(F.col("seg_id") < F.col("other")).where(~apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ax, ay, bx, by, ox, oy, ex, ey, cx, cy = (c.to_numpy() for c in batch.columns)
            rx, ry, sx, sy, qx, qy = bx - ax, by - ay, ex - ox, ey - oy, ox - ax, oy - ay
            den = rx * sy - ry * sx
            sign = np.sign(den)
            t, u, den = (qx * sy - qy * sx) * sign, (qx * ry - qy * rx) * sign, den * sign
            i = np.flatnonzero((den > 0) & (t >= 0) & (t <= den) & (u >= 0) & (u <= den))
            px, py = ax[i] + _rounded(t[i], rx[i], den[i]), ay[i] + _rounded(t[i], ry[i], den[i])
            here = (px // cell == cx[i]) & (py // cell == cy[i])
            yield pa.RecordBatch.from_arrays([pa.array(c[here]) for c in (px, py, cx[i], cy[i])], names=["px", "py", "cx", "cy"])

    return pairs.select(*of, *[f"o{c}" for c in of], "cx", "cy").mapInArrow(run, "px long, py long, cx long, cy long")


def _rounded(t: np.ndarray, r: np.ndarray, den: np.ndarray) -> np.ndarray:
    """t / den * r, 0 <= t <= den, to the nearest whole number, halves up.

    A quotient of floating numbers is off by one at most. Its remainder is exact, though products overflow: whole numbers
    wrap round at 64 bits, and what is left of them in the end is small.
    """
    q = np.floor(t / den * r + 0.5).astype(np.int64)
    left = 2 * t * r + den - 2 * q * den
    for _ in range(2):
        q, left = q - (left < 0), left + np.where(left < 0, 2 * den, 0)
        more = left >= 2 * den
        q, left = q + more, left - np.where(more, 2 * den, 0)
    return q


def _passes() -> Column:
    """Whether the segment a-b passes the pixel around (px, py); edges below and to the left belong to it.

    In half pixels: the corners of the square lie on both sides of the line, or one of its own corners lies on it.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    side = 2 * (dx * (F.col("py") - F.col("ay")) - dy * (F.col("px") - F.col("ax")))  # of the centre; a corner's is more or less by dx and by dy
    near = (F.col("px").between(F.least("ax", "bx"), F.greatest("ax", "bx"))) & (F.col("py").between(F.least("ay", "by"), F.greatest("ay", "by")))
    return near & ((F.abs(side) < F.abs(dx) + F.abs(dy)) | (side == dx - dy))


def node_pieces(segments: DataFrame, pixel: float = PIXEL_M, cell: int = CELL) -> DataFrame:
    """seg_id, piece, ux, uy, vx, vy (pixels): the pieces of each segment between neighbouring hot pixels, in order.

    segments: seg_id (unique), x0, y0, x1, y1 in metres, MOST pixels long at most. Segments that lie on one another give equal
    pieces, once each. Nothing is gathered but the hot pixels of one segment, sorted by a window.
    """
    pixels = to_pixels(segments, pixel)
    ends = pixels.select(F.explode(F.array(F.struct(F.col("ax").alias("px"), F.col("ay").alias("py")), F.struct(F.col("bx").alias("px"), F.col("by").alias("py")))).alias("p")).select("p.px", "p.py")
    met = _met(pixels, cell)
    placed = ends.select("px", "py", F.floor(F.col("px") / cell).cast("long").alias("cx"), F.floor(F.col("py") / cell).cast("long").alias("cy"))
    hot = dealt(placed.unionByName(crossing_pixels(met, cell)), "cx", "cy").dropDuplicates(["cx", "cy", "px", "py"])
    met = met.join(hot.hint("merge"), ["cx", "cy"]).where(_passes())
    along = (F.col("px") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("py") - F.col("ay")) * (F.col("by") - F.col("ay"))
    order = Window.partitionBy("seg_id").orderBy("along", "px", "py")
    nodes = met.select("seg_id", "px", "py", along.alias("along")).withColumns({"vx": F.lead("px").over(order), "vy": F.lead("py").over(order), "piece": F.row_number().over(order)})
    return nodes.where("vx is not null").select("seg_id", "piece", F.col("px").alias("ux"), F.col("py").alias("uy"), "vx", "vy")


def node_edges(pieces: DataFrame, pixel: float = PIXEL_M) -> DataFrame:
    """u, v, weight for the graph operators: nodes are "x/y" in pixels, the weight is the length in metres; equal pieces once."""
    key = lambda a, b: F.concat_ws("/", F.col(a), F.col(b))
    length = F.sqrt(F.pow((F.col("vx") - F.col("ux")).cast("double"), F.lit(2.0)) + F.pow((F.col("vy") - F.col("uy")).cast("double"), F.lit(2.0))) * pixel
    both = pieces.select(key("ux", "uy").alias("a"), key("vx", "vy").alias("b"), length.alias("weight"))
    return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "weight").groupBy("u", "v").agg(F.max("weight").alias("weight"))
