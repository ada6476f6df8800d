"""Angles as Column expressions: degrees, clockwise from north, in [0, 360)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sixteen points of the compass.
COMPASS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
COMPASS_8 = COMPASS_16[::2]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrap360(angle: Column | str) -> Column:
    """In [0, 360). Negative multiples of 360 give 0.0, not -0.0; so do angles so little below 0 that they round up to 360."""
    turned = F.pmod(col(angle), F.lit(360.0))
    return F.when(turned >= 360.0, F.lit(0.0)).otherwise(turned + 0.0)


def whole_direction(angle: Column | str) -> Column:
    """Rounded half to even, 0 .. 359; null stays null."""
    return F.pmod(F.rint(col(angle)), F.lit(360.0)).cast("int")


def signed_difference(direction: Column | str, normal: Column | str) -> Column:
    """direction - normal in [-180, 180)."""
    return F.pmod(col(direction) - col(normal) + 180.0, F.lit(360.0)) - 180.0


def circular_distance(a: Column | str, b: Column | str) -> Column:
    d = F.abs(col(a) - col(b))
    return F.least(d, F.lit(360) - d)


def shoreward_cosine(delta: Column | str) -> Column:
    """cos of the angle to the normal, 0 for waves that come from land."""
    return F.greatest(F.cos(F.radians(col(delta))), F.lit(0.0))


def sector_number(direction: Column | str, sectors: int = 16) -> Column:
    """Number of the sector of equal width centred on north, east of it, ..."""
    step = 360.0 / sectors
    return F.pmod(F.floor((col(direction) + step / 2) / step), F.lit(sectors)).cast("int")


def sector_name(direction: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in COMPASS_16]), sector_number(direction) + 1)


def in_land_sector(azimuth: Column | str, normal: Column | str, edge: str = "half_open", half_width: float = 90.0) -> Column:
    """Whether an azimuth points to land, the sea lying along the normal.

    half_open: [90, 270) degrees clockwise from the normal. closed: within half_width of the direction opposite to it,
    both ends included.
    """
    if edge == "half_open":
        turn = wrap360(col(azimuth) - col(normal))
        return (turn >= 90.0) & (turn < 270.0)
    if edge == "closed":
        return F.abs(signed_difference(azimuth, col(normal) + 180.0)) <= half_width
    raise ValueError(f"edge is half_open or closed, not {edge!r}")


def offset_x(azimuth: Column | str, distance: Column | float) -> Column:
    return distance * F.sin(F.radians(col(azimuth)))


def offset_y(azimuth: Column | str, distance: Column | float) -> Column:
    return distance * F.cos(F.radians(col(azimuth)))
