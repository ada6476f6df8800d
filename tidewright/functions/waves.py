"""Wave physics as Column expressions (SI units; wind speeds in km/h only where the name says so)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import col

G = 9.81
RHO = 1025.0
OVERWATER = 1.1
GAMMA = 0.55
DEEP_M = 20.0
POINT_M = 3.0


def wind_over_water(ws_kmh: Column | str) -> Column:
    return col(ws_kmh) / 3.6 * OVERWATER


def fetch_limited_growth(u: Column, fetch_m: Column, capped: bool = False) -> tuple[Column, Column]:
    """Significant height and peak period for wind u over a fetch (Sverdrup-Munk-Bretschneider).

    u is 0.5 m/s at least and the fetch 1 m. capped adds the fully developed limits, which tanh never passes.
    """
    u, f = F.greatest(u, F.lit(0.5)), F.greatest(fetch_m, F.lit(1.0))
    x = G * f / (u * u)
    height = 0.283 * (u * u / G) * F.tanh(0.53 * F.pow(x, F.lit(0.75)))
    period = 7.54 * (u / G) * F.tanh(0.833 * F.pow(x, F.lit(0.375)))
    if capped:
        height, period = F.least(height, 0.283 * u * u / G), F.least(period, 7.54 * u / G)
    return height, period


def shoaling(h_deep: Column, h_point: Column, clamp: bool = False, reference: float = 0.1) -> Column:
    """(h_deep / h_point) ** 1/4 with h_point at least 0.1 m; clamp: h_deep is not taken below h_point."""
    shallow = F.greatest(h_point, F.lit(reference))
    deep = F.greatest(h_deep, shallow) if clamp else h_deep
    return F.pow(deep / shallow, F.lit(0.25))


def shallow_refraction(delta: Column, h_point: Column, h_deep: Column) -> Column:
    """Cosine of the refracted angle from shallow-water celerities; symmetric about 90 degrees and never negative.

    A point's depth counts as 0.1 m at least, as in shoaling.
    """
    ratio = F.sqrt(G * F.greatest(h_point, F.lit(0.1))) / F.sqrt(G * h_deep)
    s = F.sin(F.radians(F.abs(delta))) * ratio
    return F.cos(F.asin(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0))))


def phase_speed(period: Column, depth: Column, rounds: int = 50, tolerance: float = 1e-8) -> Column:
    """Phase speed by the full dispersion relation, by fixed-point rounds on the wave number.

    Rounds end with the first change under the tolerance, and the number before that change stays.
    """
    omega = 2 * math.pi / F.greatest(period, F.lit(1.0))
    h = F.greatest(depth, F.lit(0.1))
    start = F.struct((omega * omega / G).alias("k"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        k = state["k"]
        after = omega * omega / (G * F.tanh(k * h))
        done = state["done"] | (F.abs(after - k) < tolerance)
        return F.struct(F.when(done, k).otherwise(after).alias("k"), done.alias("done"))

    return omega / F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["k"]


def wave_power(height: Column, period: Column) -> Column:
    """Energy flux per metre of crest in deep water."""
    return RHO * G * G * height * height * period / (64 * math.pi)
