"""Geodesy on WGS84 and the sphere, as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import col

# The WGS84 ellipsoid, and the sphere used for transects.
A = 6378137.0
FLATTENING = 1 / 298.257223563
B = A * (1 - FLATTENING)
SPHERE = 6371000.0
SCALE = 0.9996
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def sphere_destination(lon: Column | str, lat: Column | str, azimuth: Column | str, distance_m: Column | float) -> tuple[Column, Column]:
    """Longitude and latitude reached on the sphere."""
    d = (F.lit(distance_m) if isinstance(distance_m, (int, float)) else distance_m) / SPHERE
    phi, lam, az = F.radians(col(lat)), F.radians(col(lon)), F.radians(col(azimuth))
    phi2 = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(az))
    lam2 = lam + F.atan2(F.sin(az) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(phi2))
    return F.degrees(lam2), F.degrees(phi2)


def sphere_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * SPHERE * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def geodesic_destination(lon: Column | str, lat: Column | str, azimuth: Column | str, distance_m: Column | float, rounds: int = 8) -> tuple[Column, Column]:
    """Longitude and latitude reached on the ellipsoid: Vincenty's direct formula with a fixed number of rounds."""
    s = F.lit(distance_m) if isinstance(distance_m, (int, float)) else distance_m
    phi, az = F.radians(col(lat)), F.radians(col(azimuth))
    u1 = F.atan((1 - FLATTENING) * F.tan(phi))
    sigma1 = F.atan2(F.tan(u1), F.cos(az))
    sin_alpha = F.cos(u1) * F.sin(az)
    cos2 = 1 - sin_alpha * sin_alpha
    u_sq = cos2 * (A * A - B * B) / (B * B)
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    # the constants travel in a struct so that each is computed once
    held = F.struct(sigma1.alias("s1"), big_b.alias("b"), (s / (B * big_a)).alias("base"))

    def step(sigma: Column, c: Column) -> Column:
        m = F.cos(2 * c["s1"] + sigma)
        delta = c["b"] * F.sin(sigma) * (m + c["b"] / 4 * (F.cos(sigma) * (-1 + 2 * m * m) - c["b"] / 6 * m * (-3 + 4 * F.sin(sigma) * F.sin(sigma)) * (-3 + 4 * m * m)))
        return c["base"] + delta

    sigma = F.aggregate(F.array_repeat(held, rounds), s / (B * big_a), step)
    m = F.cos(2 * sigma1 + sigma)
    x = F.sin(u1) * F.sin(sigma) - F.cos(u1) * F.cos(sigma) * F.cos(az)
    phi2 = F.atan2(F.sin(u1) * F.cos(sigma) + F.cos(u1) * F.sin(sigma) * F.cos(az), (1 - FLATTENING) * F.sqrt(sin_alpha * sin_alpha + x * x))
    lam = F.atan2(F.sin(sigma) * F.sin(az), F.cos(u1) * F.cos(sigma) - F.sin(u1) * F.sin(sigma) * F.cos(az))
    c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    length = lam - (1 - c) * FLATTENING * sin_alpha * (sigma + c * F.sin(sigma) * (m + c * F.cos(sigma) * (-1 + 2 * m * m)))
    return col(lon) + F.degrees(length), F.degrees(phi2)


def _series(cos2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u_sq = cos2 * (A * A - B * B) / (B * B)
    return 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq))), u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))


def _delta(big_b: np.ndarray, sin: np.ndarray, cos: np.ndarray, m: np.ndarray) -> np.ndarray:
    return big_b * sin * (m + big_b / 4 * (cos * (-1 + 2 * m * m) - big_b / 6 * m * (-3 + 4 * sin * sin) * (-3 + 4 * m * m)))


def direct(lon: np.ndarray, lat: np.ndarray, azimuth: np.ndarray, distance_m: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """geodesic_destination on arrays."""
    phi, az = np.radians(lat), np.radians(azimuth)
    u1 = np.arctan((1 - FLATTENING) * np.tan(phi))
    sin_alpha = np.cos(u1) * np.sin(az)
    cos2 = 1 - sin_alpha * sin_alpha
    sigma1 = np.arctan2(np.tan(u1), np.cos(az))
    big_a, big_b = _series(cos2)
    sigma = base = distance_m / (B * big_a)
    for _ in range(rounds):
        sigma = base + _delta(big_b, np.sin(sigma), np.cos(sigma), np.cos(2 * sigma1 + sigma))
    m = np.cos(2 * sigma1 + sigma)
    x = np.sin(u1) * np.sin(sigma) - np.cos(u1) * np.cos(sigma) * np.cos(az)
    phi2 = np.arctan2(np.sin(u1) * np.cos(sigma) + np.cos(u1) * np.sin(sigma) * np.cos(az), (1 - FLATTENING) * np.sqrt(sin_alpha * sin_alpha + x * x))
    lam = np.arctan2(np.sin(sigma) * np.sin(az), np.cos(u1) * np.cos(sigma) - np.sin(u1) * np.sin(sigma) * np.cos(az))
    c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    length = lam - (1 - c) * FLATTENING * sin_alpha * (sigma + c * np.sin(sigma) * (m + c * np.cos(sigma) * (-1 + 2 * m * m)))
    return lon + np.degrees(length), np.degrees(phi2)


def sphere_direct(lon: np.ndarray, lat: np.ndarray, azimuth: np.ndarray, distance_m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sphere_destination on arrays."""
    phi, az, d = np.radians(lat), np.radians(azimuth), distance_m / SPHERE
    phi2 = np.arcsin(np.sin(phi) * np.cos(d) + np.cos(phi) * np.sin(d) * np.cos(az))
    return lon + np.degrees(np.arctan2(np.sin(az) * np.sin(d) * np.cos(phi), np.cos(d) - np.sin(phi) * np.sin(phi2))), np.degrees(phi2)


def sphere_steps(lon: np.ndarray, lat: np.ndarray, azimuth: np.ndarray, distance_m: np.ndarray, origin: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sphere_direct() from the origins with these numbers, as far as the distances with these: the same values, but sines and
    cosines are taken once for each origin and distance."""
    phi, az, d = np.radians(lat), np.radians(azimuth), distance_m / SPHERE
    sin_phi, cos_phi, sin_az, cos_az = (c[origin] for c in (np.sin(phi), np.cos(phi), np.sin(az), np.cos(az)))
    sin_d, cos_d = np.sin(d)[step], np.cos(d)[step]
    phi2 = np.arcsin(sin_phi * cos_d + cos_phi * sin_d * cos_az)
    return lon[origin] + np.degrees(np.arctan2(sin_az * sin_d * cos_phi, cos_d - sin_phi * np.sin(phi2))), np.degrees(phi2)


def inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Azimuth in degrees at the first point and metres along the ellipsoid: Vincenty's inverse formula with a fixed number of
    rounds, for points that are not antipodal."""
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    lam = length = np.radians(lon2 - lon1)
    for _ in range(rounds):
        sin = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        cos = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(sin, cos)
        sin_alpha = np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin == 0, 1, sin)
        cos2 = 1 - sin_alpha * sin_alpha
        m = np.where(cos2 == 0, 0, cos - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 == 0, 1, cos2))
        c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        lam = length + (1 - c) * FLATTENING * sin_alpha * (sigma + c * sin * (m + c * cos * (-1 + 2 * m * m)))
    big_a, big_b = _series(cos2)
    azimuth = np.degrees(np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)))
    return azimuth, B * big_a * (sigma - _delta(big_b, sin, cos, m))


def distance(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Metres along the ellipsoid, as inverse() has them."""
    return inverse(lon1, lat1, lon2, lat2, rounds)[1]


def utm_zone(lon: Column | str) -> Column:
    return (F.floor((col(lon) + 180) / 6) % 60 + 1).cast("int")


def utm_epsg(lon: Column | str, lat: Column | str) -> Column:
    return F.when(col(lat) >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def _atanh(x: Column) -> Column:
    return F.atanh(x)


def utm_forward(lon: Column | str, lat: Column | str, zone: Column | int) -> tuple[Column, Column]:
    """Easting and northing in metres (Krueger's series to the third order)."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(_atanh(F.sin(phi)) - e * _atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + SCALE * _RADIUS * east, F.when(col(lat) < 0, 10000000.0).otherwise(0.0) + SCALE * _RADIUS * north


def utm_inverse(x: Column | str, y: Column | str, zone: Column | int, south: bool = False) -> tuple[Column, Column]:
    zone = F.lit(zone) if isinstance(zone, int) else zone
    xi = (col(y) - (10000000.0 if south else 0.0)) / (SCALE * _RADIUS)
    eta = (col(x) - 500000.0) / (SCALE * _RADIUS)
    xi2, eta2 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi2 = xi2 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta2 = eta2 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))) + (zone * 6 - 183), F.degrees(phi)
