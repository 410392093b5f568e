"""Geometry as Column expressions: distances, projections, rings, lines, and the points of WKB and WKT."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in metres: the radii of two spheres in use, and the WGS-84 ellipsoid.
SPHERE, SPHERE_WALK = 6_371_000.0, 6_371_009.0
A84, F84 = 6_378_137.0, 1 / 298.257223563
B84 = A84 * (1 - F84)
E2 = F84 * (2 - F84)
#: GRS 80, on which the equal-area projection of the conterminous states rests.
F80 = 1 / 298.257222101


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = SPHERE) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * radius)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, SPHERE_WALK)


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def geodesic_metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Metres on the WGS-84 ellipsoid by the inverse formula of Vincenty, over arrays. NaN where positions almost opposite
    each other do not converge."""
    u1, u2 = (np.arctan((1 - F84) * np.tan(np.radians(x))) for x in (lat1, lat2))
    span = np.radians(lon2 - lon1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, last = span, span + 1
    for _ in range(rounds):
        sin_s = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
        cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.divide(c1 * c2 * np.sin(lam), sin_s, out=np.zeros_like(sin_s), where=sin_s > 0)
        cos2_a = 1 - sin_a**2
        cos_m = cos_s - np.divide(2 * s1 * s2, cos2_a, out=np.zeros_like(cos_s), where=cos2_a > 1e-15)
        c = F84 / 16 * cos2_a * (4 + F84 * (4 - 3 * cos2_a))
        last, lam = lam, span + (1 - c) * F84 * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
    u = cos2_a * (A84**2 - B84**2) / B84**2
    a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    d = b * sin_s * (cos_m + b / 4 * (cos_s * (2 * cos_m**2 - 1) - b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
    return np.where(np.abs(lam - last) < 1e-11, B84 * a * (sigma - d), np.nan)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """geodesic_metres as a column, by Arrow batches: rounds of a formula this long cannot share their parts as expressions."""

    @F.pandas_udf("double")
    def metres(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        with np.errstate(invalid="ignore"):
            return pd.Series(geodesic_metres(*[x.to_numpy(float) for x in (a, b, c, d)]))

    return metres(lat1, lon1, lat2, lon2)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG 3857."""
    return F.radians(lon) * A84, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A84


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A84), F.degrees(F.atan(F.exp(y / A84)) * 2 - math.pi / 2)


def _q(s, e2: float):
    e = math.sqrt(e2)
    if isinstance(s, float):
        return (1 - e2) * (s / (1 - e2 * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))
    return (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e)) * (1 - e2)


def _albers() -> tuple[float, float, float, float]:
    e2 = F80 * (2 - F80)
    p1, p2, p0 = (math.radians(x) for x in (29.5, 45.5, 23.0))
    m = [math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2) for p in (p1, p2)]
    q = [_q(math.sin(p), e2) for p in (p1, p2, p0)]
    n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
    c = m[0] ** 2 + n * q[0]
    return e2, n, c, A84 * math.sqrt(c - n * q[2]) / n


def to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG 5070: parallels 29.5 and 45.5, origin 96 W, 23 N."""
    e2, n, c, rho0 = _albers()
    rho = F.sqrt(c - n * _q(F.sin(F.radians(lat)), e2)) * (A84 / n)
    theta = F.radians(lon + 96) * n
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def from_albers(x: Column, y: Column) -> tuple[Column, Column]:
    e2, n, c, rho0 = _albers()
    rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
    q = (c - F.pow(rho * n / A84, 2)) / n
    e = math.sqrt(e2)
    beta = F.asin(q / _q(1.0, e2))
    lat = beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(beta * 2) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(beta * 4) + 761 * e2**3 / 45360 * F.sin(beta * 6)
    return F.degrees(F.atan2(x, rho0 - y) / n) - 96, F.degrees(lat)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, utm_zone(lon) + 32600).otherwise(utm_zone(lon) + 32700)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of the position."""
    phi, lam = F.radians(lat), F.radians(lon - (utm_zone(lon) * 6 - 183))
    ep2 = E2 / (1 - E2)
    n = A84 / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), F.pow(F.cos(phi), 2) * ep2, F.cos(phi) * lam
    m = A84 * (phi * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) - F.sin(phi * 2) * (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) + F.sin(phi * 4) * (15 * E2**2 / 256 + 45 * E2**3 / 1024) - F.sin(phi * 6) * (35 * E2**3 / 3072))
    x = n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120) * 0.9996 + 500_000
    y = (m + n * F.tan(phi) * (F.pow(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720)) * 0.9996
    return x, F.when(lat >= 0, y).otherwise(y + 10_000_000)


def point(lon: Column, lat: Column) -> Column:
    """struct<lon, lat>, null unless both are finite."""
    ok = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) < float("inf")) & (F.abs(lat) < float("inf"))
    return F.when(ok, F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")))


def _double_at(wkb: Column, at: int) -> Column:
    """A little-endian double of a binary, by its bits."""
    h = F.hex(F.substring(wkb, at, 8))
    turned = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    hi, lo = F.conv(F.substring(turned, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(turned, 9, 8), 16, 10).cast("bigint")
    sign = F.when(hi >= 1 << 31, -1.0).otherwise(1.0)
    exponent = F.shiftright(hi, 20).bitwiseAND(2047)
    fraction = (hi.bitwiseAND((1 << 20) - 1) * float(1 << 32) + lo) / float(1 << 52)
    return F.when(exponent == 2047, F.lit(float("nan"))).when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise(sign * (fraction + 1) * F.pow(F.lit(2.0), exponent - 1023.0))


def wkb_point(wkb: Column) -> Column:
    """struct<lon, lat> of a little-endian WKB point, null for anything else, by byte arithmetic alone."""
    ok = (F.length(wkb) >= 21) & (F.hex(F.substring(wkb, 1, 5)) == "0101000000")
    return F.when(ok, F.struct(_double_at(wkb, 6).alias("lon"), _double_at(wkb, 14).alias("lat")))


def wkt_point(text: Column) -> Column:
    number = r"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    pattern = rf"^\s*(?i:POINT)\s*\(\s*{number}\s+{number}\s*\)\s*$"
    return point(F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2).try_cast("double"))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a closed ring (array<struct<lon, lat>>) holds a position, by the parity of the edges to its right."""

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(spans & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0), lambda t, i: t + crosses(i)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Signed, by the shoelace."""
    term = lambda i: F.get(ring, i)["lon"] * F.get(ring, i + 1)["lat"] - F.get(ring, i + 1)["lon"] * F.get(ring, i)["lat"]
    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda t, i: t + term(i)) / 2


def ring_centroid(ring: Column) -> Column:
    term = lambda i: F.get(ring, i)["lon"] * F.get(ring, i + 1)["lat"] - F.get(ring, i + 1)["lon"] * F.get(ring, i)["lat"]
    part = lambda k: F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda t, i: t + (F.get(ring, i)[k] + F.get(ring, i + 1)[k]) * term(i))
    area = ring_area(ring) * 6
    return F.struct((part("lon") / area).alias("lon"), (part("lat") / area).alias("lat"))


def line_length(line: Column) -> Column:
    """Of an array<struct<lon, lat>>, in its own units."""
    step = lambda i: planar(F.get(line, i)["lon"], F.get(line, i)["lat"], F.get(line, i + 1)["lon"], F.get(line, i + 1)["lat"])
    return F.when(F.size(line) < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0))), F.lit(0.0), lambda t, i: t + step(i)))


def line_at(line: Column, fraction: Column) -> Column:
    """The point at a part 0..1 of a line's length; parts outside are clipped."""
    whole = line_length(line)
    goal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * whole
    zero = F.struct(F.lit(0.0).alias("done"), F.get(line, F.lit(0))["lon"].alias("lon"), F.get(line, F.lit(0))["lat"].alias("lat"))

    def step(t: Column, i: Column) -> Column:
        a, b = F.get(line, i), F.get(line, i + 1)
        d = planar(a["lon"], a["lat"], b["lon"], b["lat"])
        part = F.when(d > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (goal - t["done"]) / d))).otherwise(0.0)
        here = t["done"] <= goal
        lon = F.when(here, a["lon"] + part * (b["lon"] - a["lon"])).otherwise(t["lon"])
        lat = F.when(here, a["lat"] + part * (b["lat"] - a["lat"])).otherwise(t["lat"])
        return F.struct((t["done"] + d).alias("done"), lon.alias("lon"), lat.alias("lat"))

    end = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0))), zero, step)
    return F.when(F.size(line) == 1, F.get(line, F.lit(0))).otherwise(F.struct(end["lon"].alias("lon"), end["lat"].alias("lat")))


def merged_lines(lines: Column) -> Column:
    """Ordered lines as one, vertices shared by neighbours once."""
    flat = F.flatten(lines)
    return F.filter(flat, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(flat, i - 1)))
