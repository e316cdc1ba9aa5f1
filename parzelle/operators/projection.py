"""Coordinates between reference systems, and distances on the ellipsoid, as column expressions.

Systems are named by their EPSG codes: 4326 and 4258 (degrees; x is the longitude), UTM north on ETRS89 (258zz) and WGS 84
(326zz), and the German Gauss-Krueger zones 2 to 5 on the Bessel ellipsoid (31466 to 31469). Between datums coordinates
go through geocentric ones and a shift by seven parameters, which is good to some metres in Germany; ETRS89 and WGS 84
are taken as equal. A null coordinate gives null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from parzelle.functions.text import let


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


@dataclass(frozen=True)
class Shift:
    """To WGS 84: metres, seconds of arc (position vector), parts per million."""

    dx: float
    dy: float
    dz: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    scale: float = 0.0


@dataclass(frozen=True)
class Mercator:
    """A transverse Mercator projection of an ellipsoid."""

    ellipsoid: Ellipsoid
    meridian: float
    factor: float
    easting: float
    northing: float = 0.0
    latitude: float = 0.0


# Ellipsoids, and the shift of the German main triangulation net.
GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
BESSEL = Ellipsoid(6377397.155, 1 / 299.1528128)
DHDN = Shift(598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)


def system(code: int) -> tuple[Ellipsoid, Mercator | None, Shift | None]:
    """Ellipsoid, projection and shift to WGS 84 of an EPSG code."""
    if code in (4326, 4258):
        return (WGS84 if code == 4326 else GRS80), None, None
    zone = code % 100
    if code // 100 in (258, 326) and 1 <= zone <= 60:
        shape = GRS80 if code // 100 == 258 else WGS84
        return shape, Mercator(shape, 6.0 * zone - 183, 0.9996, 500_000.0), None
    if 31466 <= code <= 31469:
        zone = code - 31464
        return BESSEL, Mercator(BESSEL, 3.0 * zone, 1.0, zone * 1_000_000 + 500_000.0), DHDN
    raise ValueError(f"EPSG:{code} is not known")


def _radius(shape: Ellipsoid) -> tuple[float, float]:
    n = shape.f / (2 - shape.f)
    return n, shape.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def _waves(xi: Column, eta: Column, terms: list[float]) -> tuple[Column, Column]:
    up, across = F.lit(0.0), F.lit(0.0)
    for j, c in enumerate(terms, 1):
        up = up + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        across = across + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return up, across


def _arc(p: Mercator) -> float:
    """The meridian's length from the equator to the latitude of origin."""
    n, big = _radius(p.ellipsoid)
    phi = math.radians(p.latitude)
    e = math.sqrt(p.ellipsoid.e2)
    xi = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
    return big * (xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(_forward(n), 1)))


def _forward(n: float) -> list[float]:
    return [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]


def project(lat: Column, lon: Column, p: Mercator) -> Column:
    """x, y from degrees, by Krueger's series to the fourth order."""
    n, big = _radius(p.ellipsoid)
    e = math.sqrt(p.ellipsoid.e2)
    phi, lam = F.radians(lat), F.radians(lon - p.meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))

    def placed(s: Column) -> Column:
        up, across = _waves(s["xi"], s["eta"], _forward(n))
        return F.struct((p.easting + p.factor * big * (s["eta"] + across)).alias("x"), (p.northing + p.factor * (big * (s["xi"] + up) - _arc(p))).alias("y"))

    sphere = let(t, lambda t: F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)).alias("eta")))
    return let(sphere, placed)


def unproject(x: Column, y: Column, p: Mercator) -> Column:
    """Degrees (x longitude, y latitude) from a projection's x, y."""
    n, big = _radius(p.ellipsoid)
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    series = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    plane = F.struct((((y - p.northing) / p.factor + _arc(p)) / big).alias("xi"), ((x - p.easting) / (p.factor * big)).alias("eta"))

    def sphere(s: Column) -> Column:
        up, across = _waves(s["xi"], s["eta"], back)
        return F.struct((s["xi"] - up).alias("xi"), (s["eta"] - across).alias("eta"))

    def degrees(s: Column) -> Column:
        chi = F.asin(F.sin(s["xi"]) / F.cosh(s["eta"]))
        lam = F.atan2(F.sinh(s["eta"]), F.cos(s["xi"]))
        lat = let(chi, lambda c: c + sum((d * F.sin(2 * j * c) for j, d in enumerate(series, 1)), F.lit(0.0)))
        return F.struct((p.meridian + F.degrees(lam)).alias("x"), F.degrees(lat).alias("y"))

    return let(let(plane, sphere), degrees)


def geocentric(lat: Column, lon: Column, shape: Ellipsoid, height: float = 0.0) -> Column:
    """x, y, z in metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    v = shape.a / F.sqrt(1 - shape.e2 * F.sin(phi) * F.sin(phi))
    return F.struct(((v + height) * F.cos(phi) * F.cos(lam)).alias("x"), ((v + height) * F.cos(phi) * F.sin(lam)).alias("y"), ((v * (1 - shape.e2) + height) * F.sin(phi)).alias("z"))


def geographic(g: Column, shape: Ellipsoid) -> Column:
    """Degrees (x longitude, y latitude) of a geocentric place near the surface, by Bowring's formula."""
    b = shape.a * (1 - shape.f)
    p = F.sqrt(g["x"] * g["x"] + g["y"] * g["y"])
    u = F.atan2(g["z"] * shape.a, p * b)
    lat = F.atan2(g["z"] + shape.e2 / (1 - shape.e2) * b * F.pow(F.sin(u), 3), p - shape.e2 * shape.a * F.pow(F.cos(u), 3))
    return F.struct(F.degrees(F.atan2(g["y"], g["x"])).alias("x"), F.degrees(lat).alias("y"))


def shifted(g: Column, s: Shift, back: bool = False) -> Column:
    """A geocentric place moved by seven parameters, or back to where it was."""
    rx, ry, rz = (math.radians(r / 3600) for r in (s.rx, s.ry, s.rz))
    turn = (1 + s.scale * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])
    move = np.array([s.dx, s.dy, s.dz])
    if back:
        turn = np.linalg.inv(turn)
        move = -turn @ move
    row = lambda i: float(turn[i, 0]) * g["x"] + float(turn[i, 1]) * g["y"] + float(turn[i, 2]) * g["z"] + float(move[i])
    return F.struct(*[row(i).alias(c) for i, c in enumerate("xyz")])


def reproject(x: Column, y: Column, source: int, target: int) -> Column:
    """x, y of the target's EPSG code from those of the source's; of degrees x is the longitude."""
    shape, plane, shift = system(source)
    to_shape, to_plane, to_shift = system(target)
    place = unproject(x, y, plane) if plane else F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    if shift != to_shift:
        place = let(place, lambda p: geocentric(p["y"], p["x"], shape))
        by = lambda s, back: lambda g: shifted(g, s, back)
        for s, back in ((shift, False), (to_shift, True)):
            if s:
                place = let(place, by(s, back))
        place = let(place, lambda g: geographic(g, to_shape))
    if to_plane:
        place = let(place, lambda p: project(p["y"], p["x"], to_plane))
    return F.when(x.isNotNull() & y.isNotNull(), place)


def _vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, shape: Ellipsoid, rounds: int) -> np.ndarray:
    """Distances in km; not a number where the rounds don't settle."""
    f, b = shape.f, shape.a * (1 - shape.f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(lat))) for lat in (lat1, lat2))
    s1, c1, s2, c2, d = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), np.radians(lon2 - lon1)

    def at(lam: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the arc sin, cos, the sin of its azimuth at the equator, and length; cos of its doubled middle."""
        across, along = np.sin(lam), np.cos(lam)
        sin = np.sqrt((c2 * across) ** 2 + (c1 * s2 - s1 * c2 * along) ** 2)
        cos = s1 * s2 + c1 * c2 * along
        az = np.divide(c1 * c2 * across, sin, out=np.zeros_like(sin), where=sin > 0)
        flat = 1 - az * az
        real = flat > 1e-15
        mid = np.where(real, cos - np.divide(2 * s1 * s2, flat, out=np.zeros_like(flat), where=real), 0.0)
        return sin, cos, az, flat, mid, np.arctan2(sin, cos)

    lam, moved = d, np.zeros_like(d)
    for _ in range(rounds):
        sin, cos, az, flat, mid, arc = at(lam)
        c = f / 16 * flat * (4 + f * (4 - 3 * flat))
        new = d + (1 - c) * f * az * (arc + c * sin * (mid + c * cos * (2 * mid * mid - 1)))
        lam, moved = new, np.abs(new - lam)
        if not (moved >= 1e-14).any():  # settled beyond what the limit below asks for
            break
    sin, cos, az, flat, mid, arc = at(lam)
    w = flat * shape.e2 / (1 - shape.e2)
    big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    off = small * sin * (mid + small / 4 * (cos * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3)))
    return np.where(moved < 1e-11, b * big * (arc - off) / 1000, np.nan)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column, shape: Ellipsoid = WGS84, rounds: int = 20) -> Column:
    """Distance in km on the ellipsoid by Vincenty's inverse formula in a fixed number of rounds, in Arrow batches; null if a place is missing or out of range. Nearly opposite places, for which the rounds don't settle, are null too."""
    def run(*places: pd.Series) -> pd.Series:
        with np.errstate(invalid="ignore"):
            return pd.Series(_vincenty(*(p.to_numpy(dtype=float) for p in places), shape, rounds))

    ok = lat1.between(-90, 90) & lat2.between(-90, 90) & lon1.between(-180, 180) & lon2.between(-180, 180)
    km = F.pandas_udf(run, "double")(*[F.when(ok, x.cast("double")) for x in (lat1, lon1, lat2, lon2)])
    return F.nanvl(km, F.lit(None).cast("double"))
