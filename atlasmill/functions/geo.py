"""Map projection, planar distance, polygon area and grids, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the transverse Mercator grid's scale and false easting.
SEMI_MAJOR, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0


def _series() -> tuple[float, float, list[float], list[float], list[float]]:
    """Rectifying radius, eccentricity and the Krüger series to the third order (forward, inverse, latitude)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, 2 * math.sqrt(n) / (1 + n), forward, inverse, latitude


def central_meridian(zone: int) -> float:
    return zone * 6 - 183.0


def projected(lon: Column, lat: Column, zone: int = 31) -> tuple[Column, Column]:
    """Degrees to metres (x, y) in the northern grid of the zone."""
    radius, e, forward, _, _ = _series()
    phi, dl = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(forward, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * radius * x, SCALE * radius * y


def with_position(df: DataFrame, lon: Column, lat: Column, zone: int = 31) -> DataFrame:
    """Adds x and y, the grid position of degrees: the terms of `projected` as columns, each computed once a row.

    As one expression they are repeated wherever a later term, or a user of x or y, refers to them.
    """
    radius, e, forward, _, _ = _series()
    df = df.withColumns({"__s": F.sin(F.radians(lat)), "__dl": F.radians(lon - central_meridian(zone))})
    df = df.withColumn("__t", F.sinh(F.atanh("__s") - e * F.atanh(e * F.col("__s"))))
    df = df.withColumns({"__xi": F.atan2("__t", F.cos("__dl")), "__eta": F.atanh(F.sin("__dl") / F.sqrt(1 + F.col("__t") * F.col("__t")))})
    x, y = F.col("__eta"), F.col("__xi")
    for j, a in enumerate(forward, 1):
        x = x + a * F.cos(2 * j * F.col("__xi")) * F.sinh(2 * j * F.col("__eta"))
        y = y + a * F.sin(2 * j * F.col("__xi")) * F.cosh(2 * j * F.col("__eta"))
    return df.withColumns({"x": EASTING + SCALE * radius * x, "y": SCALE * radius * y}).drop("__s", "__dl", "__t", "__xi", "__eta")


def unprojected(x: Column, y: Column, zone: int = 31) -> tuple[Column, Column]:
    """Metres in the zone's grid to degrees (lon, lat)."""
    radius, _, _, inverse, latitude = _series()
    xi, eta = y / (SCALE * radius), (x - EASTING) / (SCALE * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(inverse, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(latitude, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return central_meridian(zone) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def distance_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2) / 1000


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area of a closed ring: an array of (x, y) in metres, the first repeated at the end."""
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2e6


def grid(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, step: float, thin: int = 1) -> DataFrame:
    """Cells (ix, iy, x, y) at multiples of the step from (x0, y0), ends excluded; only every thin-th on both axes. Made on the executors."""
    nx, ny = max(0, math.ceil((x1 - x0) / step)), max(0, math.ceil((y1 - y0) / step))
    cells = spark.range(nx * ny).select((F.col("id") % max(nx, 1)).alias("ix"), F.floor(F.col("id") / max(nx, 1)).alias("iy"))
    if thin > 1:
        cells = cells.filter((F.pmod("ix", F.lit(thin)) == 0) & (F.pmod("iy", F.lit(thin)) == 0))
    return cells.select("ix", "iy", (F.lit(float(x0)) + F.col("ix") * float(step)).alias("x"), (F.lit(float(y0)) + F.col("iy") * float(step)).alias("y"))


def outside_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return ~(lon.between(west, east) & lat.between(south, north))


def at_null_island(lon: Column, lat: Column) -> Column:
    return (F.abs(lon) < 1e-9) & (F.abs(lat) < 1e-9)
