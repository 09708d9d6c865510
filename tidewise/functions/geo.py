"""Geometry as column expressions.

A point is a struct (x, y), a ring or line an array of points, a polygon an array of rings, a multipolygon an array of
polygons.  All expressions stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
MULTI = f"array<array<{LINE}>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(line: Column) -> Column:
    """Array of (a, b): the pieces between consecutive points."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(
        F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>")
    )


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """How many edges of a ring a ray from (x, y) to the right crosses."""

    def hit(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    # The division is guarded by the test before it: edges that cross have different ends.
    safe = lambda s: F.when((s["a"]["y"] > y) != (s["b"]["y"] > y), hit(s)).otherwise(F.lit(False))
    return F.size(F.filter(segments(ring), safe))


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings of a polygon (holes count)."""
    return F.aggregate(polygon, F.lit(0), lambda n, ring: n + crossings(ring, x, y)) % 2 == 1


def in_multipolygon(multi: Column, x: Column, y: Column) -> Column:
    return F.exists(multi, lambda p: in_polygon(p, x, y))


def _side(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the closed segments a-b and c-d have a point in common."""
    apart = lambda k: (F.greatest(a[k], b[k]) < F.least(c[k], d[k])) | (F.greatest(c[k], d[k]) < F.least(a[k], b[k]))
    return ~apart("x") & ~apart("y") & (_side(a, b, c) * _side(a, b, d) <= 0) & (_side(c, d, a) * _side(c, d, b) <= 0)


def edges_of(multi: Column) -> Column:
    """Edges of each part of a multipolygon, all its rings in one array: made once, tested often."""
    return F.transform(multi, lambda p: F.flatten(F.transform(p, segments)))


def hits(edges: Column, x: Column, y: Column) -> Column:
    """How many of the edges a ray from (x, y) to the right crosses."""

    def hit(s: Column) -> Column:
        a, b = s["a"], s["b"]
        cross = x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when((a["y"] > y) != (b["y"] > y), cross).otherwise(F.lit(False))

    return F.size(F.filter(edges, hit))


def segment_distance(x: Column, y: Column, s: Column) -> Column:
    """Distance of (x, y) from a segment."""
    a, b = s["a"], s["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    span = dx * dx + dy * dy
    t = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / span))).otherwise(F.lit(0.0))
    return F.hypot(x - (a["x"] + t * dx), y - (a["y"] + t * dy))


def mid_vertex(line: Column) -> Column:
    """The vertex at place floor(n / 2); null for an empty line."""
    return F.get(line, F.floor(F.size(line) / 2).cast("int"))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


#: Fixed values of the WGS 84 ellipsoid and the transverse Mercator projection.
_A, _F, _K0, _E0, _N_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """(x, y) in metres by the Krueger series of third order; southern latitudes get the false northing."""
    e = 2 * _N**0.5 / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(F.lit(_E0) + F.lit(_K0 * _RADIUS) * x, F.when(lat < 0, F.lit(_N_SOUTH)).otherwise(F.lit(0.0)) + F.lit(_K0 * _RADIUS) * y)


def project(table: DataFrame, lon: str, lat: str, zone: int, name: str) -> DataFrame:
    """Adds UTM metres as columns ``<name>x`` and ``<name>y``, with each step of the series a column that is computed once."""
    e, lam = 2 * _N**0.5 / (1 + _N), F.radians(F.col(lon) - (zone * 6 - 183))
    t = table.withColumn("__s", F.sin(F.radians(F.col(lat))))
    t = t.withColumn("__t", F.sinh(F.atanh(F.col("__s")) - F.lit(e) * F.atanh(F.lit(e) * F.col("__s"))))
    t = t.withColumns({"__xi": F.atan2(F.col("__t"), F.cos(lam)), "__eta": F.atanh(F.sin(lam) / F.sqrt(1 + F.col("__t") * F.col("__t")))})
    x, y = F.col("__eta"), F.col("__xi")
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * F.col("__xi")) * F.sinh(2 * j * F.col("__eta"))
        y = y + F.lit(a) * F.sin(2 * j * F.col("__xi")) * F.cosh(2 * j * F.col("__eta"))
    north = F.when(F.col(lat) < 0, F.lit(_N_SOUTH)).otherwise(F.lit(0.0))
    t = t.withColumns({f"{name}x": F.lit(_E0) + F.lit(_K0 * _RADIUS) * x, f"{name}y": north + F.lit(_K0 * _RADIUS) * y})
    return t.drop("__s", "__t", "__xi", "__eta")


def from_utm(x: Column, y: Column, zone: Column, south: bool = False) -> Column:
    """(lon, lat) as a point, the inverse of ``to_utm``."""
    xi, eta = (y - F.lit(_N_SOUTH if south else 0.0)) / F.lit(_K0 * _RADIUS), (x - F.lit(_E0)) / F.lit(_K0 * _RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return point(F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (zone * 6 - 183), F.degrees(phi))


def line_to_utm(line: Column, zone: Column) -> Column:
    return F.transform(line, lambda p: to_utm(p["x"], p["y"], zone))


def bounds(line: Column) -> Column:
    """(min_x, max_x, min_y, max_y) of an array of points."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))


def bins(box: Column, size: float) -> Column:
    """The grid bins (bx, by) that a box touches."""
    lo = lambda c: F.floor(c / size).cast("long")
    xs, ys = F.sequence(lo(box["min_x"]), lo(box["max_x"])), F.sequence(lo(box["min_y"]), lo(box["max_y"]))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("bx"), j.alias("by")))))
