"""Operators on rain grids: windows, regional maxima, archive searches, surfaces and look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewise.functions.rain import clean_intensity, lat_to_row, lon_to_col, rain_risk
from tidewise.plans.scratch import Scratch, join_checked, small

#: Regions as (south, north, west, east) in degrees.
CITY = (14.6, 14.8, 121.0, 121.2)
SYNC = (14.0, 15.0, 120.5, 121.5)
ARCHIPELAGO = (5.0, 20.0, 115.0, 130.0)
SCAN_V2 = (4.0, 19.0, 116.0, 127.0)
NORTH = (10.0, 20.0, 118.0, 126.0)
SOUTH = (4.0, 10.0, 118.0, 127.0)
WIDER = (12.0, 18.0, 120.0, 123.0)


def region_box(region: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """Row and column bounds (r0, r1, c0, c1), by double division and truncation."""
    south, north, west, east = region
    return int((60.0 - north) / 0.1), int((60.0 - south) / 0.1), int(west / 0.1), int(east / 0.1)


def in_region(region: tuple[float, float, float, float], inclusive: bool = False) -> Column:
    """Whether a cell (r, c) lies in a region; archive searches use half-open boxes, the sync closed ones."""
    south, north, west, east = region
    r0, r1, c0, c1 = lat_to_row(F.lit(north)), lat_to_row(F.lit(south)), lon_to_col(F.lit(west)), lon_to_col(F.lit(east))
    r, c = F.col("r"), F.col("c")
    return (r >= r0) & (c >= c0) & ((r <= r1) & (c <= c1) if inclusive else (r < r1) & (c < c1))


def window(grid: DataFrame, region: tuple[float, float, float, float], inclusive: bool = True) -> DataFrame:
    return grid.filter(in_region(region, inclusive))


def region_max(grid: DataFrame, region: tuple[float, float, float, float], inclusive: bool = False) -> DataFrame:
    """(snap, max_v) of the raw values in a region; a NaN in it makes the maximum NaN, which exceeds no threshold."""
    return window(grid, region, inclusive).groupBy("snap").agg(F.max(F.col("v").cast("double")).alias("max_v"))


def exceeds(v: Column, threshold: float) -> Column:
    """v > threshold; NaN exceeds nothing."""
    return ~F.isnan(v) & (v > threshold)


def first_wet_cell(grid: DataFrame, region: tuple[float, float, float, float], threshold: float) -> DataFrame:
    """(snap, lat, lon, v) of the first cell in row-major order above a threshold; places count from the region's corner."""
    north, west = region[1], region[2]
    r0, c0 = lat_to_row(F.lit(north)), lon_to_col(F.lit(west))
    wet = window(grid, region, False).filter(exceeds(F.col("v").cast("double"), threshold))
    best = wet.groupBy("snap").agg(F.min(F.struct("r", "c", F.col("v").cast("double").alias("v"))).alias("b"))
    return best.select("snap", (F.lit(north) - (F.col("b.r") - r0) * F.lit(0.1)).alias("lat"), (F.lit(west) + (F.col("b.c") - c0) * F.lit(0.1)).alias("lon"), F.col("b.v").alias("v"))


def sample_files(listing: DataFrame, sampling: tuple[str, ...], every: int = 1) -> DataFrame:
    """Files chosen by their place k of n in a day's order (names): all, every (k-th), first, middle, last, even_hours."""
    w = W.partitionBy("product", "day")
    t = listing.withColumns({"k": F.row_number().over(w.orderBy("path")) - 1, "n": F.count(F.lit(1)).over(w)})
    tests = {
        "all": F.lit(True),
        "every": F.col("k") % every == 0,
        "first": F.col("k") == 0,
        "middle": F.col("k") == F.floor(F.col("n") / 2),
        "last": F.col("k") == F.col("n") - 1,
        "even_hours": F.substring("hhmm", 1, 2).cast("int") % 2 == 0,
    }
    keep = F.lit(False)
    for s in sampling:
        keep = keep | tests[s]
    return t.filter(keep).drop("k", "n")


def choose_days(listing: DataFrame, start: str, end: str, descending: bool = False, max_days: int | None = None) -> DataFrame:
    """Files of a period, with ``day_rank``: the place of their day in the order of the search."""
    t = listing.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    days = t.select("product", "day").distinct()
    w = W.partitionBy("product").orderBy(F.col("day").desc() if descending else F.col("day"))
    ranked = days.withColumn("day_rank", F.row_number().over(w))
    return t.join(ranked if max_days is None else ranked.filter(F.col("day_rank") <= max_days), ["product", "day"])


def scan_archive(
    listing: DataFrame,
    grid: DataFrame,
    region: tuple[float, float, float, float],
    start: str,
    end: str,
    threshold: float,
    sampling: tuple[str, ...] = ("all",),
    every: int = 1,
    descending: bool = False,
    max_days: int | None = None,
    all_hits: bool = False,
) -> DataFrame:
    """Sampled snapshots in which a region's maximum exceeds a threshold: (day, hhmm, path, max_v).

    The listing (path, product, day, hhmm, snap) is sampled before any values are read; all samples are then searched at
    once, and the first hit in the order of the search (or every hit) is returned.
    """
    files = sample_files(choose_days(listing, start, end, descending, max_days), sampling, every)
    hits = region_max(grid.join(files.select("snap").distinct(), "snap", "left_semi"), region)
    return _hits(files, hits, threshold, all_hits)


def search_archive(
    listing: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    region: tuple[float, float, float, float],
    start: str,
    end: str,
    threshold: float,
    sampling: tuple[str, ...] = ("all",),
    every: int = 1,
    descending: bool = False,
    max_days: int | None = None,
    first_days: int = 1,
) -> DataFrame:
    """The first hit of ``scan_archive``, reading no more of the archive than twice what lies before it.

    ``read`` makes the grid (snap, r, c, v) of some files of the listing.  Days are searched in batches of 1, 2, 4, ... (``first_days`` at
    first), each batch in parallel, until one has a hit; only the largest day rank and the found row reach the driver.
    """
    scratch = Scratch(listing.sparkSession, "search")
    files = scratch.write(sample_files(choose_days(listing, start, end, descending, max_days), sampling, every), "files")
    last, done, step = files.agg(F.max("day_rank")).first()[0] or 0, 0, first_days
    while done < last:
        some = files.filter(F.col("day_rank").between(done + 1, done + step))
        hits = scratch.write(_hits(some, region_max(read(some), region), threshold, False), "hits")
        if not hits.isEmpty():
            return hits
        done, step = done + step, step * 2
    return _hits(files, files.limit(0).select("snap", F.lit(None).cast("double").alias("max_v")), threshold, False)


def _hits(files: DataFrame, maxima: DataFrame, threshold: float, all_hits: bool) -> DataFrame:
    out = files.join(maxima.filter(exceeds(F.col("max_v"), threshold)), "snap").orderBy("day_rank", "path").select("day", "hhmm", "path", "max_v")
    return out if all_hits else out.limit(1)


def region_maxima(grid: DataFrame, regions: list[tuple[float, float, float, float]]) -> DataFrame:
    """(snap, m0, m1, ...): the maxima of several regions in one pass, for several searches of one archive."""
    return grid.groupBy("snap").agg(*[F.max(F.when(in_region(x), F.col("v").cast("double"))).alias(f"m{i}") for i, x in enumerate(regions)])


def scan_maxima(listing: DataFrame, maxima: DataFrame, start: str, end: str, threshold: float, sampling: tuple[str, ...] = ("all",), every: int = 1, descending: bool = False, max_days: int | None = None, all_hits: bool = False) -> DataFrame:
    """``scan_archive`` over maxima (snap, max_v) that are there already."""
    return _hits(sample_files(choose_days(listing, start, end, descending, max_days), sampling, every), maxima, threshold, all_hits)


def region_with_fallback(grid: DataFrame, region: tuple[float, float, float, float] = CITY, wider: tuple[float, float, float, float] = WIDER) -> DataFrame:
    """(snap, where, max_v): the region's maximum if it is above 0, else that of the wider region; both in one pass."""
    v = F.col("v").cast("double")
    t = grid.groupBy("snap").agg(F.max(F.when(in_region(region), v)).alias("a"), F.max(F.when(in_region(wider), v)).alias("b"))
    near = exceeds(F.coalesce("a", F.lit(0.0)), 0.0)
    return t.select("snap", F.when(near, "region").otherwise("wider").alias("where"), F.when(near, F.col("a")).otherwise(F.col("b")).alias("max_v"))


def grid_stats(grid: DataFrame) -> DataFrame:
    """(snap, n_cells, max_v, mean_v) of cleaned values."""
    v = clean_intensity(F.col("v"))
    return grid.groupBy("snap").agg(F.count(F.lit(1)).alias("n_cells"), F.max(v).alias("max_v"), F.avg(v).alias("mean_v"))


def rain_report(grid: DataFrame, region: tuple[float, float, float, float] = CITY) -> DataFrame:
    """(date, hour, max_v) of every snapshot."""
    return region_max(grid, region).select(F.date_format("snap", "yyyy-MM-dd").alias("date"), F.date_format("snap", "HH").alias("hour"), "max_v")


#: Reference points (latitude, longitude, intensity) of the interpolated surface by timeframe.
SURFACE_POINTS = {"now": (14.68, 121.05, 25.0), "1h": (14.70, 121.08, 40.0), "3h": (14.75, 121.12, 15.0), "6h": (14.65, 121.00, 5.0)}


def surface_points(spark, timeframe: str = "now") -> DataFrame:
    """The points of a timeframe; unknown ones count as "now"."""
    return spark.createDataFrame([SURFACE_POINTS.get(timeframe, SURFACE_POINTS["now"])], "lat double, lon double, intensity double")


def surface_grid(spark, lat0: float = 14.60, lon0: float = 121.00, lat1: float = 14.76, lon1: float = 121.16, step: float = 0.05) -> DataFrame:
    """(lat, lon) by repeated addition of the step up to the last bounds."""

    def axis(lo: float, hi: float) -> list[float]:
        out = []
        while lo <= hi:
            out.append(lo)
            lo += step
        return out

    return spark.createDataFrame([(a, b) for a in axis(lat0, lat1) for b in axis(lon0, lon1)], "lat double, lon double")


def decay_surface(points: DataFrame, grid: DataFrame, k: float = 20.0, reach: float | None = None) -> DataFrame:
    """(lat, lon) of a grid and (lat, lon, intensity) of points -> intensity: the sum of intensity * exp(-k * distance), at least 0.

    The plain form lets every point act on every place: the points are a small table (checked), and go to the grid by
    broadcast.  ``reach`` joins points to places within that distance on bins instead, for many points (a reach of 2 leaves out less than
    exp(-40) of a point); places without a point in reach have 0.
    """
    p = points.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), "intensity")
    d = F.hypot(F.col("lat") - F.col("plat"), F.col("lon") - F.col("plon"))
    if reach is None:
        if not small(p):
            raise ValueError("too many points for the plain form: give a reach")
        pairs = grid.join(F.broadcast(p), F.lit(True), "left")
    else:
        at = lambda c: F.floor(F.col(c) / reach).cast("long")
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        near = p.select("*", F.inline(around)).withColumns({"bi": at("plat") + F.col("i"), "bj": at("plon") + F.col("j")})
        pairs = grid.withColumns({"bi": at("lat"), "bj": at("lon")}).join(near, ["bi", "bj"], "left")
    part = F.col("intensity") * F.exp(-F.lit(k) * d)
    part = part if reach is None else F.when(d <= reach, part)
    return pairs.groupBy("lat", "lon").agg(F.greatest(F.lit(0.0), F.coalesce(F.sum(part), F.lit(0.0))).alias("intensity"))


def grid_or_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary grid if it has rows, else the fallback."""
    return primary.unionByName(fallback.join(primary.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti"))


def cells_of(grid: DataFrame, strict_compat: bool = False) -> DataFrame:
    """(r, c, v) of one snapshot -> cells (ord, r, c, min_lon, max_lon, min_lat, max_lat, intensity).

    The order is that of the grid, row by row.  With strict_compat the latitude bounds stand the wrong way round, as
    taken from a ring that begins at its top left corner, so that look-ups find nothing.
    """
    top, left = F.lit(60.0) - F.col("r") * F.lit(0.1), F.col("c") * F.lit(0.1)
    lo, hi = top - F.lit(0.1), top
    lo, hi = (hi, lo) if strict_compat else (lo, hi)
    return grid.select((F.col("r").cast("long") * 3600 + F.col("c")).alias("ord"), "r", "c", left.alias("min_lon"), (left + F.lit(0.1)).alias("max_lon"), lo.alias("min_lat"), hi.alias("max_lat"), clean_intensity(F.col("v")).alias("intensity"))


def intensity_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, lat, lon) -> (id, rain): intensity of the first cell whose closed bounds hold the point, else 0.

    A point is looked up in its own cell, and in a cell beside it only if it lies on their border up to rounding.
    """
    place = {"r": (F.lit(60.0) - F.col("lat")) / F.lit(0.1), "c": F.col("lon") / F.lit(0.1)}

    def around(x: Column) -> Column:
        near = lambda d: F.when(F.floor(x + F.lit(d)) != F.floor(x), F.floor(x + F.lit(d)).cast("int"))
        return F.array_compact(F.array(F.floor(x).cast("int"), near(-1e-6), near(1e-6)))

    cand = points.select("id", "lat", "lon", F.explode_outer(around(place["r"])).alias("r")).select("id", "lat", "lon", "r", F.explode_outer(around(place["c"])).alias("c"))
    held = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    hit = join_checked(cand, cells.select("r", "c", "ord", "min_lat", "max_lat", "min_lon", "max_lon", "intensity"), ["r", "c"], "left")
    best = hit.groupBy("id").agg(F.min(F.when(held, F.struct("ord", "intensity"))).alias("b"))
    return best.select("id", F.coalesce("b.intensity", F.lit(0.0)).alias("rain"))


def band_totals(cells: DataFrame, band: Column) -> DataFrame:
    return cells.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_cells"), F.max(rain_risk(F.col("intensity"))).cast("int").alias("risk"))
