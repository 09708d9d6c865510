"""Rainfall-grid arithmetic and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grid: rows from 60 degrees north downwards, columns from 0 degrees east, 0.1 degree steps.
ROWS, COLS, TOP, STEP = 1200, 3600, 60.0, 0.1


def lat_to_row(lat: Column) -> Column:
    return ((F.lit(TOP) - lat) / F.lit(STEP)).cast("int")


def lon_to_col(lon: Column) -> Column:
    return (lon / F.lit(STEP)).cast("int")


def clean_intensity(v: Column) -> Column:
    """Values below 0 or above 500, and NaN, count as no rain."""
    return F.when((v < 0) | (v > 500) | F.isnan(v), F.lit(0.0)).otherwise(v.cast("double"))


def rain_risk(i: Column) -> Column:
    return F.when(i > 30, 3).when(i > 15, 2).when(i > 5, 1).otherwise(0)


def rain_band(i: Column) -> Column:
    return F.when(i > 30, "extreme").when(i > 15, "high").when(i > 5, "medium").when(i > 0.1, "low").otherwise("none")


def cell_corners(r: Column, c: Column) -> tuple[Column, Column, Column, Column]:
    """(min_lon, max_lon, min_lat, max_lat) of a grid cell."""
    top, left = F.lit(TOP) - r * F.lit(STEP), c * F.lit(STEP)
    return left, left + F.lit(STEP), top - F.lit(STEP), top
