"""Rain snapshots: archives of gzip rasters, their names, choice, decoding and publication.

A raster is 1200 x 3600 little-endian float32, gzip-compressed; a file's name carries its time,
as in product.YYYYMMDD.HHMM.dat.gz.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewise.functions.rain import COLS, ROWS

PREFIX = "gsmap_gauge_now"
RASTER_BYTES = ROWS * COLS * 4


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def snapshot_time(name: Column) -> Column:
    """Timestamp in a file name (UTC); null if it has no valid one."""
    parts = F.split(name, "[.]")
    return F.try_to_timestamp(F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), F.lit("yyyyMMddHHmm"))


def snapshot_label(name: Column) -> Column:
    """Time in a file name as text, or "Unknown" if it has fewer than three parts or no valid time."""
    stamp = F.concat(F.date_format(snapshot_time(name), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
    return F.when(F.size(F.split(name, "[.]")) < 3, "Unknown").otherwise(F.coalesce(stamp, F.lit("Unknown")))


def list_archive(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, product, day, hhmm, size) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    name = file_name(F.col("path"))
    return files.select(
        "path",
        F.get(F.split(name, "[.]"), F.lit(0)).alias("product"),
        F.to_date(snapshot_time(name)).alias("day"),
        F.date_format(snapshot_time(name), "HHmm").alias("hhmm"),
        F.col("length").alias("size"),
    )


def inventory(listing: DataFrame, shown: int = 10) -> DataFrame:
    """Per product and day: the number of files, the first names, and how many more there are."""
    w = W.partitionBy("product", "day").orderBy("path")
    ranked = listing.select("product", "day", file_name(F.col("path")).alias("name"), F.row_number().over(w).alias("k"))
    rows = ranked.groupBy("product", "day").agg(F.count(F.lit(1)).alias("n_files"), F.sort_array(F.collect_list(F.when(F.col("k") <= shown, F.col("name")))).alias("names"))
    return rows.select("product", "day", "n_files", "names", F.greatest(F.col("n_files") - shown, F.lit(0)).cast("long").alias("n_more"))


def select_snapshot(listing: DataFrame, date: str | None = None, hour: str | None = None) -> DataFrame:
    """The last file of a day and hour (one row, or none).

    A date without three parts counts as "latest"; the hour only counts when a date is given.
    """
    name = file_name(F.col("path"))
    found = listing.filter(name.startswith(PREFIX) & name.endswith(".gz"))
    if date:
        parts = date.split("-")
        if len(parts) == 3:
            found = found.filter(F.get(F.split(name, "[.]"), F.lit(1)) == "".join(parts))
        if hour:
            found = found.filter(F.get(F.split(name, "[.]"), F.lit(2)).startswith(hour))
    best = found.agg(F.max_by("path", name).alias("path"))
    return best.filter("path is not null").select("path", file_name(F.col("path")).alias("name"), snapshot_time(file_name(F.col("path"))).alias("snap"))


def decode(files: DataFrame, box: tuple[int, int, int, int] | None = None, inclusive: bool = True) -> DataFrame:
    """binaryFile rows -> (path, is_valid, r, c, v); the window (r0, r1, c0, c1) is cut before rows are made.

    Payloads that are no whole raster give one row that is not valid (see ``quarantine``).
    """
    r0, r1, c0, c1 = box or (0, ROWS - 1, 0, COLS - 1)
    end = 1 if inclusive or box is None else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    raw = gzip.decompress(content)
                except (OSError, EOFError, zlib.error):
                    raw = b""
                if len(raw) < RASTER_BYTES:
                    yield pd.DataFrame({"path": [path], "is_valid": [False], "r": [None], "c": [None], "v": [None]}).astype({"r": "Int32", "c": "Int32", "v": "float32"})
                    continue
                grid = np.frombuffer(raw, "<f4", ROWS * COLS).reshape(ROWS, COLS)[r0 : r1 + end, c0 : c1 + end]
                for i in range(0, len(grid), 64):  # bounded batches, even for whole rasters
                    part = grid[i : i + 64]
                    r, c = np.indices(part.shape, np.int32)
                    yield pd.DataFrame({"path": path, "is_valid": True, "r": (r + r0 + i).ravel(), "c": (c + c0).ravel(), "v": part.ravel()})

    return files.select("path", "content").mapInPandas(run, "path string, is_valid boolean, r int, c int, v float")


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.filter("not is_valid").select("path")


def snapshots(spark: SparkSession, root: str, box: tuple[int, int, int, int] | None = None, inclusive: bool = True) -> DataFrame:
    """(snap, r, c, v) of all whole rasters below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(root)
    return decode(files, box, inclusive).filter("is_valid").select(snapshot_time(file_name(F.col("path"))).alias("snap"), "r", "c", "v")


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _path(spark, path)
    fs.delete(place, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a table that are whole, in order."""
    place, fs = _path(spark, path)
    found = [s.getPath() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_version(table: DataFrame, path: str, version: int, keep: int) -> None:
    """Write a version in a folder of its own and delete all but the newest ``keep`` whole ones.

    A version counts once it is whole, so readers go from one to the next without a gap; a reader must end before ``keep`` more versions
    are written.
    """
    table.write.mode("overwrite").parquet(f"{path}/version={version}")
    for old in versions(table.sparkSession, path)[:-keep]:
        delete(table.sparkSession, f"{path}/version={old}")


def publish_latest(cells: DataFrame, path: str, keep: int = 3) -> None:
    """Publish cells (they carry snap, source_file and the time of processing) as the next version; one publisher at a time."""
    version = max(versions(cells.sparkSession, path), default=-1) + 1
    write_version(cells.withColumn("processed_at", F.current_timestamp()), path, version, keep)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The published cells, or, where nothing is published yet, one row with an ``error``."""
    found = versions(spark, path)
    if not found:
        return spark.range(1).select(F.lit("no rain published").alias("error"))
    return spark.read.parquet(f"{path}/version={found[-1]}")
