import gzip
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.functions import rain
from tidewise.operators import rainfall
from tidewise.sources import fixtures as fx
from tidewise.sources import grids
from tidewise.streaming import latest

G = "snap timestamp, r int, c int, v double"


def raster(path, values, cut=None):
    a = np.zeros((1200, 3600), "<f4")
    for (r, c), v in values.items():
        a[r, c] = v
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(a.tobytes()[:cut], 1))


def at(h, d=1):
    return datetime(2026, 2, d, h)


def test_indices_truncate(spark):
    row = spark.range(1).select(rain.lat_to_row(F.lit(14.6)), rain.lat_to_row(F.lit(14.8)), rain.lon_to_col(F.lit(121.0)), rain.lon_to_col(F.lit(121.2))).first()
    assert tuple(row) == (453, 452, 1210, 1212) and rainfall.region_box(rainfall.CITY) == (452, 453, 1210, 1212)
    cells = spark.range(440, 470).selectExpr("cast(id as int) as r").join(spark.range(1200, 1220).selectExpr("cast(id as int) as c"), F.lit(True))
    assert rainfall.window(cells, rainfall.CITY, False).count() == 2 and rainfall.window(cells, rainfall.SYNC).count() == 121


def test_clean_and_nan(spark):
    v = spark.createDataFrame([(-1.0,), (501.0,), (float("nan"),), (500.0,)], "v double")
    assert [r[0] for r in v.select(rain.clean_intensity(F.col("v"))).collect()] == [0, 0, 0, 500]
    g = spark.createDataFrame([(at(1), 452, 1210, float("nan")), (at(1), 452, 1211, 9.0), (at(2), 452, 1210, 3.0)], G)
    top = rainfall.region_max(g, rainfall.CITY)
    assert top.filter(rainfall.exceeds(F.col("max_v"), 1.0)).count() == 1
    assert rainfall.first_wet_cell(g, rainfall.NORTH, 0.5).filter(F.col("snap") == at(1)).first().v == 9.0


def test_first_wet_and_fallback(spark):
    g = spark.createDataFrame([(at(1), 410, 1200, 0.6), (at(1), 410, 1190, 0.9), (at(1), 405, 1250, 0.5), (at(2), 452, 1210, 0.0), (at(2), 430, 1210, 4.0), (at(3), 452, 1211, 2.0), (at(3), 430, 1210, 9.0)], G)
    wet = rainfall.first_wet_cell(g, rainfall.NORTH, 0.5).filter(F.col("snap") == at(1)).first()
    assert (wet.lat, wet.lon, wet.v) == (pytest.approx(19.0), pytest.approx(119.0), 0.9)
    got = {r.snap.hour: (r["where"], r.max_v) for r in rainfall.region_with_fallback(g).collect()}
    assert got == {1: ("wider", None), 2: ("wider", 4.0), 3: ("region", 2.0)}


def test_surface(spark):
    grid = rainfall.surface_grid(spark)
    assert grid.count() == 16
    points = rainfall.surface_points(spark, "nonsense")
    assert points.first().intensity == 25
    plain = {(r.lat, r.lon): r.intensity for r in rainfall.decay_surface(points, grid).collect()}
    near = {(r.lat, r.lon): r.intensity for r in rainfall.decay_surface(points, grid, reach=2.0).collect()}
    for (a, b), v in plain.items():
        assert v == pytest.approx(25 * np.exp(-20 * np.hypot(a - 14.68, b - 121.05))) and near[a, b] == pytest.approx(v)
    # A place whose points in the bins around it all lie out of reach.
    far = rainfall.decay_surface(spark.createDataFrame([(1.9, 1.9, 5.0)], "lat double, lon double, intensity double"), spark.createDataFrame([(0.0, 0.0), (10.0, 10.0)], "lat double, lon double"), reach=1.0)
    assert sorted(map(tuple, far.collect())) == [(0.0, 0.0, 0.0), (10.0, 10.0, 0.0)]
    negative = points.withColumn("intensity", F.lit(-1.0))
    assert {r.intensity for r in rainfall.decay_surface(negative, grid).collect()} == {0.0}
    assert rainfall.grid_or_fallback(grid.limit(0), grid).count() == 16 and rainfall.grid_or_fallback(grid.limit(3), grid).count() == 3


def test_intensity_at(spark):
    g = spark.createDataFrame([(at(1), 453, 1210, 7.0), (at(1), 453, 1211, 8.0), (at(1), 454, 1210, 600.0)], G)
    points = spark.createDataFrame([(1, 14.65, 121.05), (2, 14.65, 121.15), (3, 14.55, 121.05), (4, 10.0, 100.0), (5, 14.65, 121.1)], "id long, lat double, lon double")
    got = {r.id: r.rain for r in rainfall.intensity_at(points, rainfall.cells_of(g)).collect()}
    assert got == {1: 7.0, 2: 8.0, 3: 0.0, 4: 0.0, 5: 7.0}
    assert {r.rain for r in rainfall.intensity_at(points, rainfall.cells_of(g, strict_compat=True)).collect()} == {0.0}
    assert {r.rain for r in rainfall.intensity_at(points, rainfall.cells_of(g.limit(0))).collect()} == {0.0}


def test_sampling(spark):
    rows = [(f"/a/x.2026020{d}.{h:02d}00.dat.gz", "p", at(0, d).date(), f"{h:02d}00", at(h, d)) for d in (1, 2, 3) for h in range(5)]
    listing = spark.createDataFrame(rows, "path string, product string, day date, hhmm string, snap timestamp")
    hours = lambda *s, **k: sorted(r.hhmm[:2] for r in rainfall.sample_files(listing.filter("day = '2026-02-01'"), s, **k).collect())
    assert hours("first", "middle", "last") == ["00", "02", "04"] and hours("every", every=2) == ["00", "02", "04"] and hours("even_hours") == ["00", "02", "04"] and len(hours("all")) == 5
    grid = spark.createDataFrame([(at(1, 2), 452, 1210, 3.0), (at(3, 3), 452, 1211, 4.0), (at(4, 3), 452, 1211, 5.0)], G)
    scan = lambda **k: [(r.day.day, r.hhmm) for r in rainfall.scan_archive(listing, grid, rainfall.CITY, "2026-02-01", "2026-02-28", 1.0, **k).collect()]
    assert scan() == [(2, "0100")] and scan(descending=True) == [(3, "0300")] and scan(descending=True, all_hits=True) == [(3, "0300"), (3, "0400"), (2, "0100")]
    assert scan(max_days=1) == [] and scan(sampling=("last",)) == [(3, "0400")]


def test_names_and_choice(spark):
    names = ["gsmap_gauge_now.20260204.0130.dat.gz", "gsmap_gauge_now.20260204.1430.dat.gz", "gsmap_gauge_now.20260203.2330.dat.gz", "gsmap_gauge_now.x.y.dat.gz", "other.20270101.0000.gz", "bad.gz", "gsmap_gauge_now.20280101.0000.txt"]
    listing = spark.createDataFrame([(f"/p/{n}",) for n in names], "path string")
    labels = {r[0]: r[1] for r in listing.select(grids.file_name(F.col("path")), grids.snapshot_label(grids.file_name(F.col("path")))).collect()}
    assert labels[names[0]] == "2026-02-04 01:30 UTC" and labels["bad.gz"] == "Unknown" and labels[names[3]] == "Unknown"
    pick = lambda *a: [r.name for r in grids.select_snapshot(listing, *a).collect()]
    assert pick("2026-02-04") == [names[1]] and pick("2026-02-04", "01") == [names[0]] and pick("2025-01-01") == []
    assert pick("someday") == [names[3]] and pick() == [names[3]] and pick(None, "01") == [names[3]] and pick("someday", "23") == [names[2]]


def test_rasters(spark, tmp_path):
    raster(tmp_path / "2026/02/04/gsmap_gauge_now.20260204.0130.dat.gz", {(450, 1205): 3.5, (460, 1215): -4, (461, 1215): 9})
    raster(tmp_path / "2026/02/04/gsmap_gauge_now.20260204.0200.dat.gz", {}, cut=1000)
    (tmp_path / "2026/02/04/gsmap_gauge_now.20260204.0230.dat.gz").write_bytes(b"no gzip")
    listing = grids.list_archive(spark, str(tmp_path))
    assert {(r.product, r.hhmm) for r in listing.collect()} == {("gsmap_gauge_now", h) for h in ("0130", "0200", "0230")}
    inv = grids.inventory(listing, shown=2).first()
    assert (inv.n_files, len(inv.names), inv.n_more) == (3, 2, 1)
    got = grids.snapshots(spark, str(tmp_path), rainfall.region_box(rainfall.SYNC))
    assert got.count() == 121 and {(r.r, r.c, r.v) for r in got.filter("v <> 0").collect()} == {(450, 1205, 3.5), (460, 1215, -4.0)}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert grids.quarantine(grids.decode(files)).count() == 2
    grids.publish_latest(rainfall.cells_of(got).withColumn("source_file", F.lit("x")), str(tmp_path / "latest"))
    assert "processed_at" in grids.read_latest(spark, str(tmp_path / "latest")).columns
    stats = rainfall.grid_stats(got).first()
    assert (stats.n_cells, stats.max_v, stats.mean_v) == (121, 3.5, pytest.approx(3.5 / 121))


def test_stream_keeps_the_newest(spark, tmp_path):
    box, land, table = (450, 450, 1205, 1206), tmp_path / "land", str(tmp_path / "table")
    run = lambda: latest.run(spark, str(land), table, str(tmp_path / "ck"), box).awaitTermination()
    raster(land / "gsmap_gauge_now.20260204.0200.dat.gz", {(450, 1205): 2, (450, 1206): 700})
    run()
    raster(land / "gsmap_gauge_now.20260204.0130.dat.gz", {(450, 1205): 1})  # an older one comes late
    run()
    got = {(r.c, r.snap.hour, r.v) for r in latest.read_latest(spark, table).collect()}
    assert got == {(1205, 2, 2.0), (1206, 2, 0.0)}
    raster(land / "gsmap_gauge_now.20260204.0300.dat.gz", {(450, 1205): 5})
    run()
    assert {(r.c, r.snap.hour, r.v) for r in latest.read_latest(spark, table).collect()} == {(1205, 3, 5.0), (1206, 3, 0.0)}
    assert latest.read_latest(spark, str(tmp_path / "none")) is None


def test_searches_that_share_maxima(spark, sf):
    """Maxima of several regions in one pass give the hits of a search of its own."""
    grid, listing = fx.rain(spark, sf, half_hours=True), fx.archive(spark, sf)
    shared = rainfall.region_maxima(grid, [rainfall.CITY, rainfall.ARCHIPELAGO])
    for i, region in enumerate((rainfall.CITY, rainfall.ARCHIPELAGO)):
        ask = ("2024-01-03", "2024-01-28", 0.0, ("every",), 2, True, 20, True)
        want = rainfall.scan_archive(listing, grid, region, *ask).collect()
        assert (want or i == 0) and rainfall.scan_maxima(listing, shared.select("snap", F.col(f"m{i}").alias("max_v")).filter("max_v is not null"), *ask).collect() == want


def test_nothing_published(spark, tmp_path):
    assert [r.error for r in grids.read_latest(spark, f"{tmp_path}/none").collect()] == ["no rain published"]


def test_search_stops_at_the_first_hit(spark, tmp_path):
    """Real rasters of 20 days with a hit on the fifth and the last: files are read in batches of 1, 2 and 4 days."""
    for d in range(1, 21):
        raster(tmp_path / f"gsmap_gauge_now.202602{d:02d}.0130.dat.gz", {(452, 1211): 9.0 + d if d in (5, 20) else 0.5})
    listing = grids.list_archive(spark, str(tmp_path)).withColumn("snap", grids.snapshot_time(grids.file_name(F.col("path"))))
    asked = []

    def read(files):
        paths = [r.path for r in files.select("path").collect()]
        asked.append(len(paths))
        loaded = spark.read.format("binaryFile").load(paths)
        return grids.decode(loaded, rainfall.region_box(rainfall.CITY)).filter("is_valid").select(grids.snapshot_time(grids.file_name(F.col("path"))).alias("snap"), "r", "c", "v")

    search = lambda limit, **k: [(r.day.day, r.max_v) for r in rainfall.search_archive(listing, read, rainfall.CITY, "2026-02-01", "2026-02-28", limit, **k).collect()]
    assert search(5.0) == [(5, 14.0)] and asked == [1, 2, 4]
    asked.clear()
    assert search(5.0, descending=True) == [(20, 29.0)] and asked == [1]
    asked.clear()
    assert search(100.0) == [] and asked == [1, 2, 4, 8, 5]
    asked.clear()
    assert search(5.0, max_days=4, first_days=3) == [] and asked == [3, 1]
    assert rainfall.search_archive(listing.limit(0), read, rainfall.CITY, "2026-02-01", "2026-02-28", 1.0).collect() == []


def test_ingestion_of_rasters(spark, tmp_path):
    """Late, repeated, broken and misnamed files; a batch that is run again changes nothing; old versions go."""
    land, out, box = tmp_path / "land", str(tmp_path / "out"), (450, 450, 1205, 1206)
    run = lambda ck="ck": latest.ingest(latest.read_files(spark, str(land)), out, str(tmp_path / ck), box).awaitTermination()
    cells = lambda: sorted((r.c, r.snap.hour, r.v) for r in latest.read_latest(spark, f"{out}/cells").collect())
    aside = lambda: sorted(r.path.split("/")[-1] for r in latest.read_quarantine(spark, out).collect())
    name = "gsmap_gauge_now.20260204.{}.dat.gz"
    raster(land / name.format("0200"), {(450, 1205): 2, (450, 1206): 700})
    raster(land / name.format("0400"), {(450, 1205): 8}, cut=500)
    run()
    assert cells() == [(1205, 2, 2.0), (1206, 2, 0.0)] and aside() == [name.format("0400")]
    raster(land / name.format("0130"), {(450, 1205): 1})
    raster(land / "nameless.gz", {(450, 1205): 3})
    run()
    assert cells() == [(1205, 2, 2.0), (1206, 2, 0.0)] and aside() == [name.format("0400"), "nameless.gz"]
    for h in (3, 5, 6):
        raster(land / name.format(f"0{h}00"), {(450, 1205): h})
        run()
    assert cells() == [(1205, 6, 6.0), (1206, 6, 0.0)] and grids.versions(spark, f"{out}/cells") == [2, 3, 4]
    run("again")  # without its checkpoint the job reads all files again, as batch 0
    assert (1205, 6, 6.0) in cells() and sorted(set(aside())) == [name.format("0400"), "nameless.gz"]


def test_published_versions(spark, tmp_path):
    """Readers of a version go on while the next ones are written; parts of a version that is not whole do not count."""
    path = str(tmp_path / "latest")
    for i in range(4):
        grids.publish_latest(spark.range(i + 1).selectExpr("id", "'s' as snap", "'f' as source_file"), path)
        held = grids.read_latest(spark, path) if i == 1 else held if i else None
    (tmp_path / "latest" / "version=9").mkdir()
    assert grids.versions(spark, path) == [1, 2, 3] and held.count() == 2 and grids.read_latest(spark, path).count() == 4
