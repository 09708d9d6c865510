"""Road, flood, site and rain tables derived from the star-schema tables of a folder.

The derivations are deterministic and written with doubles throughout, so that another engine computes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIOS = [(1, 0.2, 0.5, 0.3, 0.0, True), (2, 1.0, 0.0, 0.0, 0.0, True), (3, 0.0, 1.0, 0.0, 20.0, True), (4, 0.2, 0.5, 0.3, 40.0, True), (5, 0.2, 0.5, 0.3, 0.0, False)]

HALF_HOUR = "date_trunc('hour', ts) + make_interval(0, 0, 0, 0, 0, cast(minute(ts) div 30 * 30 as int), 0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lon(n: str) -> str:
    return f"(120.52D + ({n} % 40) * 0.024D)"


def _lat(n: str) -> str:
    return f"(14.02D + (({n} div 40) % 40) * 0.024D)"


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, ord, lon, lat)."""
    m = table(spark, sf_dir, "customer").count()
    return spark.range(m).selectExpr("id as node", "id as ord", f"{_lon('id')} as lon", f"{_lat('id')} as lat")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, u, v, key, length, name, risk_level, pts)."""
    m = table(spark, sf_dir, "customer").count()
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as ord",
        "o_custkey as u",
        f"(o_custkey + element_at(array(1, 7, 40, 280), cast(o_orderkey % 4 as int) + 1)) % {m} as v",
        "o_orderkey as key",
        "floor(o_totalprice / 10D + 0.5D) / 100D as length",
        "concat('road ', o_orderkey) as name",
        "cast(least(cast(substr(o_orderpriority, 1, 1) as int) - 1, 3) as double) as risk_level",
    )
    x, y = f"({_lon('u')} + {_lon('v')}) / 2 + 0.0003D", f"({_lat('u')} + {_lat('v')}) / 2"
    pts = f"array(struct({_lon('u')} as x, {_lat('u')} as y), struct({x} as x, {y} as y), struct({_lon('v')} as x, {_lat('v')} as y))"
    return o.selectExpr("*", f"{pts} as pts")


def flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, var, ring)."""
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as ord",
        "case when p_partkey % 50 = 0 then 'n/a' else cast(p_size % 4 as string) end as var",
        "120.52D + ((p_partkey * 37) % 80) * 0.012D as cx",
        "14.02D + ((p_partkey * 53) % 80) * 0.012D as cy",
        "p_size * 0.0004D as h",
    )
    ring = ", ".join(f"struct(cx {a} h as x, cy {b} h as y)" for a, b in ("--", "+-", "++", "-+", "--"))
    return p.selectExpr("ord", "var", f"array({ring}) as ring")


def flood_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, var, geom): the floods as multipolygons."""
    return flood(spark, sf_dir).select("ord", "var", F.array(F.array("ring")).alias("geom"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, name, barangay, lat, lng)."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.selectExpr(
        "s_suppkey as ord", "s_name as name", "n_name as barangay", "14.02D + ((s_suppkey * 29) % 78) * 0.012D + 0.003D as lat", "120.52D + ((s_suppkey * 31) % 78) * 0.012D + 0.003D as lng"
    )


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin_id, lat, lng): a point beside every node."""
    return road_nodes(spark, sf_dir).selectExpr("node as origin_id", "lat + 0.001D as lat", "lon - 0.002D as lng")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin_id, src, target): a trip for every nation, one row up and nine columns on."""
    m = table(spark, sf_dir, "customer").count()
    return table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long) as origin_id", f"cast(n_nationkey * 613 + 7 as long) % {m} as src", f"cast(n_nationkey * 613 + 56 as long) % {m} as target")


def jagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, ring): the floods with a vertex in the middle of each side, pushed out by 0.00002 or 0.0003 in turn."""
    f = flood(spark, sf_dir).selectExpr("ord", "ring[0].x as x0", "ring[0].y as y0", "ring[2].x as x1", "ring[2].y as y1")
    d = [f"(case when (ord + {k}) % 2 = 0 then 0.0003D else 0.00002D end)" for k in range(4)]
    at = ["x0, y0", f"(x0 + x1) / 2, y0 - {d[0]}", "x1, y0", f"x1 + {d[1]}, (y0 + y1) / 2", "x1, y1", f"(x0 + x1) / 2, y1 + {d[2]}", "x0, y1", f"x0 - {d[3]}, (y0 + y1) / 2", "x0, y0"]
    points = ", ".join("struct({} as x, {} as y)".format(*p.rsplit(", ", 1)) for p in at)
    return f.selectExpr("ord", f"array({points}) as ring")


def rain(spark: SparkSession, sf_dir: str, half_hours: bool = False) -> DataFrame:
    """(snap, r, c, v): raw intensities, the last event of each cell and day (or half hour)."""
    snap = HALF_HOUR if half_hours else "date_trunc('day', ts)"
    e = table(spark, sf_dir, "events").selectExpr(
        f"{snap} as snap",
        "cast(450 + event_id % 11 as int) as r",
        "cast(1205 + (event_id div 11) % 11 as int) as c",
        "struct(ts, event_id) as at",
        "cast(case when event_type = 'error' then -value else value end as double) as raw",
    )
    return e.groupBy("snap", "r", "c").agg(F.max_by("raw", "at").alias("v"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snap, r, c, v) of the last day."""
    grid = rain(spark, sf_dir)
    last = grid.agg(F.max("snap").alias("snap"))
    return grid.join(F.broadcast(last), "snap", "left_semi")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, product, day, hhmm, snap): a listing with one file a half hour that has events."""
    e = table(spark, sf_dir, "events").selectExpr(f"{HALF_HOUR} as t").distinct()
    name = "concat('gsmap_gauge_now.', date_format(t, 'yyyyMMdd'), '.', date_format(t, 'HHmm'), '.dat.gz')"
    return e.selectExpr(f"concat('/now/half_hour_G/', date_format(t, 'yyyy/MM/dd'), '/', {name}) as path", "'now/half_hour_G' as product", "cast(t as date) as day", "date_format(t, 'HHmm') as hhmm", "t as snap")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario_id int, w_len double, w_risk double, w_rain double, manual_rain double, simulation boolean")
