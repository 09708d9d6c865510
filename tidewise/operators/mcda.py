"""Multi-criteria scores of edges and paths: weighted sums and TOPSIS, for many scenarios at once.

Scenario tables (one row a setting of the sliders), and sums by scenario, are broadcast if they are small, as they are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.operators.rainfall import intensity_at
from tidewise.plans.scratch import Scratch, join_checked

CRITERIA = ("length", "risk", "rainfall")
WEIGHT = {"length": "w_len", "risk": "w_risk", "rainfall": "w_rain"}


def or_value(c: Column, other: float) -> Column:
    """The number itself unless it is null, NaN or 0."""
    return F.when(c.isNull() | F.isnan(c) | (c == 0), F.lit(other)).otherwise(c)


def mid_points(roads: DataFrame) -> DataFrame:
    mid = geo.mid_vertex(F.col("pts"))
    return roads.select(F.col("ord").alias("id"), mid["y"].alias("lat"), mid["x"].alias("lon"))


def edge_criteria(roads: DataFrame, cells: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, ord, length, risk, rainfall and the weights), one row per road and scenario.

    In simulation rain is the scenario's, else that at the road's mid vertex.  Both directions of a road have the same
    criteria, and doubling every row changes no score, so a road is one row.
    """
    base = roads.select("ord", or_value(F.col("length"), 1.0).alias("length"), or_value(F.col("risk_level"), 0.0).alias("risk"))
    base = base.join(intensity_at(mid_points(roads), cells), base["ord"] == F.col("id")).drop("id")
    return join_checked(base, scenarios, F.lit(True)).select(
        "scenario_id", "ord", "length", "risk", F.when(F.col("simulation"), F.col("manual_rain")).otherwise(F.col("rain")).alias("rainfall"), *WEIGHT.values(), "simulation"
    )


def minmax(x: Column, lo: Column, hi: Column, cost: bool = True) -> Column:
    """0..1 between bounds, turned round for benefits; 0.5 if the bounds are equal."""
    n = (x - lo) / (hi - lo)
    return F.when(hi == lo, F.lit(0.5)).otherwise(n if cost else 1 - n)


def _extremes(keys: list[str], rows: DataFrame, zero_norm: float, *more: Column) -> DataFrame:
    """Norms, and extremes of the weighted criteria, by ``keys``: one aggregate."""
    sums = [F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"norm_{c}") for c in CRITERIA]
    # All criteria are divided by one positive norm and weighted, so ideal points follow from the extremes.
    ends = [f(F.col(c) * F.col(WEIGHT[c])).alias(f"{name}_{c}") for c in CRITERIA for f, name in ((F.min, "lo"), (F.max, "hi"))]
    t = rows.groupBy(*keys).agg(*sums, *ends, *more)
    return t.withColumns({f"norm_{c}": F.when(F.col(f"norm_{c}") == 0, F.lit(zero_norm)).otherwise(F.col(f"norm_{c}")) for c in CRITERIA})


def _with_closeness(t: DataFrame) -> DataFrame:
    square = lambda end: sum(((F.col(c) * F.col(WEIGHT[c]) - F.col(f"{end}_{c}")) / F.col(f"norm_{c}")) ** 2 for c in CRITERIA)
    best, worst = F.sqrt(square("lo")), F.sqrt(square("hi"))
    close = F.when(best + worst == 0, F.lit(0.0)).otherwise(worst / (best + worst))
    return t.withColumn("closeness", close).drop(*[f"{p}_{c}" for p in ("norm", "lo", "hi") for c in CRITERIA])


def topsis(rows: DataFrame, keys: list[str], zero_norm: float) -> DataFrame:
    """Adds ``closeness`` within the groups of ``keys``; all criteria are costs."""
    return _with_closeness(rows.join(_extremes(keys, rows, zero_norm), keys))


def score_edges(criteria: DataFrame) -> DataFrame:
    """Adds wsm, closeness and cost to edge criteria: bounds of length from the data, of risk 0..3, of rain 0..max(10, data).

    The criteria are written once and summed in one pass.
    """
    scratch = Scratch(criteria.sparkSession, "scores")
    rows = scratch.write(criteria, "criteria")
    bounds = [F.min("length").alias("len_lo"), F.max("length").alias("len_hi"), F.greatest(F.lit(10.0), F.max("rainfall")).alias("rain_hi")]
    t = join_checked(rows, scratch.write(_extremes(["scenario_id"], rows, 1.0, *bounds), "sums"), "scenario_id")
    wsm = (
        F.col("w_len") * minmax(F.col("length"), F.col("len_lo"), F.col("len_hi"))
        + F.col("w_risk") * minmax(F.col("risk"), F.lit(0.0), F.lit(3.0))
        + F.col("w_rain") * minmax(F.col("rainfall"), F.lit(0.0), F.col("rain_hi"))
    )
    t = t.withColumn("wsm", wsm).drop("len_lo", "len_hi", "rain_hi")
    return _with_closeness(t).withColumn("cost", F.col("length") * (1 + 5 * F.col("wsm")))


def live_cost(length: Column, static: Column, rain: Column) -> Column:
    """Cost outside simulation: length times 1.5, 3 or 10 by the higher of static and rain risk."""
    from tidewise.functions.rain import rain_risk

    risk = F.greatest(or_value(static, 0.0), rain_risk(rain).cast("double"))
    return or_value(length, 1.0) * F.when(risk == 1, 1.5).when(risk == 2, 3.0).when(risk == 3, 10.0).otherwise(1.0)


def edge_costs(scored: DataFrame) -> DataFrame:
    """(scenario_id, ord, rainfall, cost): the multi-criteria cost in simulation, else the live one."""
    return scored.select("scenario_id", "ord", "rainfall", F.when(F.col("simulation"), F.col("cost")).otherwise(live_cost(F.col("length"), F.col("risk"), F.col("rainfall"))).alias("cost"))


# --- paths ------------------------------------------------------------------------------------------------------------


def path_metrics(path_edges: DataFrame, roads: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of length, risk and rain at mid vertices over the edges (keys, seq, edge_ord) of each path; rain is always the grid's."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    roads = join_checked(roads, path_edges.select(F.col("edge_ord").alias("ord")).distinct(), "ord", "left_semi")
    r = roads.select(F.col("ord").alias("edge_ord"), zero("length").alias("len"), zero("risk_level").alias("risk_"))
    r = r.join(intensity_at(mid_points(roads), cells).select(F.col("id").alias("edge_ord"), "rain"), "edge_ord")
    return path_edges.join(r, "edge_ord").groupBy(*keys).agg(F.sum("len").alias("length"), F.sum("risk_").alias("risk"), F.sum("rain").alias("rainfall"))


def rank_paths(paths: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Adds closeness and is_optimal to paths (keys, path_id, length, risk, rainfall).

    A path alone in its set has closeness 1; otherwise the highest closeness wins, the first path of equals.
    """
    t = paths.na.fill(0.0, list(CRITERIA))
    t = join_checked(t, weights, F.lit(True))
    keys = [*keys, "scenario_id"]
    t = topsis(t, keys, 0.0001)
    w = W.partitionBy(*keys)
    t = t.withColumn("closeness", F.when(F.count(F.lit(1)).over(w) == 1, F.lit(1.0)).otherwise(F.col("closeness")))
    return t.withColumn("is_optimal", F.row_number().over(w.orderBy(F.col("closeness").desc(), "path_id")) == 1)


def path_summary(path_edges: DataFrame, scored: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """Per path: mean edge wsm (null without edges), and display kilometres (physical, or total cost if 0)."""
    mean = join_checked(scored.select(F.col("ord").alias("edge_ord"), "wsm"), path_edges, "edge_ord").groupBy(*keys).agg(F.avg("wsm").alias("mean_wsm"), F.count(F.lit(1)).alias("n_edges"))
    km = F.when(F.coalesce(F.col("length"), F.lit(0.0)) == 0, F.col("total_cost")).otherwise(F.col("length")) / 1000
    return paths.join(mean, keys, "left").withColumn("km", F.round(F.round(km, 6), 2))


def decision_ranks(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Adds wsm_rank (low first) and topsis_rank (high first), both by path_id among equals, and decision_shift."""
    w = W.partitionBy(*keys)
    t = summary.withColumns({"wsm_rank": F.row_number().over(w.orderBy("mean_wsm", "path_id")), "topsis_rank": F.row_number().over(w.orderBy(F.col("closeness").desc(), "path_id"))})
    first = lambda c: F.max(F.when(F.col(c) == 1, F.col("path_id"))).over(w)
    return t.withColumn("decision_shift", first("wsm_rank") != first("topsis_rank"))


def edge_breakdown(path_edges: DataFrame, scored: DataFrame, keys: list[str], page_rows: int = 8) -> DataFrame:
    """Steps of each path with raw criteria, scores to four places, and their page."""
    t = join_checked(scored.select(F.col("ord").alias("edge_ord"), *CRITERIA, "wsm", "closeness"), path_edges, "edge_ord")
    step = F.row_number().over(W.partitionBy(*keys).orderBy("seq"))
    t = t.withColumn("step", step)
    text = lambda c: F.when(F.col(c) == 0, "N/A").otherwise(F.format_string("%.4f", F.col(c)))
    return t.select(
        *keys, "step", (F.floor((F.col("step") - 1) / page_rows) + 1).cast("int").alias("page"), "edge_ord", *CRITERIA,
        F.round("wsm", 4).alias("wsm"), F.round("closeness", 4).alias("closeness"), text("wsm").alias("wsm_text"), text("closeness").alias("closeness_text"),
    )


def computation_summary(summary: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Per path: cost, kilometres, number of edges, target and the weights used."""
    return join_checked(summary, scenarios.select("scenario_id", *[F.col(w).alias(f"used_{w}") for w in WEIGHT.values()]), "scenario_id")
