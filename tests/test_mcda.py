import math

import pytest
from pyspark.sql import functions as F

from tidewise.functions import rain, styles
from tidewise.operators import mcda

W = "scenario_id int, w_len double, w_risk double, w_rain double"


def ranked(spark, rows, weights=(1, 0.2, 0.5, 0.3)):
    df = spark.createDataFrame([(1, i + 1, *map(float, r)) for i, r in enumerate(rows)], "origin_id long, path_id long, length double, risk double, rainfall double")
    return sorted(mcda.rank_paths(df, spark.createDataFrame([weights], W), ["origin_id"]).collect(), key=lambda r: r.path_id)


def test_rank_paths(spark):
    assert [(r.closeness, r.is_optimal) for r in ranked(spark, [(5, 1, 1)])] == [(1.0, True)]
    assert [(r.closeness, r.is_optimal) for r in ranked(spark, [(0, 0, 0), (0, 0, 0)])] == [(0.0, True), (0.0, False)]
    rows = [(100, 3, 10), (120, 1, 0), (150, 2, 40)]
    n = [math.sqrt(sum(r[c] ** 2 for r in rows)) for c in range(3)]
    wn = [[r[c] / n[c] * (0.2, 0.5, 0.3)[c] for c in range(3)] for r in rows]
    far = lambda w, f: math.sqrt(sum((w[c] - f(x[c] for x in wn)) ** 2 for c in range(3)))
    want = [far(w, max) / (far(w, max) + far(w, min)) for w in wn]
    got = ranked(spark, rows)
    assert [r.closeness for r in got] == pytest.approx(want) and [r.is_optimal for r in got] == [c == max(want) for c in want]


def test_edge_scores(spark):
    rows = [(1, i, float(x), float(r), float(f), 0.2, 0.5, 0.3, True) for i, (x, r, f) in enumerate([(10, 0, 0), (20, 3, 5), (40, 1, 20)])]
    schema = "scenario_id int, ord long, length double, risk double, rainfall double, w_len double, w_risk double, w_rain double, simulation boolean"
    got = {r.ord: r for r in mcda.score_edges(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].wsm == pytest.approx(0.2 / 3 + 0.5 + 0.3 * 0.25) and got[1].cost == pytest.approx(20 * (1 + 5 * got[1].wsm))
    twice = mcda.score_edges(spark.createDataFrame(rows + rows, schema)).groupBy("ord").agg(F.min("closeness").alias("a"), F.max("closeness").alias("b")).collect()
    for r in twice:  # both directions of a road change no score
        assert r.a == pytest.approx(got[r.ord].closeness, abs=1e-12) and r.b == pytest.approx(got[r.ord].closeness, abs=1e-12)
    one = mcda.score_edges(spark.createDataFrame(rows[:1], schema)).first()
    assert one.wsm == pytest.approx(0.2 * 0.5) and one.closeness == 0
    assert mcda.score_edges(spark.createDataFrame([], schema)).count() == 0


def test_live_cost_and_defaults(spark):
    t = spark.createDataFrame([(10.0, 0.0, 0.0), (10.0, 1.0, 0.0), (10.0, 1.0, 16.0), (10.0, 0.0, 31.0), (None, None, 0.0), (float("nan"), 2.5, 0.0), (0.0, 5.0, 0.0)], "length double, risk double, rain double")
    assert [r[0] for r in t.select(mcda.live_cost(F.col("length"), F.col("risk"), F.col("rain"))).collect()] == [10, 15, 30, 100, 1, 1, 1]


def test_ranks_and_pages(spark):
    s = spark.createDataFrame([(1, 1, 0.5, 0.2), (1, 2, 0.4, 0.9), (1, 3, 0.4, 0.9), (2, 1, 0.1, 0.9), (2, 2, 0.2, 0.1)], "origin_id long, path_id long, mean_wsm double, closeness double")
    got = {(r.origin_id, r.path_id): (r.wsm_rank, r.topsis_rank, r.decision_shift) for r in mcda.decision_ranks(s, ["origin_id"]).collect()}
    assert got == {(1, 1): (3, 3, False), (1, 2): (1, 1, False), (1, 3): (2, 2, False), (2, 1): (1, 1, False), (2, 2): (2, 2, False)}
    edges = spark.createDataFrame([(1, 10 * i, i) for i in range(17)], "path_id long, seq int, edge_ord long")
    scored = spark.createDataFrame([(i, 1.0, 0.0, 0.0, i / 3, 0.0) for i in range(17)], "ord long, length double, risk double, rainfall double, wsm double, closeness double")
    rows = sorted(mcda.edge_breakdown(edges, scored, ["path_id"]).collect(), key=lambda r: r.step)
    assert [r.page for r in rows] == [1] * 8 + [2] * 8 + [3] and rows[0].wsm_text == "N/A" and rows[1].wsm_text == "0.3333" and rows[1].closeness == 0.0


def test_summary_of_an_empty_path(spark):
    paths = spark.createDataFrame([(1, 1, 0.0, 1500.0), (1, 2, 2345.6, 9.0)], "origin_id long, path_id long, length double, total_cost double")
    edges = spark.createDataFrame([(1, 2, 0, 5)], "origin_id long, path_id long, seq int, edge_ord long")
    scored = spark.createDataFrame([(5, 0.25)], "ord long, wsm double")
    got = {r.path_id: (r.mean_wsm, r.n_edges, r.km) for r in mcda.path_summary(edges, scored, paths, ["origin_id", "path_id"]).collect()}
    assert got == {1: (None, None, 1.5), 2: (0.25, 1, 2.35)}


def test_labels(spark):
    t = spark.createDataFrame([(0.0, 0.0), (1.0, 6.0), (0.0, 6.0), (1.0, 16.0), (2.0, 31.0), (3.0, 31.0), (7.0, 0.0)], "s double, i double")
    got = [tuple(r) for r in t.select(styles.road_class(F.col("s"), F.col("i")), styles.road_class(F.col("s"), F.col("i"), True), styles.road_class_static(F.col("s")), styles.flood_class(F.col("s")), rain.rain_band(F.col("i"))).collect()]
    assert got == [
        ("grey", "grey", "grey", "none", "none"),
        ("yellow", "light-blue", "yellow", "yellow", "medium"),
        ("light-blue", "light-blue", "grey", "none", "medium"),
        ("dark-blue", "blue", "yellow", "yellow", "high"),
        ("deep-purple", "deep-purple", "orange", "orange", "extreme"),
        ("red", "deep-purple", "red", "red", "extreme"),
        ("grey", "grey", "white", "grey", "none"),
    ]
