"""Operators on small tables with answers worked out by hand or by NumPy."""

from __future__ import annotations

import json
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trackloom.functions import columns as K
from trackloom.functions import geo
from trackloom.operators import agents, classify, cluster, graph, hourly, models, nearest, statistics, stitch, textprep, timeseries
from trackloom.operators import composition as C
from trackloom.sources import io

TRIPS = "person_id string, trip_id bigint, start_s bigint, end_s bigint, lon0 double, lat0 double, lon1 double, lat1 double"


def deg(m):
    return m / 111_194.9


def trip(i, start, end, a, b):
    return ("p", i, start, end, -80.0, 26 + deg(a), -80.0, 26 + deg(b))


SIX = [trip(1, 0, 100, 0, 1000), trip(2, 200, 300, 1000, 2000), trip(3, 250, 400, 2000, 3000), trip(4, 400 + 5 * 3600, 500 + 5 * 3600, 3020, 4000), trip(5, 500 + 14 * 3600, 600 + 14 * 3600, 4000, 5000), trip(6, 600 + 15 * 3600, 700 + 15 * 3600, 5500, 6000)]


def test_stitching(spark):
    t = stitch.tagged(spark.createDataFrame(SIX, TRIPS))
    assert [r["tag"] for r in t.orderBy("trip_id").collect()] == [None, "continue", "continue", "soft_break", "hard_break", "hard_break"]
    s = stitch.segments(t).orderBy("seg_id").collect()
    assert [(r["seg_id"], r["num_trips"], r["link_count"], r["ended_by"]) for r in s] == [(0, 3, 2, "soft_break"), (1, 1, 0, "hard_break"), (2, 1, 0, "hard_break"), (3, 1, 0, "final")]
    assert s[0]["max_gap_h"] == pytest.approx(100 / 3600) and s[1]["max_gap_h"] == 0
    assert [r["link_idx"] for r in stitch.links(t).orderBy("link_idx").collect()] == [0, 1]
    assert [len(r["line"]) for r in stitch.segment_lines(t).orderBy("seg_id").collect()] == [4, 2, 2, 2]
    assert rows(stitch.tagged(spark.createDataFrame([], TRIPS))) == []


def test_geodesic_against_known_distances(spark):
    a = [np.array([x]) for x in (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)]
    assert geo.geodesic_metres(*a)[0] == pytest.approx(54972.271, abs=0.01)
    assert geo.geodesic_metres(*[np.array([x]) for x in (0.0, 0.0, 0.0, 1.0)])[0] == pytest.approx(111319.491, abs=0.001)
    assert geo.geodesic_metres(*[np.array([5.0])] * 4)[0] == 0
    got = spark.range(1).select(geo.geodesic(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h")).first()
    assert got["m"] == pytest.approx(111319.491, abs=0.001) and got["h"] == pytest.approx(6_371_000 * math.pi / 180)


def test_projections(spark):
    lon, lat = F.lit(-81.5), F.lit(27.25)
    x, y = geo.to_albers(lon, lat)
    u, v = geo.to_utm(lon, lat)
    m, n = geo.to_mercator(lon, lat)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"), m.alias("m"), n.alias("n"))
    back = r.select("*", geo.from_albers(F.col("x"), F.col("y"))[0].alias("lon"), geo.from_albers(F.col("x"), F.col("y"))[1].alias("lat"), geo.from_mercator(F.col("m"), F.col("n"))[1].alias("lat2")).first()
    assert back["lon"] == pytest.approx(-81.5, abs=1e-9) and back["lat"] == pytest.approx(27.25, abs=1e-7) and back["lat2"] == pytest.approx(27.25, abs=1e-9)
    assert 400_000 < back["u"] < 500_000 and back["v"] == pytest.approx(3_014_000, abs=2_000)
    assert back["x"] > 1_400_000 and 500_000 < back["y"] < 700_000


def test_geometry(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    ring = F.array(p(0, 0), p(2, 0), p(2, 2), p(0, 2), p(0, 0))
    line = F.array(p(0, 0), p(1, 0), p(1, 3))
    import struct

    r = spark.createDataFrame([(bytearray(struct.pack("<BIdd", 1, 1, -80.5, 26.25)), "point ( -8.05e1 26.25)")], "b binary, t string").select(
        geo.in_ring(F.lit(1.0), F.lit(1.0), ring).alias("inside"), geo.in_ring(F.lit(3.0), F.lit(1.0), ring).alias("outside"), geo.ring_area(ring).alias("area"), geo.ring_centroid(ring).alias("c"),
        geo.line_length(line).alias("len"), geo.line_at(line, F.lit(0.5)).alias("half"), geo.line_at(line, F.lit(2.0)).alias("end"), geo.wkb_point(F.col("b")).alias("wkb"), geo.wkt_point(F.col("t")).alias("wkt"), geo.merged_lines(F.array(line, F.array(p(1, 3), p(5, 3)))).alias("merged"),
    ).first()
    assert r["inside"] and not r["outside"] and r["area"] == 4 and tuple(r["c"]) == (1, 1) and r["len"] == 4
    assert tuple(r["half"]) == (1, 1) and tuple(r["end"]) == (1, 3) and tuple(r["wkb"]) == tuple(r["wkt"]) == (-80.5, 26.25) and len(r["merged"]) == 4


def test_columns(spark):
    df = spark.createDataFrame([(None, " ", "evac_out", "[1.5  -2 x]"), ("Eat ", "Cafe", "x -12 y", "[]")], "a string, b string, c string, v string")
    r = df.select(K.class_key(F.col("a"), F.col("b")).alias("k"), K.is_evacuation(F.col("c")).alias("e"), K.first_integer(F.col("c")).alias("i"), K.parse_vector(F.col("v")).alias("v"), K.category(F.lit("Restaurants[sep]Cafe")).alias("cat")).collect()
    assert [tuple(x) for x in r] == [("<null_val>[sep]<null_val>", 1, None, [1.5, -2.0, None], "Restaurants"), ("Eat[sep]Cafe", 0, -12, [], "Restaurants")]
    one = spark.range(1).select(K.compacted(F.array(*[F.lit(x) for x in "aabba"])).alias("c"), K.top_k(F.array(*[F.lit(float(x)) for x in (1, 3, 3, 2)]), 2).alias("t"), K.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s"), K.hour_of_seconds(F.lit(86_000)).alias("h"), K.day_of_seconds(F.lit(86_400)).alias("d")).first()
    assert one["c"] == ["a", "b", "a"] and [x["i"] for x in one["t"]] == [1, 2] and one["s"] == [0.5, 0.5] and one["h"] == 0 and one["d"] == 2
    assert K.resolve_column(df, ["x", "A"]) == "a"
    with pytest.raises(ValueError):
        K.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_nearest_with_ties_and_far_points(spark):
    places = spark.createDataFrame([("a", -80.0, 26.0), ("b", -80.001, 26.0), ("c", -79.999, 26.0), ("d", None, 26.0), ("e", 10.0, 50.0)], "place string, lon double, lat double")
    pts = spark.createDataFrame([(1, -80.0, 26.0), (2, 100.0, -60.0)], "point bigint, lon double, lat double")
    got = {(r["point"], r["rank"]): r["place"] for r in nearest.k_nearest(pts, places, 3).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == ["a", "b", "c"]
    assert got[2, 1] == "e" and len(got) == 6


def test_composition_kernels_differ_as_they_should(spark):
    v = spark.createDataFrame([("t1", 1, 1), ("t2", 1, 1), ("t3", 1, 2), ("t3", 2, 9)], "traj_id string, pt_idx int, hex_id int")
    lab = spark.createDataFrame([("t1", 0), ("t2", 0), ("t3", 0)], "traj_id string, cluster int")
    poi = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (2, "x", 4)], "hex_id int, cat_name string, cat_count bigint")
    share = lambda df: {r["cat_name"]: r["share"] for r in df.filter("pt_idx = 1").collect()}
    assert share(C.cluster_unique(v, lab, poi)) == {"x": 5 / 8, "y": 3 / 8}
    assert share(C.cluster_device(v, lab, poi)) == pytest.approx({"x": (0.25 + 0.25 + 1) / 3, "y": 0.5})
    assert {r["cat_name"]: r["n"] for r in C.device_counts(v, lab, poi).collect()} == {"x": 6, "y": 6}
    assert share(C.cluster_unique(v, lab, poi, 3)) == {"x": None, "y": None}
    assert rows(C.global_baseline(v.limit(0), poi)) == []


def test_series(spark):
    s = spark.createDataFrame([("a", t, float(x) if x is not None else None) for t, x in enumerate([None, 2, None, None, 8, None])] + [("b", 0, None)], "k string, t int, v double")
    got = timeseries.interpolated(s, "k", "t", "v").orderBy("k", "t").collect()
    assert [r["v"] for r in got] == [2, 2, 4, 6, 8, 8, None]
    cubic = spark.createDataFrame([("a", t, 1.0 + 2 * t - 0.5 * t * t) for t in range(20)], "k string, t int, v double")
    for r in timeseries.savgol(cubic, "k", "t", "v").collect():
        assert r["smooth"] == pytest.approx(r["v"], abs=1e-8)
    for r in timeseries.loess(cubic, "k", "t", "v", 0.3).collect():
        assert abs(r["smooth"] - r["v"]) < 2
    wave = spark.createDataFrame([("a", t, math.sin(2 * math.pi * t / 12)) for t in range(120)], "k string, t int, v double")
    for m in ("periodogram", "welch"):
        top = timeseries.spectrum(wave, "k", "t", "v", m, **({"segment": 48} if m == "welch" else {})).orderBy(F.desc("power")).first()
        assert top["period"] == pytest.approx(12, rel=0.01)


def test_statistics(spark):
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.04, 0.03, 0.04, None, 0.9])], "id int, p double")
    q = [r["q"] for r in statistics.benjamini_hochberg(p, tie="id").orderBy("id").collect()]
    assert q[:4] == pytest.approx([0.05, 0.05, 0.05, 0.05]) and q[4] is None and q[5] == 0.9
    assert statistics.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03497, abs=1e-5)
    assert statistics.binomial_exact(1, 10) == pytest.approx(22 / 1024)
    assert statistics.mcnemar_exact(0, 0) == 1.0
    assert statistics.chi_square(np.array([[10, 20], [20, 10]]))[0] == pytest.approx(6.6667, abs=1e-3)
    r = np.random.default_rng(1)
    near, far = statistics.rbf_mmd2(r.normal(size=(80, 3)), r.normal(size=(80, 3)), 0.5), statistics.rbf_mmd2(r.normal(size=(80, 3)), r.normal(size=(80, 3)) + 2, 0.5)
    assert abs(near) < 0.05 < far
    rows_ = spark.createDataFrame([(f"t{i}", t, i % 3) for i in range(9) for t in (1, 2)], "traj_id string, pt_idx int, cluster int").withColumn("traj_id", F.substring("traj_id", 2, 3).cast("bigint"))
    dealt = statistics.permuted_within_time(rows_, 3).groupBy("b", "pt_idx", "cluster").count().collect()
    assert {r["count"] for r in dealt} == {3} and len(dealt) == 18


def test_a_planted_shift_is_significant(spark):
    v = [(i, t, (100 + i % 3) if i < 20 else i % 3) for i in range(40) for t in range(1, 7)]
    poi = [(h, "x", 5 if h >= 100 else 1) for h in (0, 1, 2, 100, 101, 102)] + [(h, "y", 1 if h >= 100 else 5) for h in (0, 1, 2, 100, 101, 102)]
    got = statistics.permutation_test(spark.createDataFrame(v, "traj_id bigint, pt_idx int, hex_id int"), spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "traj_id bigint, cluster int"), spark.createDataFrame(poi, "hex_id int, cat_name string, cat_count bigint"), 19)
    assert {r["p"] for r in got.collect()} == {1 / 20}


def test_permanova_equals_pair_sums(spark):
    r = np.random.default_rng(3)
    x, g = r.normal(size=(30, 4)), [i % 3 for i in range(30)]
    df = spark.createDataFrame([(i, g[i], x[i].tolist()) for i in range(30)], "id bigint, label int, x array<double>")
    got = statistics.permanova_vectors(df, 2).filter("b = 0").first()
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    sst = np.triu(d2).sum() / 30
    ssw = sum(np.triu(d2[np.ix_(m, m)]).sum() / len(m) for k in range(3) if (m := [i for i in range(30) if g[i] == k]))
    assert got["f"] == pytest.approx(((sst - ssw) / 2) / (ssw / 27)) and got["r2"] == pytest.approx((sst - ssw) / sst)


def test_graphs(spark):
    nodes = spark.createDataFrame([(i, -80 + i * 0.001, 26.0) for i in range(7)], "id bigint, lon double, lat double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (1, 0), (4, 5), (3, 3)], "src bigint, dst bigint")
    assert rows(graph.undirected(edges)) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    whole = graph.bridged(nodes, edges)
    assert {r["component"] for r in graph.components(nodes, whole).collect()} == {0}
    assert {(r["src"], r["dst"]) for r in whole.collect()} >= {(2, 3), (5, 6)}
    assert {r["id"]: r["degree"] for r in graph.degrees(nodes, graph.undirected(edges)).collect()}[6] == 0


def test_shortest_paths_two_ways(spark):
    nodes, raw = graph.grid_network(6, spark)
    edges = graph.best_edges(graph.with_travel_time(raw))
    legs = spark.createDataFrame([(1, 0, 35), (2, 0, 5), (3, 7, 7), (4, 0, 999)], "leg bigint, origin bigint, dest bigint")
    a = {r["leg"]: r for r in graph.shortest_paths(edges, legs).collect()}
    assert set(a) == {1, 2, 3} and a[3]["path"] == [7] and a[1]["path"][0] == 0 and a[1]["path"][-1] == 35
    d = {r["node"]: r["travel_s"] for r in graph.frontier_distances(edges, spark.createDataFrame([(0,)], "origin bigint")).collect()}
    assert a[1]["travel_s"] == pytest.approx(d[35]) and a[2]["travel_s"] == pytest.approx(d[5])
    st = {r["leg"]: r for r in graph.path_stats(spark.createDataFrame([tuple(x) for x in a.values()], "leg bigint, t double, path array<bigint>").select("leg", "path"), edges).collect()}
    assert st[1]["travel_s"] == pytest.approx(d[35]) and st[3]["edges"] == 0
    assert graph.random_walks(spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint"), 2, 5).select(F.size("path").alias("n")).distinct().collect()[0]["n"] == 5


def test_every_leg_is_walked(spark):
    n = 900  # more than 6 * 143 + 1; the only origin called a home is the last
    legs = [("p", i, 60.0, "home" if i == n else "Cafe", "Cafe", float(i), 1.0, float(i + 1), 1.0) for i in range(1, n + 1)]
    df = spark.createDataFrame(legs, "person_id string, step int, travel_s double, origin_poi string, dest_poi string, lon0 double, lat0 double, lon1 double, lat1 double")
    iv = hourly.intervals_with_curfew(df).orderBy("i").collect()
    assert sum(r["kind"] == "move" for r in iv) == n and iv[-1]["lon1"] == n + 1 and iv[0]["lon0"] == n
    cut = hourly.intervals_with_curfew(df, hours=2).orderBy("i").collect()
    assert cut[:-1] == iv[: len(cut) - 1] and sum(r["kind"] == "move" for r in cut) == 13
    at = lambda i: hourly.hourly_positions(i, 2).orderBy("hour").collect()
    assert at(hourly.intervals_with_curfew(df)) == at(hourly.intervals_with_curfew(df, hours=2))


def test_hours(spark):
    legs = [("p", i, 1800.0, "home" if i == 1 else "Cafe", "home", -80.0, 26.0 + i, -80.0, 27.0 + i) for i in range(1, 5)]
    iv = hourly.intervals_with_curfew(spark.createDataFrame(legs, "person_id string, step int, travel_s double, origin_poi string, dest_poi string, lon0 double, lat0 double, lon1 double, lat1 double")).orderBy("i").collect()
    assert iv[0]["kind"] == "stay" and iv[0]["end_s"] == 4 * 3600 and (iv[0]["lon0"], iv[0]["lat0"]) == (-80.0, 27.0)
    assert all(a["end_s"] == b["start_s"] for a, b in zip(iv, iv[1:], strict=False)) and sum(r["kind"] == "move" for r in iv) == 4
    stays = [("q", "stay", 0.0, 5400.0, 1.0, 1.0, 1.0, 1.0), ("q", "move", 5400.0, 7200.0, 1.0, 1.0, 3.0, 1.0), ("q", "stay", 10_800.0, 14_400.0, 3.0, 1.0, 3.0, 1.0), ("q", "stay", 14_400.0, 14_400.0, 9.0, 9.0, 9.0, 9.0)]
    h = hourly.hourly_positions(spark.createDataFrame(stays, "person_id string, kind string, start_s double, end_s double, lon0 double, lat0 double, lon1 double, lat1 double"), 5)
    assert [r["lon"] for r in h.orderBy("hour").collect()] == pytest.approx([1, 1.5, 1.5, 3, 3])
    wide = hourly.wide(h, "lon", 5)
    assert wide.columns == ["person_id", "h001", "h002", "h003", "h004", "h005"] and hourly.long(wide, "lon").count() == 5
    assert hourly.beta_cdf(np.array([0, 0.25, 0.5, 1]), np.array(1.0), np.array(1.0)) == pytest.approx([0, 0.25, 0.5, 1])
    x = np.linspace(0, 1, 200_001)
    area = np.cumsum(x * np.sqrt(1 - x))  # the density of Beta(2, 1.5), but for its scale
    assert hourly.beta_cdf(np.array([0.3]), np.array(2.0), np.array(1.5))[0] == pytest.approx(area[60_000] / area[-1], abs=1e-4)


def test_rules(spark):
    base = {"n_moves": 3, "n_unique_pois": 3, "visited_traveler": False, "visited_hospital": False, "touched_outside_zone": False}
    cases = [({"n_moves": 0}, "sip_home_grocery"), ({"visited_traveler": True, "touched_outside_zone": True}, "evac_out_of_zone"), ({"visited_traveler": True}, "evac_short_in_zone"), ({"visited_hospital": True}, "sip_hospital"), ({"visited_hospital": True, "touched_outside_zone": True}, "sip_hospital"), ({"touched_outside_zone": True}, "sip_home_grocery"), ({}, "sip_home_grocery")]
    df = spark.createDataFrame([base | c | {"i": i} for i, (c, _) in enumerate(cases)])
    assert [r["l"] for r in df.orderBy("i").select(classify.trajectory_label().alias("l")).collect()] == [w for _, w in cases]


def test_draws(spark):
    people = spark.range(1000).select(F.col("id").alias("person_id"))
    homes = agents.homes(people, spark.createDataFrame([("a", 300), ("b", 700), ("z", 0)], "county string, population bigint"), spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "place int, county string"))
    n = {r["county"]: r["count"] for r in homes.groupBy("county").count().collect()}
    assert sum(n.values()) == 1000 and 240 < n["a"] < 360
    c = {r["cohort"]: r["count"] for r in agents.cohorts(people, ["x", "y", "z"]).groupBy("cohort").count().collect()}
    assert sorted(c.values()) == [333, 333, 334]
    p = spark.createDataFrame([("near", "food", "a", -80.0, 26.0), ("far", "food", "a", -80.0, 27.0)], "place string, category string, county string, lon double, lat double")
    who = people.withColumns({"lon": F.lit(-80.0), "lat": F.lit(26.0), "home_county": F.lit("a")})
    day = agents.day_plans(who, p, ["food", "none", "home"])
    near = day.filter("step = 1 and place = 'near'").count()
    assert near > 980 and day.filter("step = 2 and place = 'near'").count() == near and day.filter("step = 3 and place = 'home'").count() == 1000


def test_clustering(spark):
    r = np.random.default_rng(5)
    x = np.vstack([r.normal(size=(30, 5)) * 0.1 + 3 * k for k in range(3)])
    df = spark.createDataFrame([(i, (x[i] + 0.0).tolist(), i // 30) for i in range(90)], "id bigint, x array<double>, truth int")
    got, centres, inertia = cluster.kmeans(df, 3)
    assert cluster.adjusted_rand(got, "cluster", "truth") == 1.0
    _, m = cluster.best_mapping(got, "cluster", "truth")
    assert m["accuracy"] == m["f1"] == 1.0
    s = cluster.scores(got)
    assert s["inertia"] == pytest.approx(inertia, rel=1e-6) and s["imbalance"] == 1
    sil = {q["id"]: q["silhouette"] for q in cluster.silhouette(got).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    a, b = d2[0, :30].sum() / 29, min(d2[0, 30:60].mean(), d2[0, 60:].mean())
    assert sil[0] == pytest.approx((b - a) / max(a, b))
    held = cluster.constrained(df, centres, 40)
    assert held.count() == 90 and max(q["count"] for q in held.groupBy("cluster").count().collect()) <= 40
    tight = cluster.constrained(df, [centres[0]] * 3, 30)
    assert sorted(q["count"] for q in tight.groupBy("cluster").count().collect()) == [30, 30, 30]
    assert cluster.knee([2, 3, 4, 5], [100, 20, 15, 12]) == 3
    assert cluster.dtw(np.array([[0.0], [1], [2]]), np.array([[0.0], [0], [1], [2]])) == 0
    z = cluster.standardised(df).select(F.avg(F.col("x")[0]).alias("m"), F.stddev_pop(F.col("x")[0]).alias("s")).first()
    assert z["m"] == pytest.approx(0, abs=1e-9) and z["s"] == pytest.approx(1)


def test_models(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 2 * F.col("a") - F.col("b") + (F.col("id") % 3) * 0.01)
    m = {r["term"]: r for r in models.least_squares(df, ["a", "b"], "y").collect()}
    assert m["a"]["coefficient"] == pytest.approx(2, abs=1e-2) and m["a"]["r2"] > 0.999 and m["a"]["n"] == 200
    holes = df.withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    assert models.imputed(holes, ["a", "b", "y"]).filter("a is null").count() == 0
    assert {r["count"] for r in models.folds(df.withColumn("l", F.col("id") % 2), "id", 5, "l").groupBy("l", "fold").count().collect()} == {20}


def test_text(spark):
    t = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, None)], "k bigint, t string")
    assert [(r["block"], r["tokens"]) for r in textprep.blocks(t, "k", "t", 2, 100).collect()] == [(0, ["a", "b"]), (1, ["c", "d"])]
    v = textprep.hashed_vector(t, "t", 8).orderBy("k").collect()
    assert sum(x * x for x in v[0]["embedding"]) == pytest.approx(1, abs=1e-6) and v[2]["embedding"] == [0.0] * 8


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("k", 'a "b", c\nd', -80.0, 26.0)], "PLACEKEY string, LOCATION_NAME string, LONGITUDE double, LATITUDE double")
    cols = [f.name for f in io.PLACES]
    full = df.withColumns({c: F.lit(None).cast("string") for c in cols if c not in df.columns}).select(cols)
    io.write_csv(full, f"file://{tmp_path}/p.csv")
    assert io.read_places(spark, f"file://{tmp_path}/p.csv").first()["LOCATION_NAME"] == 'a "b", c\nd'
    line = df.select("PLACEKEY", F.array(F.struct(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))).alias("line"))
    f = json.loads(io.geojson_features(line, "line", "PLACEKEY").first()["value"])
    assert f["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]} and f["properties"] == {"PLACEKEY": "k"}
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [f]}))
    g = io.read_geojson(spark, f"file://{tmp_path}/f.geojson").first()
    assert g["kind"] == "Point" and g["properties"] == {"PLACEKEY": "k"} and json.loads(g["coordinates"]) == [1.0, 2.0]
    run = f"file://{tmp_path}/run"
    io.save_run(spark, run, df.select("PLACEKEY"), df.select("PLACEKEY"), None, B=5)
    assert io.load_run(spark, run)["meta"] == {"B": 5, "null": False}
    assert io.write_routes(df.limit(0), f"file://{tmp_path}/none") is False and not (tmp_path / "none").exists()


def test_cli(tmp_path):
    assert subprocess.run([sys.executable, "-m", "trackloom.cli", "simulate", "--out", str(tmp_path / "a/s.csv")], check=True).returncode == 0
    assert len((tmp_path / "a/s.csv").read_text().splitlines()) == 3
    (tmp_path / "x.html").write_text("<p>")
    subprocess.run([sys.executable, "-m", "trackloom.cli", "copy-html", "--src", str(tmp_path / "x.html"), "--dest", str(tmp_path / "b/y.html")], check=True)
    assert (tmp_path / "b/y.html").read_text() == "<p>"


def test_streams(spark, tmp_path):
    from trackloom import shared
    from trackloom.operators.sessions import SessionTable
    from trackloom.streaming import sessions

    schema = "trip_id bigint, participantId string, tripStartDate string, tripEndDate string"
    source = str(tmp_path / "in")
    t = lambda h, m=0: f"2001-01-01 {h:02d}:{m:02d}:00Z"
    spark.createDataFrame([(1, "a", t(0), t(1)), (2, "a", t(9), t(10))], schema).coalesce(1).write.parquet(source)
    table = SessionTable(spark, shared.scratch(spark, "stream"), 4 * 3600, once_by_id=True)
    run = lambda: sessions.sessions_into(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "cp")).awaitTermination()
    run()
    assert table.sessions().count() == 2
    spark.createDataFrame([(3, "a", t(4), t(6)), (1, "a", t(0), t(1))], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert [r["n_events"] for r in table.sessions().collect()] == [3]


def test_names_are_tokenised_and_vectors_are_whole(spark, tmp_path):
    import __spark_entry__

    q = __spark_entry__.queries()
    pois = [(f"p{i}", -80.0, 26.0, "Restaurants", "Diners", f"Heron{i} Kitchen") for i in range(400)]
    spark.createDataFrame(pois, "PLACEKEY string, LONGITUDE double, LATITUDE double, TOP_CATEGORY string, SUB_CATEGORY string, LOCATION_NAME string").write.parquet(f"{tmp_path}/pois.parquet")
    tokens = {t for r in q["lm_blocks"](spark, str(tmp_path)).collect() for t in r["tokens"]}
    assert "kitchen" in tokens and any("heron399" in t for t in tokens) and "<null_val>" not in tokens
    x = [(i - 32) / 64 for i in range(64)]
    spark.createDataFrame([(1, x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert q["vector_parse_whole"](spark, str(tmp_path)).collect()[0]["v"] == pytest.approx(x, abs=1e-4)
    row = q["vector_to_columns_whole"](spark, str(tmp_path)).collect()[0]
    assert [row[f"z{i}"] for i in range(64)] == pytest.approx(x, abs=1e-6)


def test_parsed_vectors_keep_digits_signs_and_nulls(spark, tmp_path):
    import math

    import __spark_entry__

    q = __spark_entry__.queries()
    x = [0.006650000344961882, -0.00003, 0.0, -0.0, -0.03125, None, float("inf"), 1e20]
    spark.createDataFrame([(1, x), (2, None)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("vector_parse_whole", "vector_parse"):
        got = {r["vec_id"]: r["v"] for r in q[name](spark, str(tmp_path)).collect()}
        assert got[1][:7] == [0.0067, 0.0, 0.0, 0.0, -0.0313, None, math.inf] and got[1][7] == pytest.approx(1e20)
        assert [math.copysign(1, v) for v in got[1][:4]] == [1, -1, 1, -1]
        assert got[2] is None


def test_the_grid_of_a_sequence_is_never_broadcast(spark):
    from trackloom.operators import features as X

    points = spark.range(4_000).select((F.col("id") % 400).alias("user"), (F.col("id") % 7 * 20 + 1).alias("step"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("value"))
    seq = X.masked_sequences(points, "user", "step", ["value"])
    observed = seq.filter("value is not null")
    plan = observed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan, plan
    means = points.groupBy("user", "step").agg(F.avg("value").alias("v")).filter("v is not null")
    got = {(r["user"], r["slot"]): r["value"] for r in observed.collect()}
    assert got == {(r["user"], min(max(r["step"] - 1, 0), 142)): r["v"] for r in means.collect()}
    assert seq.count() == 400 * 143 and seq.filter("padded and value_observed").count() == 0
    t = X.masked_error(X.hour_mean_baseline(seq, "value"), "value", "guess").collect()[0]
    assert t["n"] == len(got)


def test_the_race_for_places_is_run_in_tasks_and_draws_as_before(spark, monkeypatch):
    monkeypatch.setattr(agents, "PEOPLE", 40)
    monkeypatch.setattr(agents, "PLACES", 150)
    u = lambda i: F.rand(i)
    name = F.concat(F.lit("p"), F.col("id"), F.when(F.col("id") % 9 == 0, F.lit("-a-long-name-of-more-than-32-bytes")).otherwise(""))
    p = spark.range(500).select(name.alias("place"), F.when(F.col("id") % 3 > 0, "food").otherwise("fuel").alias("category"), F.when(F.col("id") % 5 > 0, (F.col("id") % 4).cast("string")).alias("county"), (u(1) * 2 - 81).alias("lon"), (u(2) * 2 + 25).alias("lat"))
    asked = spark.range(120).select(F.concat(F.lit("DRV"), "id").alias("person_id"), F.lit(1).alias("step"), F.when(F.col("id") % 2 > 0, "food").otherwise("fuel").alias("category"), (u(3) * 2 - 81).alias("lon"), (u(4) * 2 + 25).alias("lat"), (F.col("id") % 4).cast("string").alias("home_county"))
    q = p.select("category", "place", "county", F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    t = agents.race(agents.pull(geo.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), F.col("home_county"), F.col("county")), K.uniform(42, F.col("person_id"), F.col("step"), F.col("place")))
    want = {r["person_id"]: r["w"] for r in asked.join(q, "category").groupBy("person_id").agg(F.min_by("place", F.struct(t.alias("t"), "place")).alias("w")).collect()}
    out = agents.next_places(asked, p)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan
    assert {r["person_id"]: r["place"] for r in out.collect()} == want and len(want) == 120


def test_walks_and_sweep_have_the_numbers_of_the_reference(spark, tmp_path, monkeypatch):
    import __spark_entry__

    q, asked = __spark_entry__.queries(), {}
    spark.createDataFrame([(1, 0), (2, 0)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 0, [0.0, 1.0])], "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(graph, "random_walks", lambda edges, walks, length: asked.update(walks=(walks, length)) or edges)
    monkeypatch.setattr(cluster, "sweep", lambda df, ks: asked.update(ks=ks) or [(1,)])
    q["random_walks"](spark, str(tmp_path)), q["k_selection"](spark, str(tmp_path))
    assert asked == {"walks": (16, 128), "ks": list(range(2, 16))}
