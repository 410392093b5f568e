"""The k nearest places against brute force: heaps, poles, the 180th meridian, few places, nulls."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import nearest


def _check(spark, pts, plc, k, **how):
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "point bigint, lon double, lat double")
    q = spark.createDataFrame([(n, float(a), float(b)) for n, a, b in plc], "place string, lon double, lat double")
    got = {}
    for r in nearest.k_nearest(p, q, k, **how).collect():
        got.setdefault(r["point"], []).append((r["rank"], r["place"], r["dist_m"]))
    names = np.array([n for n, _, _ in plc])
    lon, lat = np.array([a for _, a, _ in plc], float), np.array([b for _, _, b in plc], float)
    for i, (a, b) in enumerate(pts):
        d = nearest._haversine(np.full(len(lon), float(a)), np.full(len(lon), float(b)), lon, lat)
        want = np.lexsort((names, np.round(d, 6)))[:k]
        own = sorted(got.get(i, []))
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
        assert np.allclose([m for _, _, m in own], d[want], atol=1e-6)
        assert [n for _, n, _ in own] == names[want].tolist()


def test_dense_heap_and_far_points(spark):
    rng = np.random.default_rng(3)
    heap = [(f"h{i:05d}", -80.1 + 0.01 * a, 26.1 + 0.01 * b) for i, (a, b) in enumerate(rng.random((10_000, 2)))]
    same = [(f"s{i:04d}", -80.2, 26.2) for i in range(500)]  # one spot
    far = [(f"f{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-180, 180, 300), rng.uniform(-90, 90, 300), strict=True))]
    pts = [(-80.1 + 0.01 * a, 26.1 + 0.01 * b) for a, b in rng.random((60, 2))] + [(-80.2, 26.2), (179.99, 0.1), (-179.99, 0.1), (10, 89.9), (-100, -89.9)]
    pts += list(zip(rng.uniform(-180, 180, 30).tolist(), rng.uniform(-89, 89, 30).tolist(), strict=True))
    _check(spark, pts, heap + same + far, 10, leaf=200, salt=7)


def test_fewer_places_than_k_and_none(spark):
    pts = [(0.5, 0.5), (-179.0, 12.0), (100.0, -80.0)]
    _check(spark, pts, [("a", 1.0, 1.0), ("b", 179.5, 10.0)], 5)
    _check(spark, pts, [], 5)


def test_what_does_not_count(spark):
    p = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 1.0), (3, 0.0, 0.0), (4, 1.0, 95.0), (5, 1.0, 1.0)], "point bigint, lon double, lat double")
    q = spark.createDataFrame([(None, 1.0, 1.0), ("x", None, 1.0), ("y", 1.0, 1.5)], "place string, lon double, lat double")
    assert [(r["point"], r["place"]) for r in nearest.k_nearest(p, q, 3).collect()] == [(5, "y")]
    assert nearest.k_nearest(p.filter(F.lit(False)), q, 3).count() == 0


def test_tree_routes_where_balls_meet():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2_000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = nearest.Tree(x, 32)
    leaf = tree.route(x)
    tree.pruned(np.bincount(leaf, minlength=tree.leaves), 100)
    leaf = tree.route(x)
    assert np.bincount(leaf).min() >= 100
    row, met = tree.meets(x[:50], np.full(50, 0.2))
    pairs = set(zip(row.tolist(), met.tolist(), strict=True))
    for i in range(50):
        near = np.flatnonzero(((x - x[i]) ** 2).sum(1) <= 0.04)
        assert {(i, int(v)) for v in leaf[near]} <= pairs


@pytest.mark.parametrize("k", [1, 3])
def test_repeated_positions_take_the_smaller_name(spark, k):
    _check(spark, [(5.0, 5.0)], [("b", 5.1, 5.0), ("a", 5.1, 5.0), ("c", 5.1, 5.0), ("d", 4.9, 5.0)], k)


def test_nearest_segments_keep_one_piece_a_point(spark, monkeypatch):
    from trackloom import shared
    from trackloom.operators import nearest

    rng = np.random.default_rng(5)
    ends = np.round(rng.uniform([-80.4, 25.8, -80.4, 25.8], [-80.0, 26.2, -80.0, 26.2], (60, 4)), 4)
    ends[40:, 2:] = ends[40:, :2] + 0.002
    ends[0] = [-60.0, 40.0, -60.0, 40.0]  # far from all others, without length
    ends[41] = ends[40]  # twice, under two names
    at = rng.uniform([-80.6, 25.6], [-79.8, 26.4], (300, 2))
    at[0], at[1] = [-61.0, 40.0], ends[41][:2]
    segments = spark.createDataFrame([(f"s{i:02d}", *map(float, e)) for i, e in enumerate(ends)], "name string, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "point bigint, lon double, lat double")

    held = []
    real = shared.stored

    def stored(df, name, *more):
        out = real(df, name, *more)
        lists = [f"coalesce(sum(size({c})), 0)" for c, kind in df.dtypes if kind.startswith("array<struct")]
        held.append(out.selectExpr(" + ".join(["count(*)", *lists]) + " as n").collect()[0]["n"])
        return out

    monkeypatch.setattr(shared, "stored", stored)
    got = {r["point"]: (r["name"], r["dist_m"]) for r in nearest.nearest_segment(points, segments).collect()}
    monkeypatch.undo()
    assert sum(x > 1_000 for x in held) <= 1, held  # the pieces; else a row a point

    def metres(p, e):
        n = max(1, math.ceil(float(nearest._haversine(*(np.array([v]) for v in e))[0]) / nearest.PIECE_M))
        k = np.arange(n)
        a, b = (nearest.in_space(e[0] + (e[2] - e[0]) * j / n, e[1] + (e[3] - e[1]) * j / n) for j in (k, k + 1))
        ab, q = b - a, nearest.in_space(np.array([p[0]]), np.array([p[1]]))
        t = np.clip(((q - a) * ab).sum(1) / np.where((ab**2).sum(1) > 0, (ab**2).sum(1), 1), 0, 1)
        chord = np.sqrt(((a + t[:, None] * ab - q) ** 2).sum(1)).min()
        return 2 * 6_371_000.0 * math.asin(chord / 2)

    for i, p in enumerate(at):
        want = min((round(metres(p, e), 3), f"s{j:02d}") for j, e in enumerate(ends))
        assert got[i][0] == want[1] and abs(got[i][1] - want[0]) <= 0.0011, (i, got[i], want)
    small = {r["point"]: (r["name"], r["dist_m"]) for r in nearest.nearest_segment(points, segments, leaf=8, salt=7).collect()}
    assert small == got and got[1][0] == "s40" and got[0][0] == "s00"
