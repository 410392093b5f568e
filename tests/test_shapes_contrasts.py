from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import rows
from trackloom.operators import shapes, statistics


def test_hull_of_many_partitions(spark):
    r = np.random.default_rng(1)
    p = np.vstack([r.uniform(0.01, 0.99, size=(500, 2)), [[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0]]])
    df = spark.createDataFrame([tuple(map(float, x)) for x in p] + [(None, 1.0), (float("nan"), 9.0)], "x double, y double").repartition(7)
    assert [(q["x"], q["y"]) for q in shapes.convex_hull(df).orderBy("i").collect()] == [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert rows(shapes.convex_hull(df.limit(0))) == []


def test_offset_and_simplification(spark):
    grown = shapes.offset_hull(np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]]), 2.0)
    assert grown.min() == pytest.approx(-2) and grown.max() == pytest.approx(3)
    line = np.array([[0.0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]])
    assert shapes.simplified(line, 0.1).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    got = spark.createDataFrame([(line[:, 0].tolist(), line[:, 1].tolist()), (None, None)], "x array<double>, y array<double>").select(shapes.simplify("x", "y", 0.1).alias("l")).collect()
    assert [len(q["l"]) for q in got] == [4, 0]


def test_planted_contrasts(spark):
    v = spark.createDataFrame([(i, t, (100 + i % 3) if i < 20 else i % 3) for i in range(40) for t in range(1, 6)], "traj_id bigint, pt_idx int, hex_id int")
    lab = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "traj_id bigint, cluster int")
    poi = spark.createDataFrame([(h, "x", 5 if h >= 100 else 1) for h in (0, 1, 2, 100, 101, 102)] + [(h, "y", 1 if h >= 100 else 5) for h in (0, 1, 2, 100, 101, 102)], "hex_id int, cat_name string, cat_count bigint")
    assert {r["p"] for r in statistics.omnibus_test(v, lab, poi, 9).collect()} == {0.1}
    c = statistics.pairwise_contrasts(v, lab, poi, 9).collect()
    assert len(c) == 1 and c[0]["p"] == c[0]["q"] == 0.1 and c[0]["observed"] == pytest.approx(100 * 4 / 6)
    assert statistics.pairwise_contrasts(v, lab, poi, 9, per_category=True).count() == 2


def test_mmd_over_all_rows(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(200, 3)), r.normal(size=(150, 3)) + 1
    df = spark.createDataFrame([(0, v.tolist()) for v in x] + [(1, v.tolist()) for v in y] + [(None, [0.0] * 3), (2, None)], "label int, x array<double>")
    got = rows(statistics.mmd2_features(df, 0.5, 4096))
    assert len(got) == 1 and got[0][2] == pytest.approx(statistics.rbf_mmd2(x, y, 0.5), abs=0.05)
