"""Measures over all pairs, in several blocks, against plain loops."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tests.conftest import rows
from trackloom.operators import cluster, features, pairwise
from trackloom.operators import statistics as S


def data(n=90, seed=1, dims=3):
    r = np.random.default_rng(seed)
    label = r.integers(0, 3, n)
    return r.normal(size=(n, dims)) + label[:, None] * 1.5, label


def frame(spark, x, label):
    return spark.createDataFrame([(i, int(l), v.tolist()) for i, (l, v) in enumerate(zip(label, x, strict=True))], "id bigint, label int, x array<double>")


def test_geometry(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "BLOCK", 20)
    x, label = data()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    same = label[:, None] == label[None]
    dunn = d[~same].min() / d[same].max()
    np.fill_diagonal(d, np.inf)
    purity = np.mean([same[i, np.argsort(d[i])[:5]].mean() for i in range(len(x))])
    got = pairwise.geometry(frame(spark, x, label), 5).first()
    assert abs(got["dunn"] - dunn) < 1e-9 and abs(got["knn_purity"] - purity) < 1e-9
    assert pairwise.geometry(frame(spark, x[:0], label[:0]), 5).first()["dunn"] is None


def test_warped_pairs_and_linkage(spark):
    r = np.random.default_rng(2)
    seq = [np.cumsum(r.normal(size=r.integers(6, 9))) + 20 * (i % 2) for i in range(12)]
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(seq)] + [(99, None)], "id bigint, x array<double>")
    pairs = pairwise.warped_pairs(df, band=3, block=5)
    got = {(p["a"], p["b"]): p["d"] for p in pairs.collect()}
    assert got.keys() == set(itertools.combinations(range(12), 2))
    for (a, b), d in got.items():
        assert abs(d - cluster.dtw(seq[a][:, None], seq[b][:, None], 3)) < 1e-9
    keys, d = pairwise.matrix(pairs)
    assert keys == list(range(12)) and pairwise.average_linkage(d, 2).tolist() == [i % 2 for i in range(12)]


def test_warped_sequences_look_at_every_hour_and_path(spark, tmp_path):
    from trackloom.plans import model_queries

    r = np.random.default_rng(6)
    value = {(u, h): float(r.normal()) for u in range(5) for h in range(48) if r.random() < 0.8}
    events = spark.createDataFrame([(i * 48 + h, u, v) for i, ((u, h), v) in enumerate(value.items())], "event_id bigint, user_id bigint, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    seq = [np.array([value[u, h] for h in range(48) if (u, h) in value])[:, None] for u in range(5)]
    got = {(p["a"], p["b"]): p["d"] for p in model_queries.warped_sequences(spark, str(tmp_path)).collect()}
    assert got.keys() == set(itertools.combinations(range(5), 2))
    for (a, b), d in got.items():
        assert abs(d - cluster.dtw(seq[a], seq[b])) < 1e-9


@pytest.mark.parametrize("band, dims", [(None, 1), (2, 1), (None, 2)])
def test_warped_pairs_of_more_than_a_piece(spark, band, dims):
    r = np.random.default_rng(7)
    seq = [r.normal(size=(r.integers(0, 6), dims)) for _ in range(pairwise.SIDE + 20)]
    df = spark.createDataFrame([(i, s.ravel().tolist()) for i, s in enumerate(seq)], "id bigint, x array<double>")
    got = {(p["a"], p["b"]): p["d"] for p in pairwise.warped_pairs(df, dims=dims, band=band).collect()}
    assert got.keys() == set(itertools.combinations(range(len(seq)), 2))
    for (a, b), d in got.items():
        want = cluster.dtw(seq[a], seq[b], band)
        assert d == want or abs(d - want) < 1e-9


def test_warped_pairs_copy_a_row_to_few_blocks(spark, monkeypatch):
    met, real = [], pairwise.block_pairs
    monkeypatch.setattr(pairwise, "block_pairs", lambda *a: met.append(real(*a)) or met[-1])
    pairwise.warped_pairs(spark.range(5_000).selectExpr("id", "array(1.0D) as x"))
    assert {r["count"] for r in met[0].groupBy("id").count().collect()} == {8}  # the disk they take; with blocks of 256 it were 20


def test_permanova_of_any_distances(spark):
    x, label = data(60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(60), 2)], "a bigint, b bigint, d double")
    got = pairwise.permanova_distances(pairs, frame(spark, x, label).select("id", "label"), 49).first()
    same = S.permanova_vectors(frame(spark, x, label)).first()
    assert abs(got["f"] - same["f"]) < 1e-6 and abs(got["r2"] - same["r2"]) < 1e-9 and got["p"] == 1 / 50
    mixed = np.random.default_rng(3).permutation(label)
    assert pairwise.permanova_distances(pairs, frame(spark, x, mixed).select("id", "label"), 49).first()["p"] > 0.02
    back = pairwise.principal_coordinates(d)
    assert np.allclose(((back[:, None] - back[None]) ** 2).sum(2), d**2, atol=1e-8)
    assert np.allclose(np.linalg.norm(pairwise.spatial_signs(back), axis=1), 1)


def test_mmd(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "BLOCK", 25)
    x, label = data(80)
    got = {(r["a"], r["b"]): r for r in pairwise.mmd_test(frame(spark, x, label), 39, 0.4).collect()}
    for (a, b), r in got.items():
        assert abs(r["mmd2"] - S.rbf_mmd2(x[label == a], x[label == b], 0.4)) < 1e-9
        assert r["p"] == 1 / 40 and r["q"] >= r["p"]
    assert got.keys() == {(0, 1), (0, 2), (1, 2)}
    null = np.random.default_rng(5).normal(size=(60, 3))
    assert all(r["p"] > 0.03 for r in pairwise.mmd_test(frame(spark, null, np.arange(60) % 2), 39).collect())


@pytest.mark.parametrize("shape", [(3, 3), (2, 5), (5, 2)])
def test_assignment(shape):
    g = np.random.default_rng(4).integers(0, 9, shape).astype(float)
    a = pairwise.assignment(g)
    n = max(shape)
    m = np.zeros((n, n))
    m[: shape[0], : shape[1]] = g
    assert sum(g[i, j] for i, j in enumerate(a) if j >= 0) == max(sum(m[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))


def test_mapping_of_many_clusters(spark):
    df = spark.createDataFrame([(i % 12, (i % 12 + 5) % 12) for i in range(240)] + [(0, 0)], "c int, l int")
    to, score = cluster.best_mapping(df, "c", "l")
    assert to == {i: (i + 5) % 12 for i in range(12)} and abs(score["accuracy"] - 240 / 241) < 1e-12


def test_bounded_clusters(spark):
    x, label = data(60)
    own, inertia = cluster.constrained_kmeans(frame(spark, x, label), 3, 20, (0, 1))
    sizes = [r["count"] for r in own.groupBy("cluster").count().collect()]
    assert sizes == [20, 20, 20] and inertia > 0


def test_sharpened_assignment(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 0.0])], "id int, x array<double>")
    for r in cluster.soft_assignment(df, [[0.0, 0.0], [3.0, 0.0]]).collect():
        assert abs(sum(r["q"]) - 1) < 1e-12 and abs(sum(r["target"]) - 1) < 1e-12 and max(r["target"]) > max(r["q"])


def test_substitution_and_samples(spark):
    wide = spark.createDataFrame([(1, "a", None, "b"), (2, None, None, None)], "id int, h1 string, h2 string, h3 string")
    v = spark.createDataFrame([(1, 0, [0.5]), (1, 1, [0.7])], "id int, i int, vector array<double>")
    got = features.substituted(wide, "id", ["h1", "h2", "h3"], v)
    assert rows(got) == [(1, "h1", "a", [0.5]), (1, "h3", "b", [0.7])]
    with pytest.raises(Exception, match="differ"):
        features.substituted(wide, "id", ["h1", "h2", "h3"], v.filter("i = 0")).collect()
    keys = spark.createDataFrame([(i % 40,) for i in range(200)], "k int")
    assert rows(features.sampled_keys(keys, "k", 7)) == rows(features.sampled_keys(keys, "k", 7)) and features.sampled_keys(keys, "k", 7).count() == 7
    assert features.columns_to_fill(wide, ("id",)) == ["h1", "h2", "h3"]
