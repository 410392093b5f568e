"""Paths found without a broadcast network against those found with one."""

from __future__ import annotations

from trackloom.operators import graph


def test_same_times_and_real_paths(spark, monkeypatch):
    _, raw = graph.grid_network(5, spark)
    edges = graph.best_edges(graph.with_travel_time(raw))
    legs = spark.createDataFrame([(1, 0, 24), (2, 7, 7), (3, 24, 3), (4, 0, 24), (5, 99, 3), (6, 3, 99)], "leg bigint, origin bigint, dest bigint")
    want = {r["leg"]: r for r in graph.shortest_paths(edges, legs).collect()}
    monkeypatch.setattr(graph, "MAX_EDGES", 10)
    got = {r["leg"]: r for r in graph.shortest_paths(edges, legs).collect()}
    cost = {(e["u"], e["v"]): e["travel_time"] for e in edges.collect()}
    assert got.keys() == want.keys() == {1, 2, 3, 4}
    for leg, r in got.items():
        assert abs(r["travel_s"] - want[leg]["travel_s"]) < 1e-9
        assert abs(sum(cost[a, b] for a, b in zip(r["path"], r["path"][1:], strict=False)) - r["travel_s"]) < 1e-9
        assert (r["path"][0], r["path"][-1]) == (want[leg]["path"][0], want[leg]["path"][-1])
