"""Formats read whole, files written as others read them, and operators that no query calls."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trackloom.functions import geo
from trackloom.operators import cluster, graph, hourly, models, timeseries
from trackloom.operators.proximity import _rings
from trackloom.operators.sessions import SessionTable
from trackloom.sources import io, vector
from trackloom.streaming import sessions as streams


def _shp(shapes):
    body = b""
    for i, (code, parts) in enumerate(shapes, 1):
        if code == 1:
            rec = struct.pack("<i2d", 1, *parts)
        elif code == 0:
            rec = struct.pack("<i", 0)
        else:
            flat = [p for part in parts for p in part]
            begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
            rec = struct.pack("<i4d2i", code, 0, 0, 1, 1, len(parts), len(flat)) + struct.pack(f"<{len(parts)}i", *begins) + b"".join(struct.pack("<2d", *p) for p in flat)
        body += struct.pack(">2i", i, len(rec) // 2) + rec
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def _dbf(names, table):
    width = 8
    head = struct.pack("<4B I H H 20x", 3, 24, 1, 1, len(table), 33 + 32 * len(names), 1 + width * len(names))
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for n in names) + b"\r"
    return head + b"".join(b" " + b"".join(str(v).encode().ljust(width) for v in row) for row in table)


def test_shapefile(spark, tmp_path):
    ring = [(0, 0), (0, 2), (2, 2), (0, 0)]
    (tmp_path / "a.shp").write_bytes(_shp([(1, (3.5, -1.0)), (5, [ring, ring[::-1]]), (3, [[(0, 0), (1, 1)]]), (0, None)]))
    (tmp_path / "a.dbf").write_bytes(_dbf(["name", "n"], [("x", 1), ("y", 2), ("z", 3), ("w", 4)]))
    got = {r["fid"]: r for r in vector.read_shapefile(spark, str(tmp_path / "a.shp")).collect()}
    assert [got[i]["kind"] for i in range(4)] == ["point", "polygon", "line", "none"] and got[1]["properties"] == {"name": "y", "n": "2"}
    assert [r.tolist() for r in _rings(bytes(got[1]["geometry"]))] == [[list(map(float, p)) for p in ring], [list(map(float, p)) for p in ring[::-1]]]
    p = spark.createDataFrame([(bytes(got[0]["geometry"]),)], "g binary").select(geo.wkb_point(F.col("g")).alias("p")).first()["p"]
    assert (p["lon"], p["lat"]) == (3.5, -1.0)
    (tmp_path / "b.shp").write_bytes(_shp([(1, (1.0, 2.0))]))
    assert vector.read_shapefile(spark, str(tmp_path / "b.shp")).first()["properties"] == {}


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text)")
    db.execute("insert into gpkg_geometry_columns values ('nodes', 'geom', 'POINT')")
    db.execute("create table nodes (fid integer primary key, geom blob, osmid text)")
    wkb = struct.pack("<BI2d", 1, 1, 5.0, 6.0)
    db.execute("insert into nodes values (7, ?, 'q'), (8, null, null)", (b"GP\0\x03" + struct.pack("<i4d", 4326, 5, 5, 6, 6) + wkb,))
    db.commit()
    got = {r["fid"]: r for r in vector.read_geopackage(spark, str(tmp_path / "a.gpkg"), "nodes").collect()}
    assert bytes(got[7]["geometry"]) == wkb and got[7]["properties"]["osmid"] == "q" and got[8]["geometry"] is None


def test_graphml_arrays_and_word_vectors(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="length"/><graph><node id="1"><data key="d0">-80.5</data><data key="d1">26</data></node><node id="2"/><edge source="1" target="2"><data key="d2">12.5</data></edge></graph></graphml>')
    nodes, edges = vector.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert rows(nodes.select("id", "x", "y")) == [("1", -80.5, 26.0), ("2", None, None)]
    assert [(e["u"], e["v"], e["attributes"]["length"]) for e in edges.collect()] == [("1", "2", "12.5")]
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    np.savez(tmp_path / "b.npz", u=np.ones(2), v=np.zeros((1, 3)))
    assert rows(vector.read_arrays(spark, str(tmp_path / "a.npy")).select("row", "x")) == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    assert rows(vector.read_arrays(spark, str(tmp_path / "b.npz")).select("name", "row", "x")) == [("u", 0, [1.0]), ("u", 1, [1.0]), ("v", 0, [0.0, 0.0, 0.0])]
    (tmp_path / "w.txt").write_text("2 2\ncat 0.5 1\ndog -1 2e-1\n")
    assert rows(vector.read_word_vectors(spark, str(tmp_path / "w.txt"))) == [("cat", [0.5, 1.0]), ("dog", [-1.0, 0.2])]


def test_files_of_entities(spark, tmp_path):
    (tmp_path / "t.csv").write_text("person_id,step,label_pair\n2,1,b\n1,2,\n1,1,a\n")
    assert [(r["person_id"], r["step"], r["poi_name"]) for r in io.read_trajectories(spark, str(tmp_path / "t.csv")).collect()] == [(1, 1, "a"), (1, 2, None), (2, 1, "b")]
    pd.DataFrame({"GEOID": ["b", "a", "c"], "v": [1, 2, 3]}).to_parquet(tmp_path / "h.parquet")
    assert rows(io.read_hexes(spark, str(tmp_path / "h.parquet")).select("GEOID", "hex_id")) == [("a", 0), ("b", 1), ("c", 2)]
    pd.DataFrame({"osmid": [1], "x": ["1.5"], "y": ["2"]}).to_parquet(tmp_path / "n.parquet")
    pd.DataFrame({"u": [1], "v": [1]}).to_parquet(tmp_path / "e.parquet")
    assert io.read_network(spark, str(tmp_path / "n.parquet"), str(tmp_path / "e.parquet"))[0].first()["x"] == 1.5
    io.write_report("été\n", str(tmp_path / "deep/r.txt"))
    assert (tmp_path / "deep/r.txt").read_text(encoding="utf-8") == "été\n"
    lines = spark.createDataFrame([(i, [(float(i), 1.0), (2.0, 3.0)]) for i in range(5)], "id int, line array<struct<lon: double, lat: double>>")
    io.write_geojson(lines.repartition(2), str(tmp_path / "g"), "line", "id")
    parts = [json.loads(p.read_text()) for p in (tmp_path / "g").glob("part-*") if p.stat().st_size]
    assert sorted(f["properties"]["id"] for p in parts for f in p["features"]) == list(range(5)) and all(p["type"] == "FeatureCollection" for p in parts)
    assert io.read_geojson(spark, str(tmp_path / "g")).count() == 5
    pytest.importorskip("openpyxl")
    pd.DataFrame({"a": [1]}).to_excel(tmp_path / "x.xlsx", index=False)
    assert io.read_excel(spark, str(tmp_path / "x.xlsx")).first()["a"] == 1


def test_models_are_kept(spark, tmp_path):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([([0.0, 0.0],), ([5.0, 5.0],)], "x array<double>").select(array_to_vector("x").alias("features"))
    model = KMeans(k=2, seed=1).fit(df)
    io.save_model(model, str(tmp_path / "m"))
    assert sorted(c.tolist() for c in io.load_model(spark, str(tmp_path / "m")).clusterCenters()) == [[0.0, 0.0], [5.0, 5.0]]


def test_session_batches_count_once(spark, tmp_path):
    table = SessionTable(spark, "file://" + str(tmp_path / "s"), 100)
    events = spark.createDataFrame([("a", 0, 10), ("a", 50, 60), ("b", 5, 6)], "key string, start_s bigint, end_s bigint")
    for number in (0, 0, 1, 1):
        table.merge(events, number)
    assert rows(table.sessions().select("key", "n_events")) == [("a", 4), ("b", 2)]
    held = table.manifest()
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(held | {"version": held["version"] - 1}, held)


def test_streams(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, h, m) for h, m in ((0, 5), (0, 50), (3, 0), (9, 0))]
    spark.createDataFrame([(t, "k") for t in at], "at timestamp, key string").write.parquet(str(tmp_path / "in"))
    for f, name in ((lambda s: streams.hourly_counts(s, "at", "key"), "hours"), (lambda s: streams.session_windows(s, "at", "key"), "windows")):
        stream = spark.readStream.schema("at timestamp, key string").parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.outputMode("complete" if name == "hours" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("hours").collect()) == [1, 1, 2]
    assert set(spark.table("windows").columns) == {"key", "session_start", "session_end", "n"}


def test_clusters_that_hold(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(40, 2)), r.normal(size=(40, 2)) + 20])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    assert cluster.stability(df, 2, draws=2) > 0.95
    assert cluster.k_from_gap(pd.DataFrame({"k": [1, 2, 3], "gap": [0.1, 0.9, 0.8], "sk": [0.01, 0.01, 0.01]})) == 2
    c = pd.DataFrame([[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1]], index=list("abc"), columns=list("abc"))
    assert cluster.uncorrelated(c) == ["c", "a"]


def test_graph_pieces(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id bigint")
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "src bigint, dst bigint")
    assert rows(graph.largest_component(nodes, edges)) == [(0,), (1,), (2,)]
    walks = graph.random_walks(spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src bigint, dst bigint"), 4, 8)
    v = graph.node_vectors(walks, 4, 2, 1).collect()
    assert {r["node"] for r in v} == {str(i) for i in range(6)} and all(len(r["vector"]) == 4 for r in v)


def test_walks_move_nothing_and_are_those_of_the_joins(spark, monkeypatch):
    edges = spark.createDataFrame([(i, j) for i in range(-3, 40) for j in range(i, 40, 3)] + [(2**40, 5), (5, 5), (7, None)], "src bigint, dst bigint")
    monkeypatch.setattr(graph, "ENDS", 64)  # many parts
    by_walk = lambda df: {(r["node"], r["walk"]): r["path"] for r in df.collect()}
    got = graph.random_walks(edges, 3, 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan, plan
    want = by_walk(graph.joined_walks(edges.dropna(), 3, 20))
    assert by_walk(got) == want and len(want) == 44 * 3
    small = edges.dropna().filter("src < 40").select(F.col("src").cast("int"), F.col("dst").cast("int"))
    a, b = graph.random_walks(small, 2, 5), graph.joined_walks(small, 2, 5)
    assert by_walk(a) == by_walk(b) and a.dtypes == b.dtypes


def test_small_ones(spark):
    one = spark.createDataFrame([([1.0, 2.0, 4.0],)], "v array<double>")
    assert abs(one.select(timeseries.ema_last(F.col("v"), 0.5).alias("y")).first()["y"] - 2.75) < 1e-12
    assert one.select(geo.planar(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)).alias("d")).first()["d"] == 5.0
    t = one.select(*[hourly.warped(F.lit(u), F.lit(1.0), F.lit(1.0)).alias(f"u{i}") for i, u in enumerate((0.0, 0.25, 1.0))]).first()
    assert np.allclose(t, (0, 0.25, 1))
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b), float(3 * a)) for a, b in r.normal(size=(120, 2))], "a double, b double, y double")
    imp = {x["feature"]: x["importance"] for x in models.forest_regression(df, ["a", "b"], "y").collect()}
    assert imp["a"] > imp["b"]


def test_moves_are_warped_and_stay_on_their_line(spark):
    m = spark.createDataFrame([("p", 0, "stay", 0.0, 3600.0, 0.0, 0.0, 0.0, 0.0), ("p", 1, "move", 3600.0, 10_800.0, 0.0, 0.0, 1.0, 2.0)], "person_id string, i int, kind string, start_s double, end_s double, lon0 double, lat0 double, lon1 double, lat1 double")
    even = hourly.hourly_positions(m, 3).orderBy("hour").collect()
    bent = hourly.hourly_positions(m, 3, warp_seed=7).orderBy("hour").collect()
    assert abs(even[1]["lon"] - 0.25) < 1e-9 and abs(even[2]["lon"] - 0.75) < 1e-9
    assert all(abs(r["lat"] - 2 * r["lon"]) < 1e-9 for r in bent) and 0 < bent[1]["lon"] < bent[2]["lon"] < 1 and bent[1]["lon"] != even[1]["lon"]
