"""Stitching over the borders of chunks against plain windows, with one person who holds a third of the rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo
from trackloom.operators import stitch


def trips(n=900):
    r = random.Random(4)
    out, at = [], {}
    for i in range(n):
        p = "hot" if r.random() < 0.4 else f"p{r.randrange(40)}"
        t, lon, lat = at.get(p, (0, 0.5, 0.5))
        start = t + r.choice([-600, 60, 7_200, 20_000, 40 * 86_400])
        lon0, lat0 = (lon, lat) if r.random() < 0.7 else (r.random(), r.random())
        end = max(start, start + r.randrange(3_600))
        at[p] = (end, r.random(), r.random())
        out.append((p, i, start, end, lon0, lat0, *at[p][1:]))
    return out


def test_as_one_window_would(spark, monkeypatch):
    monkeypatch.setattr(stitch, "CHUNK_S", 50_000)
    monkeypatch.setattr(stitch, "CHUNK_SEGMENTS", 3)
    df = spark.createDataFrame(trips(), "person_id string, trip_id bigint, start_s bigint, end_s bigint, lon0 double, lat0 double, lon1 double, lat1 double")
    got = stitch.tagged(df, geo.haversine)
    w = Window.partitionBy("person_id").orderBy("start_s", "end_s", "trip_id")
    plain = {r["trip_id"]: r for r in df.select("trip_id", "person_id", F.lag("end_s").over(w).alias("e"), F.lag("lon1").over(w).alias("x"), F.lead("trip_id").over(w).alias("n")).collect()}
    seg = {}
    rows = got.orderBy("person_id", "start_s", "end_s", "trip_id").collect()
    for r in rows:
        p = plain[r["trip_id"]]
        assert (r["prev_end"], r["prev_lon"]) == (p["e"], p["x"])
        if r["tag"] is not None:
            seg[r["person_id"]] = seg.get(r["person_id"], 0) + (r["tag"] != "continue")
        assert r["seg_id"] == seg.get(r["person_id"], 0)
    parts = {(r["person_id"], r["seg_id"]): r["ended_by"] for r in stitch.segments(got).collect()}
    opened = {(r["person_id"], r["seg_id"]): r["tag"] for r in rows if r["tag"] not in (None, "continue")}
    assert all(e == opened.get((p, s + 1), "final") for (p, s), e in parts.items()) and "final" in parts.values()
    steps = df.withColumn("step_order", F.struct("start_s", "end_s", "trip_id"))
    legs = {r["trip_id"]: r["next_trip_id"] for r in stitch.legs(steps, carried=("trip_id",), at=F.floor(F.col("start_s") / 50_000)).collect()}
    assert legs == {t: r["n"] for t, r in plain.items() if r["n"] is not None}


def test_nothing(spark):
    none = spark.createDataFrame([], "person_id string, trip_id bigint, start_s bigint, end_s bigint, lon0 double, lat0 double, lon1 double, lat1 double")
    assert stitch.segments(stitch.tagged(none, geo.haversine)).count() == 0
