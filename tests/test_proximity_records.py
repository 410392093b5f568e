"""Places near points and points in regions against brute force; records that fail to parse against a character parser."""

from __future__ import annotations

import random
import re
import struct

import numpy as np
import pytest

from tests.conftest import rows
from trackloom.operators import proximity
from trackloom.operators.proximity import containing_region, sphere_metres, within_distance
from trackloom.sources import records

POINTS, PLACES = "point bigint, lon double, lat double", "place string, lon double, lat double"


def brute(points, places, radius):
    ok = lambda x, y: x is not None and y is not None and x == x and y == y and abs(x) <= 180 and abs(y) <= 90 and (x, y) != (0, 0)
    return sorted({(p, q) for p, x, y in points for q, u, v in places if p is not None and q is not None and ok(x, y) and ok(u, v) and sphere_metres(np.float64(x), np.float64(y), np.float64(u), np.float64(v)) <= radius}, key=repr)


def some(n, seed, centre=(-80.0, 26.0), spread=0.004):
    r = random.Random(seed)
    return [(r.gauss(centre[0], spread), r.gauss(centre[1], spread)) for _ in range(n)]


def test_pairs_match_brute_force(spark):
    pts = [(i, x, y) for i, (x, y) in enumerate(some(300, 1))] + [(7, -80.0, 26.0), (900, None, 26.0), (901, float("nan"), 26.0), (902, 0.0, 0.0), (903, 200.0, 26.0), (None, -80.0, 26.0), (904, -80.0, 26.0)]
    plc = [(f"k{i % 150}", x, y) for i, (x, y) in enumerate(some(200, 2))] + [("z", 0.0, 0.0), ("n", None, 1.0), (None, -80.0, 26.0), ("k1", -80.0, 26.0), ("k1", -80.0, 26.0)]
    got = within_distance(spark.createDataFrame(pts, POINTS), spark.createDataFrame(plc, PLACES), 75.0)
    assert rows(got) == brute(pts, plc, 75.0)


def test_at_the_antimeridian_and_the_poles(spark):
    pts = [(1, 180.0, 10.0), (2, -179.9999, 10.0), (3, 12.0, 89.9999), (4, -170.0, 89.9999), (5, 5.0, -90.0)]
    plc = [("a", -180.0, 10.0), ("b", 179.9999, 10.0), ("c", 100.0, 89.9999), ("d", 77.0, -90.0)]
    got = within_distance(spark.createDataFrame(pts, POINTS), spark.createDataFrame(plc, PLACES), 75.0)
    assert rows(got) == brute(pts, plc, 75.0)


def test_hot_keys_are_split_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(proximity, "HOT_ROWS", 20)
    monkeypatch.setattr(proximity, "HOT_KEYS", 5)
    pts = [(i, -80.0 + i * 1e-7, 26.0) for i in range(200)]
    plc = [(f"k{i}", -80.0, 26.0 + i * 1e-7) for i in range(150)]
    got = within_distance(spark.createDataFrame(pts, POINTS), spark.createDataFrame(plc, PLACES), 75.0)
    assert got.count() == 200 * 150


def test_empty_tables_and_radius(spark):
    p, q = spark.createDataFrame([], POINTS), spark.createDataFrame([("a", 1.0, 1.0)], PLACES)
    assert rows(within_distance(p, q, 75.0)) == []
    assert rows(within_distance(spark.createDataFrame([(1, 1.0, 1.0)], POINTS), spark.createDataFrame([], PLACES), 75.0)) == []
    with pytest.raises(ValueError):
        within_distance(p, q, 0)


def wkb(*rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)


def test_points_in_regions(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    regions = [("a", wkb(square(0, 0, 1))), ("b", wkb(square(1, 0, 1))), ("hole", wkb(square(3, 0, 3), square(4, 1, 1))), ("tri", wkb([(0, 2), (2, 2), (1, 4), (0, 2)])), ("bad", b"\x01"), ("none", None)]
    big = (1 << 60) + 1  # kept whole, not through floats
    pts = [(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 1.0, 0.5), (4, 4.5, 1.5), (5, 3.5, 1.5), (6, 1.0, 3.0), (7, 0.1, 3.5), (8, None, 1.0), (big, 0.25, 0.25)]
    got = containing_region(spark.createDataFrame(pts, POINTS), spark.createDataFrame(regions, "region string, geometry binary"))
    assert rows(got) == sorted([(1, "a"), (2, "b"), (3, "b"), (5, "hole"), (6, "tri"), (big, "a")], key=repr)


def plain_reason(source, record):
    """A character-wise reading of a record, as a check."""
    text, cells, i, n = record or "", [], 0, len(record or "")
    while True:
        if i < n and text[i] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= n:
                    return "quoting"
                if text[i] == '"':
                    if i + 1 < n and text[i + 1] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + text[i], i + 1
            if i < n and text[i] != ",":
                return "quoting"
        else:
            j = text.find(",", i)
            j = n if j < 0 else j
            cell, i = text[i:j], j
            if '"' in cell:
                return "quoting"
        cells.append(cell)
        if i >= n:
            break
        i += 1
    layout = records.LAYOUTS.get(source)
    if layout is None or len(cells) != len(layout):
        return "column_count"
    row = dict(zip(layout, cells, strict=True))
    if "geometry" in row:
        num = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
        m = re.fullmatch(rf"\s*point\s*\(\s*({num})\s+({num})\s*\)\s*", row["geometry"], re.I | re.A)
        if not m or abs(float(m[1])) > 180 or abs(float(m[2])) > 90:
            return "geometry"
    name = row["LOCATION_NAME"]
    if not name.strip() or any(c in "�\x7f" or (c < " " and c not in "\t\n\r") for c in name):
        return "location_name"
    return None


HULL, US = "Hull_FL_poi_vec_subset", "US_POI"
FIXED = [
    (HULL, "k,name,l,1,POINT (-80.1 26.2)"),
    (HULL, 'k,"a ""b"", c",l,1,"point( -8.1e1   +2.6E1 )"'),
    (HULL, 'k,a"b,l,1,POINT (1 2)'),
    (HULL, 'k,"a"b,l,1,POINT (1 2)'),
    (HULL, 'k,"a,l,1,POINT (1 2)'),
    (HULL, 'k,"a\nb",l,1,POINT (1 2)'),
    (HULL, 'k,"",l,1,POINT (1 2)'),
    (HULL, 'k,"""",l,1,POINT (1 2)'),
    (HULL, "k,a,l,1,POINT (1 2),"),
    (HULL, "k,a,l,1,POINT (181 2)"),
    (HULL, "k,a,l,1,POINT Z (1 2 3)"),
    (HULL, "k,a,l,1,POINT EMPTY"),
    (HULL, "k,a,l,1,"),
    (HULL, "k,a\x02b,l,1,POINT (1 2)"),
    (HULL, "k,\xa0 ,l,1,POINT (1 2)"),
    (HULL, ""),
    (HULL, None),
    (US, "k,n,t,s,1,2,r"),
    (US, "k,n\\,t,s,1,2,r"),
    (US, "k,n�,t,s,x,y,r"),
    (US, "k,,t,s,1,2,r"),
    (US, '"k","n","t","s","1","2","r"'),
    (US, '"'),
    (US, "k,n,t,s,1,2,r,8"),
    ("other", "a,b"),
    (US, "k," + "long " * 20_000 + ",t,s,1,2,r"),
    (US, 'k,"' + '""' * 5_000 + '",t,s,1,2,r'),
]


def test_reasons_match_a_character_parser(spark):
    r = random.Random(4)
    data = list(FIXED) + [(r.choice([HULL, US]), "".join(r.choice('",ab\n \\') for _ in range(r.randrange(14)))) for _ in range(400)]
    raw = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(data)], "raw_id bigint, source_file string, record string")
    want = [(i, plain_reason(s, x)) for i, (s, x) in enumerate(data)]
    assert rows(records.failures(raw)) == sorted([w for w in want if w[1]], key=repr)


def test_valid_rows_keep_their_cells(spark):
    raw = spark.createDataFrame([(1, US, 'k,"a ""b"", c\nd",t,s,1,2,"r\x02"'), (2, US, "bad")], "raw_id bigint, source_file string, record string")
    assert rows(records.valid_rows(raw, US)) == [(1, "k", 'a "b", c\nd', "t", "s", "1", "2", "r\x02")]


def test_no_records(spark):
    assert rows(records.failures(spark.createDataFrame([], "raw_id bigint, source_file string, record string"))) == []


def test_every_record_is_valid_or_has_a_reason(spark, tmp_path):
    import __spark_entry__

    raw = [
        (1, "Hull_FL_poi_vec_subset", "k1,Mole Cafe,a|b,h1,POINT (-80.1 26.2)"),
        (2, "Hull_FL_poi_vec_subset", "k2,Mole Cafe,a|b,h1,POINT (-80.1)"),
        (3, "US_POI", 'k3,"Bay, Inn",t,s,-80.1,26.2,FL'),
        (4, "US_POI", "k4,Bay Inn,t,s,-80.1"),
    ]
    spark.createDataFrame(raw, "raw_id bigint, source_file string, record string").write.parquet(f"{tmp_path}/poi_raw.parquet")
    q = __spark_entry__.queries()
    ids = lambda name: sorted(r["raw_id"] for r in q[name](spark, str(tmp_path)).collect())
    assert (ids("p7_valid_subset"), ids("p7_valid_places"), ids("p7_found")) == ([1], [3], [2, 4])
    assert q["p7_valid_subset"](spark, str(tmp_path)).collect()[0].asDict() == {"raw_id": 1, "PLACEKEY": "k1", "LOCATION_NAME": "Mole Cafe", "label_pair": "a|b", "hex_id": "h1", "geometry": "POINT (-80.1 26.2)"}
