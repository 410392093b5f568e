"""Points near other points, and points in regions, by a trapezoidal decomposition.

Slabs. The plane of longitude and latitude is cut into slabs. Around every place stands the box that holds its circle;
inside a slab of the height of a box' half, the boxes' boundaries become vertical edges ordered by longitude. All boxes of
a slab are made equally wide, so the boxes over a point are those whose left edge lies between the point less that width
and the point: two binary searches on the ordered edges. The boxes found are trapezoids that hold the point, or nearly;
an exact distance settles each.

Distribution. A slab is cut into tiles; slab and tile are the key of the one shuffle. A point goes to one key, a place to
those its box meets (three slabs, at most two tiles). Keys with many points or places are split: points into salts, places
into blocks, each salt meeting each block. The share of a key that makes it hot follows the size of the tables, so that
there are at most HOT_KEYS of them on either side; only their list is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.arrow import grouped

#: Metres, of the sphere on which distances are taken.
RADIUS = 6_371_008.8
#: A key is hot with more than max(HOT_ROWS, rows / HOT_KEYS) rows, which bounds the number of hot keys by HOT_KEYS.
HOT_ROWS, HOT_KEYS = 50_000, 1_000
#: Tiles are at least this wide, in degrees.
TILE = 0.02
#: Candidates tested at a time.
STEP = 1_000_000


def placed(lon: Column, lat: Column) -> Column:
    """True for a position that counts: not null, not NaN, within 180 and 90 degrees, and not exactly 0, 0."""
    return F.coalesce((F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~F.isnan(lon) & ~F.isnan(lat) & ~((lon == 0) & (lat == 0)), F.lit(False))


def sphere_metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Great-circle metres between degrees, by the haversine."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _slab(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height).cast("int")


def _half_width(slab: Column, radius: float, height: float) -> Column:
    """Degrees of longitude that a circle with its centre in this slab or one beside it reaches to either side."""
    far = F.greatest(F.abs((slab - 1) * height - 90), F.abs((slab + 2) * height - 90))
    s = math.sin(radius / RADIUS)
    c = F.cos(F.radians(F.least(far, F.lit(90.0))))
    return F.when(c > s * 1.001, F.degrees(F.asin(F.least(s / c, F.lit(1.0)))) * (1 + 1e-9) + 1e-9).otherwise(F.lit(180.0))


def _tile(lon: Column, half: Column) -> Column:
    return F.floor((lon + 540) / F.greatest(F.lit(TILE), 8 * half)).cast("int")


def _search(radius: float):
    height = _height(radius)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Points (pid not null) and edges of one partition to pairs."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("slab", "tile", "salt", "block")])
        spans = [int(k.max() - k.min()) + 1 for k in key]
        code = np.zeros(len(t), np.int64)
        for k, n in zip(key, spans, strict=True):
            code = code * n + (k - k.min())
        group = np.unique(code, return_inverse=True)[1].astype(np.int64)
        lon, lat, half = t["lon"].to_numpy(), t["lat"].to_numpy(), t["half"].to_numpy()
        is_point = t["place"].is_null().to_numpy()
        points, edges = np.flatnonzero(is_point), np.flatnonzero(~is_point)
        if not len(points) or not len(edges):
            return
        side = 1 << 41
        fixed = lambda x: ((x + 720) * 1e9).astype(np.int64)
        left = group[edges] * side + fixed(lon[edges] - half[edges]) - 1
        order = np.argsort(left, kind="stable")
        left, edges = left[order], edges[order]
        at = group[points] * side
        lo = np.searchsorted(left, at + fixed(lon[points] - 2 * half[points]) - 2, "left")
        hi = np.searchsorted(left, at + fixed(lon[points]), "right")
        n = hi - lo
        keep = n > 0
        points, lo, n = points[keep], lo[keep], n[keep]
        total = np.cumsum(n)
        begin = 0
        while begin < len(points):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + STEP, "right")))
            m = n[begin:end]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            p, e = np.repeat(points[begin:end], m), edges[np.repeat(lo[begin:end], m) + within]
            near = np.abs(lat[p] - lat[e]) <= height
            p, e = p[near], e[near]
            near = sphere_metres(lon[p], lat[p], lon[e], lat[e]) <= radius
            p, e = p[near], e[near]
            for i in range(0, len(p), 50_000):
                yield from pa.table({"point": t["point"].take(pa.array(p[i : i + 50_000])), "place": t["place"].take(pa.array(e[i : i + 50_000]))}).to_batches()
            begin = end

    return search


def _height(radius: float) -> float:
    return math.degrees(radius / RADIUS) * (1 + 1e-9) + 1e-12


def _hot(df: DataFrame, rows: int, into: str) -> DataFrame | None:
    """The hot keys of df and into how many parts to split them; at most HOT_KEYS rows, since each holds that share."""
    most = max(HOT_ROWS, rows // HOT_KEYS)
    found = df.groupBy("slab", "tile").count().filter(F.col("count") > most).collect()
    if not found:
        return None
    return df.sparkSession.createDataFrame([(r["slab"], r["tile"], -(-r["count"] // most)) for r in found], f"slab int, tile int, {into} int")


def within_distance(points: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """points(point bigint, lon, lat) and places(place string, lon, lat) to the distinct pairs (point, place) with any
    rows at most `radius` metres apart on the sphere.

    Positions that do not count (see `placed`) and null names are left out; repeated rows give one pair; longitudes meet
    at 180 degrees, and circles may hold a pole. Either table may be empty.
    """
    if not 0 < radius < 1_000_000:
        raise ValueError("radius must lie between 0 and 1 000 000 metres")
    height = _height(radius)
    here = placed(F.col("lon"), F.col("lat"))
    pts = (
        points.select("point", F.col("lon").cast("double"), F.col("lat").cast("double"))
        .filter(F.col("point").isNotNull() & here)
        .withColumn("slab", _slab(F.col("lat"), height))
        .withColumn("half", _half_width(F.col("slab"), radius, height))
        .withColumn("tile", _tile(F.col("lon"), F.col("half")))
    )
    box = places.select("place", F.col("lon").cast("double"), F.col("lat").cast("double")).filter(F.col("place").isNotNull() & here).distinct()
    box = (
        box.withColumn("slab", F.explode(F.sequence(_slab(F.col("lat") - height, height), _slab(F.col("lat") + height, height))))
        .withColumn("half", _half_width(F.col("slab"), radius, height))
        .withColumn("lon", F.explode(F.filter(F.array("lon", F.col("lon") - 360, F.col("lon") + 360), lambda x: F.abs(x) <= F.col("half") + 180)))
        .withColumn("tile", F.explode(F.sequence(_tile(F.col("lon") - F.col("half"), F.col("half")), _tile(F.col("lon") + F.col("half"), F.col("half")))))
    )
    # counts of the two tables come with one pass each; the lists of hot keys are bounded by HOT_KEYS
    hot_p, hot_b = _hot(pts, pts.count(), "salts"), _hot(box, box.count(), "blocks")
    on = ["slab", "tile"]
    for hot, name in ((hot_p, "salts"), (hot_b, "blocks")):
        if hot is None:
            pts, box = pts.withColumn(name, F.lit(1)), box.withColumn(name, F.lit(1))
        else:
            pts, box = (d.join(F.broadcast(hot), on, "left").withColumn(name, F.coalesce(name, F.lit(1))) for d in (pts, box))
    both = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pts = pts.withColumn("salt", F.pmod(F.xxhash64("point"), F.col("salts")).cast("int")).withColumn("block", F.explode(both("blocks")) if hot_b is not None else F.lit(0))
    box = box.withColumn("block", F.pmod(F.xxhash64("place", "lon", "lat"), F.col("blocks")).cast("int")).withColumn("salt", F.explode(both("salts")) if hot_p is not None else F.lit(0))
    cols = ["point", "place", "lon", "lat", "half", "slab", "tile", "salt", "block"]
    rows = pts.withColumn("place", F.lit(None).cast("string")).select(cols).unionByName(box.withColumn("point", F.lit(None).cast("bigint")).select(cols))
    found = rows.repartition("slab", "tile", "salt", "block").mapInArrow(_search(radius), "point bigint, place string")
    return found.distinct()


def _rings(geometry: bytes) -> list[np.ndarray]:
    """The rings of a WKB polygon or multipolygon, as arrays of (lon, lat); none for anything else."""
    rings: list[np.ndarray] = []

    def read(at: int) -> int:
        order = "<" if geometry[at] == 1 else ">"
        kind = int(np.frombuffer(geometry, order + "u4", 1, at + 1)[0]) & 0xFF
        n = int(np.frombuffer(geometry, order + "u4", 1, at + 5)[0])
        at += 9
        if kind == 3:
            for _ in range(n):
                m = int(np.frombuffer(geometry, order + "u4", 1, at)[0])
                rings.append(np.frombuffer(geometry, order + "f8", 2 * m, at + 4).reshape(m, 2).astype(float))
                at += 4 + 16 * m
        elif kind == 6:
            for _ in range(n):
                at = read(at)
        return at

    if geometry and len(geometry) >= 9:
        try:
            read(0)
        except (ValueError, IndexError):
            return []
    return rings


def region_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, geometry) to the edges of its rings that are not level: region, x0, y0, x1, y1 with y0 < y1."""
    for b in batches:
        region, edges = [], []
        for name, wkb in zip(b["region"].to_pylist(), b["geometry"].to_pylist(), strict=True):
            for ring in _rings(wkb) if wkb else []:
                e = np.hstack([ring[:-1], ring[1:]])
                e = e[np.isfinite(e).all(1) & (e[:, 1] != e[:, 3])] if len(e) else e.reshape(0, 4)
                e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
                edges.append(e)
                region += [name] * len(e)
        e = np.vstack(edges) if edges else np.empty((0, 4))
        yield pa.RecordBatch.from_pydict({"region": pa.array(region, pa.string()), "x0": e[:, 0], "y0": e[:, 1], "x1": e[:, 2], "y1": e[:, 3]})


def region_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, geometry) to all edges of its rings: name, x0, y0, x1, y1."""
    for b in batches:
        name, edges = [], [np.empty((0, 4))]
        for one, wkb in zip(b["region"].to_pylist(), b["geometry"].to_pylist(), strict=True):
            for ring in _rings(wkb) if wkb else []:
                e = np.hstack([ring[:-1], ring[1:]])
                edges.append(e[np.isfinite(e).all(1)])
                name += [one] * len(edges[-1])
        e = np.vstack(edges)
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *(pa.array(c) for c in e.T)], ["name", "x0", "y0", "x1", "y1"])


def trapezoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, geometry) to the trapezoids of each region: between two heights (y0, y1), from a left edge to a right one, each
    edge as the whole edge it is part of (lx0, ly0, lx1, ly1, rx0, ...), and the least and largest longitude they span.

    A region's vertices cut it into slabs in which no edge begins or ends; in a slab its edges, in order, open and close it.
    """
    names = ["region", "y0", "y1", "xmin", "xmax", *(f"{side}{c}" for side in "lr" for c in ("x0", "y0", "x1", "y1"))]
    for b in batches:
        region, parts = [], []
        for name, wkb in zip(b["region"].to_pylist(), b["geometry"].to_pylist(), strict=True):
            rings = _rings(wkb) if wkb else []
            e = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings if len(r) > 1] or [np.empty((0, 4))])
            e = e[np.isfinite(e).all(1) & (e[:, 1] != e[:, 3])]
            if not len(e):
                continue
            e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
            ys = np.unique(e[:, [1, 3]])
            lo, hi = np.searchsorted(ys, e[:, 1]), np.searchsorted(ys, e[:, 3])
            n = hi - lo
            of = np.repeat(np.arange(len(e)), n)
            slab = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((_x_at(e[of], (ys[slab] + ys[slab + 1]) / 2), slab))
            of, slab = of[order], slab[order]
            begin = np.searchsorted(slab, slab)
            left = np.flatnonzero((np.arange(len(slab)) - begin) % 2 == 0)
            left = left[(left + 1 < len(slab))]
            left = left[slab[left] == slab[left + 1]]
            el, er, y0, y1 = e[of[left]], e[of[left + 1]], ys[slab[left]], ys[slab[left] + 1]
            at = np.stack([_x_at(side, y) for side in (el, er) for y in (y0, y1)])
            parts.append(np.column_stack([y0, y1, at.min(0), at.max(0), el, er]))
            region += [name] * len(left)
        x = np.vstack(parts) if parts else np.empty((0, 12))
        yield pa.RecordBatch.from_arrays([pa.array(region, pa.string()), *(pa.array(c) for c in x.T)], names)


def _x_at(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The longitude of edges (x0, y0, x1, y1) at a height."""
    return e[:, 0] + (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1])


_SIDES = [f"{side}{c}" for side in "lr" for c in ("x0", "y0", "x1", "y1")]


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trapezoids (point null) and then points of one tile at a time, to (point, region).

    In the order of their least longitude, the trapezoids over a point lie between two places found by binary search: the last
    that begins at or left of it, and the first behind which one reaches it. Height and edges settle each.
    """
    for t in grouped(batches, ["slab", "tile", "part"]):
        is_point = t["region"].is_null().to_numpy()
        pts, box = np.flatnonzero(is_point), np.flatnonzero(~is_point)
        if not len(pts) or not len(box):
            continue
        c = {k: t[k].to_numpy() for k in ("y0", "y1", "xmin", "xmax", *_SIDES)}
        box = box[np.argsort(c["xmin"][box], kind="stable")]
        reach = np.maximum.accumulate(c["xmax"][box])
        x, y = c["xmin"][pts], c["y0"][pts]
        lo, hi = np.searchsorted(reach, x), np.searchsorted(c["xmin"][box], x, "right")
        n = np.maximum(hi - lo, 0)
        keep = n > 0
        pts, lo, n = pts[keep], lo[keep], n[keep]
        total, begin = np.cumsum(n), 0
        left, right = (np.column_stack([c[f"{side}{k}"] for k in ("x0", "y0", "x1", "y1")]) for side in "lr")
        while begin < len(pts):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + STEP, "right")))
            m = n[begin:end]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            p, e = np.repeat(pts[begin:end], m), box[np.repeat(lo[begin:end], m) + within]
            x, y = c["xmin"][p], c["y0"][p]
            near = (c["y0"][e] <= y) & (y < c["y1"][e])
            p, e, x, y = p[near], e[near], x[near], y[near]
            near = (_x_at(left[e], y) <= x) & (x < _x_at(right[e], y))
            p, e = p[near], e[near]
            for i in range(0, len(p), 50_000):
                yield from pa.table({"point": t["point"].take(pa.array(p[i : i + 50_000])), "region": t["region"].take(pa.array(e[i : i + 50_000]))}).to_batches()
            begin = end


def containing_region(points: DataFrame, regions: DataFrame, slab: float = 0.25) -> DataFrame:
    """points(point, lon, lat) and regions(region string, geometry WKB) to (point, region) for every region that
    holds the point; a border belongs to the region to its east or north.

    Regions are cut into trapezoids, and these and the points dealt to tiles of `slab` degrees; only tiles with points are
    filled. A tile with many points is split by their hash, each part with a copy of the tile's trapezoids. Positions that do
    not count and regions without a readable geometry give no rows.
    """
    at = lambda c: F.floor((c + 540) / slab).cast("int")
    pts = points.select("point", F.col("lon").cast("double").alias("xmin"), F.col("lat").cast("double").alias("y0")).filter(F.col("point").isNotNull() & placed(F.col("xmin"), F.col("y0")))
    pts = pts.withColumns({"slab": at(F.col("y0")), "tile": at(F.col("xmin"))})
    numbers = ["y0", "y1", "xmin", "xmax", *_SIDES]
    boxes = regions.select("region", "geometry").filter("region is not null and geometry is not null").mapInArrow(trapezoids, "region string, " + ", ".join(f"{c} double" for c in numbers))
    boxes = boxes.withColumn("slab", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1"))))).withColumn("tile", F.explode(F.sequence(at(F.col("xmin")), at(F.col("xmax")))))
    counts = pts.groupBy("slab", "tile").count().withColumn("parts", F.ceil(F.col("count") / HOT_ROWS).cast("int")).select("slab", "tile", "parts")
    pts = pts.join(counts, ["slab", "tile"]).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
    boxes = boxes.join(counts, ["slab", "tile"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols, kind = ["slab", "tile", "part", "point", "region", *numbers], dict(points.dtypes)["point"]
    rows = boxes.withColumn("point", F.lit(None).cast(kind)).select(cols).unionByName(pts.select("slab", "tile", "part", "point", "xmin", "y0"), allowMissingColumns=True)
    return rows.repartition("slab", "tile", "part").sortWithinPartitions("slab", "tile", "part").mapInArrow(_locate, f"point {kind}, region string").distinct()
