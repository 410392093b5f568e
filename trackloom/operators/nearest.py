"""Nearest neighbours by position: the k nearest places of each point, and the region a point is in or nearest to.

Places are cut into leaves of about LEAF by a tree over their positions in space (a unit vector, so that neither the poles
nor the 180th meridian is a border), fitted on a bounded sample. A place is in one leaf. A point asks the leaf it falls in;
the distance to its k-th place there bounds the search, and where that ball leaves the leaf the point asks the other leaves
the ball meets, once more and no more. Hence two joins whatever the data, no ladder of grids, and no pair of a point and a
place outside the leaves that can matter.

Only the k smallest names of places at one position can count, so that a heap of places at one spot is k rows. A leaf with
many points is split into salts, each with a copy of its at most few thousand places; a task holds one salt at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import shared
from trackloom.arrow import grouped, ordinals
from trackloom.functions import geo
from trackloom.operators.numbering import numbered
from trackloom.operators.proximity import containing_region, placed, region_borders

#: Places of a leaf, positions of the sample that fits the tree, points of a leaf that go to one task.
LEAF, SAMPLE, SALT = 1_500, 200_000, 50_000
#: Points compared with the places of their leaf at a time.
STEP = 256


def in_space(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], 1)


class Tree:
    """Boxes that part space: node i splits dimension dim[i] at cut[i] (a coordinate of cut or more goes right)."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.left, self.right, self.leaf, self.leaves = [], [], [], [], [], 0

        def grow(x: np.ndarray, n: int) -> int:
            i = len(self.dim)
            for part in (self.dim, self.left, self.right, self.leaf):
                part.append(-1)
            self.cut.append(0.0)
            if n > 1 and len(x) > 1:
                d = int(np.argmax(np.ptp(x, axis=0)))
                c = float(np.partition(x[:, d], len(x) // 2)[len(x) // 2])
                to_right = x[:, d] >= c
                if to_right.any() and not to_right.all():
                    self.dim[i], self.cut[i] = d, c
                    self.left[i] = grow(x[~to_right], n // 2)
                    self.right[i] = grow(x[to_right], n - n // 2)
                    return i
            self.leaf[i], self.leaves = self.leaves, self.leaves + 1
            return i

        grow(sample, leaves)
        self._pack()

    def _pack(self) -> None:
        self.dim, self.left, self.right, self.leaf = (np.array(x, np.int64) for x in (self.dim, self.left, self.right, self.leaf))
        self.cut = np.array(self.cut)

    def pruned(self, counts: np.ndarray, least: int) -> None:
        """Nodes with a child of fewer than `least` places become leaves."""
        total = np.zeros(len(self.dim), np.int64)
        for i in range(len(self.dim) - 1, -1, -1):  # children come behind their parents
            if self.dim[i] < 0:
                total[i] = counts[self.leaf[i]]
                continue
            a, b = total[self.left[i]], total[self.right[i]]
            total[i] = a + b
            if min(a, b) < least:
                self.dim[i] = -1
        at, self.leaves = [0], 0
        while at:
            i = at.pop()
            if self.dim[i] < 0:
                self.leaf[i], self.leaves = self.leaves, self.leaves + 1
            else:
                at += [self.left[i], self.right[i]]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each position."""
        node, row = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(row):
            row = row[self.dim[node[row]] >= 0]
            n = node[row]
            node[row] = np.where(x[row, self.dim[n]] >= self.cut[n], self.right[n], self.left[n])
        return self.leaf[node]

    def meets(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves a ball around each position may meet."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves = [], []
        while len(row):
            done = self.dim[node] < 0
            rows.append(row[done])
            leaves.append(self.leaf[node[done]])
            row, node = row[~done], node[~done]
            off = x[row, self.dim[node]] - self.cut[node]
            to_left, to_right = off <= radius[row], off >= -radius[row]
            row, node = np.concatenate([row[to_left], row[to_right]]), np.concatenate([self.left[node[to_left]], self.right[node[to_right]]])
        return np.concatenate(rows), np.concatenate(leaves)


def _floats(b: pa.RecordBatch | pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(b[n].to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b[n].to_numpy() for n in names)


def _routed(tree: Tree):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.route(in_space(*_floats(b, "lon", "lat"))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    return route


def _search(k: int, tree: Tree, home: bool):
    """Groups of one leaf and salt, places first, to the k nearest of each point: point, lon, lat, found, and at home the
    other leaves its ball meets."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["leaf", "salt"]):
            is_place = t["is_place"].to_numpy()
            places, points = t.filter(pa.array(is_place)), t.filter(pa.array(~is_place))
            if not len(points) or not len(places):
                continue
            name = ordinals(places["place"].combine_chunks())
            at = np.argsort(name, kind="stable")  # so that equal distances lie in the order of names
            places = places.take(pa.array(at))
            lon_q, lat_q = _floats(places, "lon", "lat")
            q = in_space(lon_q, lat_q).T.copy()
            lon_p, lat_p, reach_p = _floats(points, "lon", "lat", "reach")
            p = in_space(lon_p, lat_p)
            few = min(k, len(places))
            for s in range(0, len(points), STEP):
                x = p[s : s + STEP]
                d = (x[:, :1] - q[0]) ** 2
                for i in (1, 2):
                    d += (x[:, i : i + 1] - q[i]) ** 2
                limit = np.partition(d, few - 1, axis=1)[:, few - 1] * (1 + 1e-6) + 1e-20
                if not home:
                    limit = np.minimum(limit, reach_p[s : s + STEP] ** 2)
                row, col = np.nonzero(d <= limit[:, None])
                metres = _haversine(lon_p[s + row], lat_p[s + row], lon_q[col], lat_q[col])
                order = np.lexsort((col, metres, row))
                row, col, metres = row[order], col[order], metres[order]
                begin = np.searchsorted(row, np.arange(len(x)))
                keep = np.arange(len(row)) - begin[row] < k
                row, col, metres = row[keep], col[keep], metres[keep]
                size = np.bincount(row, minlength=len(x))
                found = pa.StructArray.from_arrays([pa.array(metres), places["place"].combine_chunks().take(pa.array(col))], ["dist_m", "place"])
                off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                some = points.slice(s, len(x))
                cols = [some["point"].combine_chunks(), *(pa.array(v[s : s + STEP]) for v in (lon_p, lat_p)), pa.ListArray.from_arrays(off, found)]
                names = ["point", "lon", "lat", "found"]
                if home:
                    # the chord to the k-th, a little more; with fewer than k in the leaf, which is then all there is, none
                    last = np.sqrt(limit) * (1 + 1e-6) + 1e-12
                    own = int(t["leaf"][0].as_py())
                    r, leaf = tree.meets(x, last) if tree.leaves > 1 else (np.empty(0, np.int64), np.empty(0, np.int64))
                    r, leaf = r[leaf != own], leaf[leaf != own]
                    order = np.argsort(r, kind="stable")
                    n = np.bincount(r, minlength=len(x))
                    off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    cols += [pa.array(last), pa.ListArray.from_arrays(off, pa.array(leaf[order].astype(np.int32)))]
                    names += ["reach", "others"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return search


def _haversine(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return np.arcsin(np.sqrt(np.minimum(h, 1.0))) * (2 * geo.SPHERE)


def k_nearest(points: DataFrame, places: DataFrame, k: int, leaf: int = LEAF, salt: int = SALT) -> DataFrame:
    """points(point, lon, lat) and places(place, lon, lat) to point, place, dist_m, rank: the k nearest by haversine, ties
    by the place.

    Fewer than k places give fewer rows, none give none. Positions that do not count and null places are left out; a point
    that stands repeatedly in the input must not (give each row its own point).
    """
    spark = points.sparkSession
    here = placed(F.col("lon"), F.col("lat"))
    asked = points.select("point", F.col("lon").cast("double"), F.col("lat").cast("double")).filter(here)
    spot = Window.partitionBy("lon", "lat").orderBy("place")
    held = places.select("place", F.col("lon").cast("double"), F.col("lat").cast("double")).filter(here & F.col("place").isNotNull()).withColumn("_n", F.row_number().over(spot)).filter(F.col("_n") <= k).drop("_n")
    held = shared.stored(held, "places")
    kinds = dict(asked.dtypes) | {"place": dict(held.dtypes)["place"]}
    n = held.count()
    none = spark.createDataFrame([], f"point {kinds['point']}, place {kinds['place']}, dist_m double, rank int")
    if not n:
        return none
    leaf = max(leaf, 4 * k)
    some = held if n <= SAMPLE else held.filter(F.pmod(F.xxhash64("place", "lon", "lat"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n) + 1)
    at = some.select("lon", "lat").toArrow()  # about SAMPLE rows
    tree = Tree(in_space(*_floats(at, "lon", "lat")), max(1, min(n // leaf, len(at) // 8)))
    place_rows = lambda: held.mapInArrow(_routed(tree), f"place {kinds['place']}, lon double, lat double, leaf int")
    if tree.leaves > 1:
        counts = np.zeros(tree.leaves, np.int64)
        for r in place_rows().groupBy("leaf").count().collect():  # one row a leaf
            counts[r["leaf"]] = r["count"]
        tree.pruned(counts, k + 1)
    point_rows = shared.stored(asked.mapInArrow(_routed(tree), f"point {kinds['point']}, lon double, lat double, leaf int"), "points")
    schema = f"point {kinds['point']}, lon double, lat double, found array<struct<dist_m: double, place: {kinds['place']}>>"

    def met(asking: DataFrame, home: bool) -> DataFrame:
        """asking(point, lon, lat, reach, leaf) against the places of its leaf."""
        salts = asking.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / salt).cast("int").alias("salts"))  # one row a leaf
        spread = asking.join(F.broadcast(salts), "leaf").withColumn("salt", F.pmod(F.xxhash64("point"), F.col("salts")).cast("int"))
        copies = place_rows().join(F.broadcast(salts), "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        cols = ["leaf", "salt", "is_place", "point", "place", "lon", "lat", "reach"]
        both = spread.withColumns({"is_place": F.lit(False), "place": F.lit(None).cast(kinds["place"])}).select(cols).unionByName(
            copies.withColumns({"is_place": F.lit(True), "point": F.lit(None).cast(kinds["point"]), "reach": F.lit(None).cast("double")}).select(cols)
        )
        more = ", reach double, others array<int>" if home else ""
        return both.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt").mapInArrow(_search(k, tree, home), schema + more)

    first = shared.stored(met(point_rows.withColumn("reach", F.lit(None).cast("double")), True), "nearest")
    final = first.filter(F.size("others") == 0).select("point", "found")
    if tree.leaves > 1:
        open_ = first.filter(F.size("others") > 0)
        again = met(open_.select("point", "lon", "lat", "reach", F.explode("others").alias("leaf")), False).select("point", "found")
        merged = open_.select("point", "found").unionByName(again).groupBy("point").agg(F.flatten(F.collect_list("found")).alias("found"))  # k rows of each leaf its ball meets
        final = final.unionByName(merged.select("point", F.slice(F.array_sort("found"), 1, k).alias("found")))
    return final.select("point", F.posexplode("found").alias("i", "x")).select("point", "x.place", "x.dist_m", (F.col("i") + 1).alias("rank"))


#: Metres of the pieces into which segments are cut.
PIECE_M = 500.0


def _to_pieces(tree: Tree, home: bool):
    """Groups of one leaf and salt, pieces and points, to the nearest piece of each point: point, lon, lat, dist_m, number,
    and at home the other leaves with pieces that may be nearer."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["leaf", "salt"]):
            is_piece = t["number"].is_valid().to_numpy()
            pieces, points = t.filter(pa.array(is_piece)), t.filter(pa.array(~is_piece))
            if not len(points) or not len(pieces):
                continue
            pieces = pieces.take(pa.array(np.argsort(pieces["number"].to_numpy(), kind="stable")))  # ties to the first name
            number = pieces["number"].to_numpy()
            q = in_space(*_floats(pieces, "lon", "lat"))
            a, b = in_space(*_floats(pieces, "ax", "ay")), in_space(*_floats(pieces, "bx", "by"))
            ab = b - a
            square = (ab * ab).sum(1)
            half, bend = _extent(q, a, b)
            half, bend = float(half.max()), float(bend.max())
            lon_p, lat_p = _floats(points, "lon", "lat")
            p, own = in_space(lon_p, lat_p), int(t["leaf"][0].as_py())
            widest = _floats(points, "reach")[0]
            for s in range(0, len(points), STEP):
                x = p[s : s + STEP]
                d = 2 - 2 * (x @ q.T)  # squared chords to the middles
                limit = np.sqrt(np.maximum(d.min(1), 0) + BLUR) + bend + half
                row, col = np.nonzero(d <= (limit**2 + BLUR)[:, None])
                ap = a[col] - x[row]
                with np.errstate(divide="ignore", invalid="ignore"):
                    along = np.where(square[col] > 0, np.clip(-(ab[col] * ap).sum(1) / square[col], 0, 1), 0.0)
                chord = np.sqrt(((ap + along[:, None] * ab[col]) ** 2).sum(1))
                metres = np.floor(np.arcsin(np.minimum(chord / 2, 1.0)) * (2 * geo.SPHERE) * 1000 + 0.5) / 1000
                order = np.lexsort((col, metres, row))
                first = order[np.searchsorted(row[order], np.arange(len(x)))]
                some = points.slice(s, len(x))
                cols = [some["point"].combine_chunks(), *(pa.array(v[s : s + STEP]) for v in (lon_p, lat_p)), pa.array(metres[first]), pa.array(number[col[first]])]
                names = ["point", "lon", "lat", "dist_m", "number"]
                if home:
                    reach = np.sqrt(np.maximum(chord[first], 0) ** 2 + BLUR) + widest[s : s + STEP]  # a middle may lie so far off
                    r, leaf = tree.meets(x, reach) if tree.leaves > 1 else (np.empty(0, np.int64), np.empty(0, np.int64))
                    r, leaf = r[leaf != own], leaf[leaf != own]
                    order = np.argsort(r, kind="stable")
                    off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(x)))]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(off, pa.array(leaf[order].astype(np.int32))))
                    names.append("others")
                yield pa.RecordBatch.from_arrays(cols, names)

    return search


#: More than what a squared chord is off by as a product of unit vectors, or by a millimetre's rounding.
BLUR = 1e-14


def _extent(middle: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far a piece reaches from its middle, and how far the middle is from its line (chords)."""
    far = lambda x: np.sqrt(((x - middle) ** 2).sum(1))
    return np.maximum(far(a), far(b)) + 1e-9, far((a + b) / 2) + 1e-9


def nearest_segment(points: DataFrame, segments: DataFrame, piece_m: float = PIECE_M, leaf: int = LEAF, salt: int = SALT) -> DataFrame:
    """points(point, lon, lat) and segments(name, x0, y0, x1, y1) to point, name, dist_m: the segment nearest to each point,
    distances to the millimetre, ties by the name."""
    return nearest_segment_at(points, segments, piece_m, leaf, salt).select("point", "name", "dist_m")


def nearest_segment_at(points: DataFrame, segments: DataFrame, piece_m: float = PIECE_M, leaf: int = LEAF, salt: int = SALT) -> DataFrame:
    """nearest_segment with lon and lat of the points.

    Segments are cut into pieces of piece_m at most (straight in degrees), and pieces lie in the leaves of a tree over their
    middles. A point asks the leaf it falls in for its nearest piece; a nearer one elsewhere has its middle within that
    distance and what a piece reaches, and where that ball leaves the leaf the point asks the leaves it meets, once. A row
    holds one piece, whatever the number of pieces compared.
    """
    spark = points.sparkSession
    long = F.greatest(F.lit(1), F.ceil(geo.haversine(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1")) / piece_m)).cast("int")
    known = shared.stored(segments.select("name", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).dropna(), "segments")
    names = shared.stored(numbered(known.select("name").distinct(), "name"), "names")
    cut = known.join(names, "name").withColumn("n", long).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("n"))
    i = F.col("i")
    ends = {"ax": part("x0", "x1", i), "ay": part("y0", "y1", i), "bx": part("x0", "x1", i + 1), "by": part("y0", "y1", i + 1)}
    pieces = cut.select("number", *[c.alias(n) for n, c in ends.items()]).groupBy(*ends).agg(F.min("number").alias("number"))
    pieces = shared.stored(pieces.select("number", *ends, ((F.col("ax") + F.col("bx")) / 2).alias("lon"), ((F.col("ay") + F.col("by")) / 2).alias("lat")), "pieces")
    kind = dict(points.dtypes)["point"]
    asked = points.select("point", F.col("lon").cast("double"), F.col("lat").cast("double")).filter(placed(F.col("lon"), F.col("lat")))
    n = pieces.count()
    if not n:
        return spark.createDataFrame([], f"point {kind}, lon double, lat double, dist_m double, name {dict(known.dtypes)['name']}")
    some = pieces if n <= SAMPLE else pieces.filter(F.pmod(F.xxhash64("number", "lon", "lat"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n) + 1)
    at = some.select("lon", "lat").toArrow()  # about SAMPLE rows
    tree = Tree(in_space(*_floats(at, "lon", "lat")), max(1, min(n // leaf, len(at) // 8)))

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half, _ = _extent(in_space(*_floats(b, "lon", "lat")), in_space(*_floats(b, "ax", "ay")), in_space(*_floats(b, "bx", "by")))
            yield pa.RecordBatch.from_arrays([pa.array([half.max(initial=0)])], ["half"])

    reach = pieces.mapInArrow(extents, "half double").agg(F.max("half")).collect()[0][0]
    piece_rows = lambda: pieces.mapInArrow(_routed(tree), "number bigint, ax double, ay double, bx double, by double, lon double, lat double, leaf int")
    if tree.leaves > 1:
        counts = np.zeros(tree.leaves, np.int64)
        for r in piece_rows().groupBy("leaf").count().collect():  # one row a leaf
            counts[r["leaf"]] = r["count"]
        tree.pruned(counts, 1)
    point_rows = shared.stored(asked.mapInArrow(_routed(tree), f"point {kind}, lon double, lat double, leaf int"), "points")
    schema = f"point {kind}, lon double, lat double, dist_m double, number bigint"

    def met(asking: DataFrame, home: bool) -> DataFrame:
        salts = asking.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / salt).cast("int").alias("salts"))  # one row a leaf
        spread = asking.join(F.broadcast(salts), "leaf").withColumn("salt", F.pmod(F.xxhash64("point"), F.col("salts")).cast("int")).drop("salts").withColumn("reach", F.lit(reach))
        copies = piece_rows().join(F.broadcast(salts), "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        both = spread.unionByName(copies, allowMissingColumns=True)
        return both.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt").mapInArrow(_to_pieces(tree, home), schema + (", others array<int>" if home else ""))

    best = met(point_rows, True)
    if tree.leaves > 1:
        first = shared.stored(best, "segment")
        open_ = first.filter(F.size("others") > 0)
        again = met(open_.select("point", "lon", "lat", F.explode("others").alias("leaf")), False)
        w = F.min(F.struct("dist_m", "number")).alias("b")
        merged = open_.drop("others").unionByName(again).groupBy("point", "lon", "lat").agg(w).select("point", "lon", "lat", "b.dist_m", "b.number")
        best = first.filter(F.size("others") == 0).drop("others").unionByName(merged)
    return best.join(names, "number").select("point", "lon", "lat", "dist_m", "name")


def nearest_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """points(point, lon, lat) and regions(region, geometry WKB) to point, region, dist_m: 0 for each region that holds
    the point, else the one with the nearest border (ties by the region)."""
    inside = shared.stored(containing_region(points, regions), "inside").withColumn("dist_m", F.lit(0.0))
    outside = points.join(inside.select("point").distinct(), "point", "left_anti")
    edges = regions.select("region", "geometry").filter("region is not null and geometry is not null").mapInArrow(region_borders, "name string, x0 double, y0 double, x1 double, y1 double")
    return inside.unionByName(nearest_segment(outside, edges).select("point", F.col("name").alias("region"), "dist_m"))
