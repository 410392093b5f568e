"""Convex hulls of any number of points, their offset outward, and lines with fewer vertices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of n x 2 points, counter-clockwise from the leftmost (then lowest), no three in line."""
    p = np.unique(points[np.isfinite(points).all(1)], axis=0)
    if len(p) < 3:
        return p
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sides = []
    for walk in (p, p[::-1]):
        side: list[np.ndarray] = []
        for q in walk:
            while len(side) > 1 and turn(side[-2], side[-1], q) <= 0:
                side.pop()
            side.append(q)
        sides.append(side[:-1])
    return np.array(sides[0] + sides[1])


def convex_hull(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """i, x, y: the hull's corners in order. Every partition sends the corners of its own hull; the hull of those is that of
    all. Rows with a null or NaN are left out; fewer than three distinct points come out as they are."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2))
        for b in batches:
            held = hull(np.vstack([held, np.column_stack([b["x"].to_numpy(zero_copy_only=False).astype(float), b["y"].to_numpy(zero_copy_only=False).astype(float)])]))
        yield pa.RecordBatch.from_pydict({"x": held[:, 0], "y": held[:, 1]})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in corners(batches):
            yield pa.RecordBatch.from_pydict({"i": np.arange(b.num_rows, dtype=np.int32), "x": b["x"], "y": b["y"]})

    clean = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return clean.mapInArrow(corners, "x double, y double").repartition(1).mapInArrow(numbered, "i int, x double, y double")


def offset_hull(corners: np.ndarray, distance: float, steps: int = 8) -> np.ndarray:
    """A convex polygon grown outward by a distance, its rounded corners in `steps` parts of a quarter turn."""
    at = np.linspace(0, 2 * np.pi, 4 * steps, endpoint=False)
    ring = np.column_stack([np.cos(at), np.sin(at)]) * distance
    return hull((corners[:, None] + ring[None]).reshape(-1, 2))


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """The vertices that Douglas and Peucker's rule keeps: none dropped lies farther than the tolerance from what is left."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = line[a], line[b], line[a + 1 : b]
        d = q - p
        n = np.hypot(*d)
        far = np.hypot(*(mid - p).T) if n == 0 else np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / n
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return line[keep]


def simplify(xs: Column, ys: Column, tolerance: float) -> Column:
    """Two array columns of a line to array<struct<lon, lat>> with fewer vertices."""

    @F.pandas_udf("array<struct<lon: double, lat: double>>")
    def cut(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            line = np.column_stack([np.asarray(x, float), np.asarray(y, float)]) if x is not None else np.empty((0, 2))
            out.append([{"lon": float(u), "lat": float(v)} for u, v in (simplified(line, tolerance) if len(line) > 2 else line)])
        return pd.Series(out)

    return cut(xs, ys)
