"""The most similar vectors of every vector, by counting collisions on single projections.

Vectors are scaled to length one and projected onto M directions fitted on a bounded sample. Two vectors collide on a
projection if they lie within a window of it; for a radius, the windows are as wide as the sample's similar pairs need.
Queries are taken in small groups that lie close together on all projections, and a group's window on a projection spans
the windows of its queries: vectors that collide with it on at least COLLISIONS of the projections are verified by their
cosine, all others are passed over. The search begins with a small radius and widens its windows (virtual rehashing:
nothing is indexed again) for queries that have not yet k neighbours within the radius.

Distribution. The sorted arrays of the projections are cut jointly into tiles of about TILE vectors, each cut at the
median of the projection on which the sample of its part lies widest. A vector is a candidate in one tile. A query asks its
own tile first; the similarity of the k-th it finds there is the radius with which it then asks the other tiles its
windows on the cut projections meet. So a vector that has found its like travels little, however many tiles there are,
and only one without any like asks widely. A task holds the candidates of one tile and one Arrow batch of the queries that
come to it. Exact copies are folded before and expanded behind the search, so that a group of copies costs one vector however
large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import shared
from trackloom.arrow import grouped

#: Vectors of the sample on which directions, windows and tiles are fitted.
SAMPLE = 20_000
#: Projections, and on how many of them two vectors must collide to be verified.
M, COLLISIONS = 16, 13
#: Share of similar pairs of the sample that a window must hold, and the least a window is, in standard deviations of an
#: equal spread of the difference over all dimensions; and the same for the cut projections, on which every pair must
#: collide for a query to reach a tile.
HELD, LEAST, HELD_CUT, LEAST_CUT = 0.955, 2.0, 0.999, 3.0
#: The first radius, as part of the one that belongs to the least cosine.
FIRST = 0.6
#: Vectors of a tile, and the fewest tiles.
TILE, TILES = 20_000, 12
#: Queries of a group.
Q = 64
#: Cells at most, vectors of the sample that make one, vectors it may hold, queries of a cell at a time.
CELLS, FEW, CELL, ROWS = 2_048, 3, 20_000, 512
#: How far out a cell takes vectors in, as part of the angle of the least cosine; error of an angle from float32.
OUT, SLACK = 1.25, 2e-3


def usable(z: Column, width: int = 64) -> Column:
    """True for a vector of `width` finite components that are not all zero."""
    finite = F.forall(z, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(z) == width) & finite & F.exists(z, lambda x: x != 0), F.lit(False))


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    z = flat.reshape(-1, width).astype(np.float64)
    z = z / np.abs(z).max(1, keepdims=True)
    return z / np.sqrt(np.einsum("ij,ij->i", z, z))[:, None]


class Index:
    """What the sample fits: directions, steps of the rounded projections, windows for a radius of 1, cuts between tiles."""

    def __init__(self, sample: np.ndarray, rows: int, least_cos: float, tiles: int | None = None):
        width = sample.shape[1]
        m = min(M, width)
        values, vectors = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(width))
        self.directions = vectors[:, ::-1][:, :m]
        h = sample @ self.directions
        spread = np.maximum(h.std(0), 1e-6)
        self.middle, self.step = h.mean(0), 3.2 * spread / 63
        self.least = int(np.ceil(COLLISIONS / M * m))
        self.radius = float(np.sqrt(max(2 - 2 * least_cos, 1e-12)))
        some = sample[:4_000]
        cos = some @ some.T
        a, b = np.nonzero(np.triu(cos >= least_cos, 1))
        if len(a) > 200_000:
            keep = np.linspace(0, len(a) - 1, 200_000).astype(int)
            a, b = a[keep], b[keep]
        # without pairs to learn from, differences are taken to lie as the data do; a window never needs to pass the radius
        lie = np.sqrt(np.maximum(np.maximum(values[::-1][:m], 0) / max(values.sum(), 1e-12), 1 / width))
        self.window, self.cut_window = np.minimum(LEAST * lie, 1), np.minimum(LEAST_CUT * lie, 1)
        if len(a) >= 200:
            apart = np.sqrt(np.maximum(2 - 2 * cos[a, b], 1e-12))
            ok = apart > 1e-3
            if ok.sum() >= 200:
                part = np.abs(h[a] - h[b])[ok] / apart[ok, None]
                self.window = np.maximum(self.window, np.quantile(part, HELD, axis=0))
                self.cut_window = np.maximum(self.cut_window, np.quantile(part, HELD_CUT, axis=0))
        self.dim, self.cut, self.left, self.right, self.tile, self.tiles = [], [], [], [], [], 0
        self._cut(h, tiles or max(TILES, -(-rows // TILE)))
        self.dim, self.left, self.right, self.tile = (np.array(x, np.int64) for x in (self.dim, self.left, self.right, self.tile))
        self.cut = np.array(self.cut)

    def _cut(self, h: np.ndarray, n: int) -> int:
        i = len(self.dim)
        for part in (self.dim, self.left, self.right, self.tile):
            part.append(-1)
        self.cut.append(0.0)
        if n > 1 and len(h) > 1:
            d = int(np.argmax(h.std(0) / self.cut_window))
            c = float(np.quantile(h[:, d], (n // 2) / n))
            right = h[:, d] >= c
            if right.any() and not right.all():
                self.dim[i], self.cut[i] = d, c
                self.left[i], self.right[i] = self._cut(h[~right], n // 2), self._cut(h[right], n - n // 2)
                return i
        self.tile[i], self.tiles = self.tiles, self.tiles + 1
        return i

    def project(self, u: np.ndarray) -> np.ndarray:
        return u @ self.directions

    def meets(self, h: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) of the tiles that the windows of the cut projections meet; with a radius of 0 each row's own."""
        row, node = np.arange(len(h)), np.zeros(len(h), np.int64)
        rows, tiles = [row[:0]], [node[:0]]
        while len(row):
            done = self.dim[node] < 0
            rows.append(row[done])
            tiles.append(self.tile[node[done]])
            row, node = row[~done], node[~done]
            d = self.dim[node]
            off, far = h[row, d] - self.cut[node], self.cut_window[d] * radius[row]
            to_left, to_right = (off < 0) | (off < far), (off >= 0) | (off >= -far)
            row, node = np.concatenate([row[to_left], row[to_right]]), np.concatenate([self.left[node[to_left]], self.right[node[to_right]]])
        return np.concatenate(rows), np.concatenate(tiles)

    def rounded(self, h: np.ndarray) -> np.ndarray:
        """To steps in -63..63, so that differences fit a byte; what lies beyond is taken nearer, never farther."""
        return np.clip(np.round((h - self.middle) / self.step), -63, 63).astype(np.int8)

    def steps(self, radius: float) -> np.ndarray:
        return np.minimum(np.ceil(self.window * radius / self.step), 126).astype(np.int16) + 1  # 127: any two collide


class Cells:
    """Groups of like vectors, each around the mean of some of the sample. A vector belongs to the cell of the nearest mean
    within `out` of it, or to none; those of none and of cells too large for a task are loose and searched in tiles.

    By the triangle inequality of angles a query with a radius meets no vector of a cell whose mean is farther than the radius
    and the cell's reach, and none without cell if its own mean is nearer than `out` less the radius.
    """

    def __init__(self, sample: np.ndarray, least_cos: float, tiles: int):
        self.theta = float(np.arccos(np.clip(least_cos, -1, 1)))
        self.out = min(OUT * self.theta, np.pi / 2)
        x = sample.astype(np.float32)
        made, free = [], np.ones(len(x), bool)
        for s in range(0, len(x), 256):
            some = np.arange(s, min(s + 256, len(x)))
            some, rest = some[free[some]], np.flatnonzero(free)
            like = x[some] @ x[rest].T >= least_cos
            for i, row in zip(some, like, strict=True):
                if free[i]:
                    own = rest[row & free[rest]]
                    free[own], free[i] = False, False
                    if len(own) >= FEW:
                        made.append((len(own), x[own].mean(0)))
        made = sorted(made, key=lambda m: -m[0])[:CELLS]
        self.means = np.array([m / np.linalg.norm(m) for _, m in made], np.float32).reshape(-1, x.shape[1])
        self.big = np.zeros(len(self.means), bool)
        cell, angle = self.place(x)
        self.reach = np.full(len(self.means), -np.inf)
        np.maximum.at(self.reach, cell[cell >= 0], angle[cell >= 0])
        if len(self.means) and len(self.meets(x, np.full(len(x), self.theta), cell)[0]) > tiles * len(x):  # cells that part too little
            self.means, self.big, self.reach = self.means[:0], self.big[:0], self.reach[:0]

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, -1 for none, and its angle to the cell's mean."""
        cell, cos = np.full(len(u), -1, np.int64), np.full(len(u), -1, np.float32)
        for s in range(0, len(u) if len(self.means) else 0, 1_024):
            c = u[s : s + 1_024].astype(np.float32) @ self.means.T
            cell[s : s + 1_024], cos[s : s + 1_024] = c.argmax(1), c.max(1)
        angle = np.arccos(np.clip(cos, -1, 1)).astype(np.float64)
        return np.where(angle <= self.out, cell, -1), angle

    def measured(self, sizes: dict[int, tuple[int, float]]) -> None:
        """Takes the number of vectors of each cell and their largest angle."""
        self.reach[:] = -np.inf
        for cell, (n, widest) in sizes.items():
            self.reach[cell], self.big[cell] = widest, n > CELL

    def meets(self, u: np.ndarray, angle: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the other cells that may hold a vector within the angle of each row."""
        rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        limit = self.reach + SLACK
        for s in range(0, len(u) if len(self.means) else 0, 1_024):
            far = np.arccos(np.clip(u[s : s + 1_024].astype(np.float32) @ self.means.T, -1, 1))
            r, c = np.nonzero(far <= limit[None] + angle[s : s + 1_024, None])
            r += s
            rows.append(r[c != own[r]])
            cells.append(c[c != own[r]])
        return np.concatenate(rows), np.concatenate(cells)

    def asks(self, index: Index, u: np.ndarray, h: np.ndarray, radius: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) where else each row's like may lie: tiles of the loose vectors, and behind them cells."""
        angle = 2 * np.arcsin(np.clip(radius / 2, 0, 1))
        at, to = self.meets(u, angle, own)
        wide = own < 0
        wide[at[self.big[to]]] = True
        if len(self.means):
            wide |= self.big[np.maximum(own, 0)]
            a = np.arccos(np.clip(np.einsum("ij,ij->i", u.astype(np.float32), self.means[np.maximum(own, 0)]), -1, 1))
            wide |= a + angle + SLACK >= self.out
        wide = np.flatnonzero(wide)
        row, tile = index.meets(h[wide], radius[wide])
        few = ~self.big[to]
        return np.concatenate([wide[row], at[few]]), np.concatenate([tile, to[few] + index.tiles])


def _raw(u: np.ndarray) -> pa.Array:
    """float32 rows as binary values."""
    u = np.ascontiguousarray(u, np.float32)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * u.shape[1]), len(u), [None, pa.py_buffer(u.tobytes())]).cast(pa.binary())


def _from_raw(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Back from binary values, none of them null."""
    chunks = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    got = []
    for c in chunks:
        if len(c):
            off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            got.append(np.frombuffer(c.buffers()[2], np.float32, (off[-1] - off[0]) // 4, int(off[0])))
    return (np.concatenate(got) if got else np.empty(0, np.float32)).reshape(-1, width)


def _in_cells(cells: Cells, width: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, label, z) to (cell, angle, id, label, u): each vector in its cell, -1 for none."""
        for b in batches:
            if b.num_rows:
                u = unit(b["z"].flatten().to_numpy(zero_copy_only=False), width)
                cell, angle = cells.place(u)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), b["id"], b["label"], _raw(u)], ["cell", "angle", "id", "label", "u"])

    return place


def _placed(index: Index, width: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, id, label, u) to (tile, id, label, u, cell): each vector in its tile."""
        for b in batches:
            if b.num_rows:
                u = _from_raw(b["u"], width)
                row, tile = index.meets(index.project(u), np.zeros(len(u)))
                own = np.empty(len(u), np.int64)
                own[row] = tile
                yield pa.RecordBatch.from_arrays([pa.array(own), b["id"], b["label"], b["u"], b["cell"]], ["tile", "id", "label", "u", "cell"])

    return place


def _best(q: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each query: by cosine to 12 places, then by id."""
    order = np.lexsort((ids, -np.round(cos, 12), q))
    first = np.concatenate([[True], q[order][1:] != q[order][:-1]]) if len(order) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - start < k]


def groups(h: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """rows parted into groups of at most `size` that lie close together: around centres settled by a few rounds, and in
    each from the inner to the outer, so that what lies apart widens few groups."""
    if len(rows) <= size:
        return [rows] if len(rows) else []
    x = h[rows]
    centre = x[:: max(1, size // 2)].copy()
    for last in (False, False, True):
        near, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
        square = (centre**2).sum(1)
        for i in range(0, len(x), 4_096):
            d = square[None] - 2 * x[i : i + 4_096] @ centre.T
            near[i : i + 4_096] = d.argmin(1)
            far[i : i + 4_096] = d.min(1) + (x[i : i + 4_096] ** 2).sum(1)
        if not last:
            n = np.bincount(near, minlength=len(centre))
            for j in range(x.shape[1]):
                centre[:, j] = np.where(n > 0, np.bincount(near, x[:, j], len(centre)) / np.maximum(n, 1), centre[:, j])
    order = np.lexsort((far, near))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(near[order]) != 0]))
    return [rows[order[i : min(i + size, end)]] for at, end in zip(begin, np.append(begin[1:], len(x)), strict=True) for i in range(at, end, size)]


class _Tile:
    """The candidates of a tile, and the search among them."""

    def __init__(self, index: Index, t: pa.Table, width: int, k: int, least_cos: float, apart: bool):
        self.index, self.k, self.least_cos, self.apart = index, k, least_cos, apart
        self.u = _from_raw(t["u"], width)
        self.ids, self.label = t["id"].to_numpy(), t["label"].to_numpy()
        self.h = index.project(self.u).astype(np.float32)
        self.key = np.ascontiguousarray(index.rounded(self.h).T)

    def ask(self, u: np.ndarray, ids: np.ndarray, label: np.ndarray, key: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, cosine) of the best for a group of queries, key: projections x queries."""
        steps = self.index.steps(radius)
        low, high = key.min(1) - steps, key.max(1) + steps  # int16
        missed = np.zeros(len(self.ids), np.int8)
        for i in range(key.shape[0]):
            missed += ((self.key[i] < low[i]) | (self.key[i] > high[i])).view(np.int8)
        near = np.flatnonzero(missed <= key.shape[0] - self.index.least)
        return self.verified(u, ids, label, near)

    def verified(self, u: np.ndarray, ids: np.ndarray, label: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, cosine) of the best among the candidates near, or among all."""
        near = np.arange(len(self.ids)) if near is None else near
        if not len(near):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        c = u @ (self.u if len(near) == len(self.u) else self.u[near]).T
        hit = c >= self.least_cos - 1e-5
        hit &= ids[:, None] != self.ids[near][None, :]
        if self.apart:
            hit &= label[:, None] != self.label[near][None, :]
        # with many, only what can still be among the best, to float error
        n = hit.sum(1)
        many = np.flatnonzero(n > 4 * self.k)
        if len(many):
            part = np.where(hit[many], c[many], -2)
            hit[many] &= c[many] >= np.partition(part, -self.k, axis=1)[:, -self.k, None] - 4e-6
        a, b = np.nonzero(hit)
        b = near[b]
        x, y = u[a].astype(np.float64), self.u[b].astype(np.float64)
        exact = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        ok = exact >= self.least_cos - 1e-7
        a, b, exact = a[ok], b[ok], exact[ok]
        few = _best(a, self.ids[b], exact, self.k)
        return a[few], b[few], exact[few]


def _reached(n: int, k: int, a: np.ndarray, cos: np.ndarray, most: float) -> np.ndarray:
    """The distance of the k-th found of each of n queries, at most `most`; a: the queries, whose best come in order."""
    worst = np.full(n, -2.0)
    last = np.append(np.flatnonzero(np.diff(a)), len(a) - 1) if len(a) else a
    worst[a[last]] = cos[last]
    return np.minimum(np.where(np.bincount(a, minlength=n) >= k, np.sqrt(np.maximum(2 - 2 * worst, 0)), most), most)


def _asking(tile: _Tile, rows: np.ndarray, radius: np.ndarray, r: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    """The queries that go elsewhere: r, their places in rows, and met, where they go."""
    who, n = np.unique(r), np.bincount(r, minlength=len(rows))
    off = pa.array(np.concatenate([[0], np.cumsum(n[who])]).astype(np.int32))
    own, none = rows[who], pa.nulls(len(who), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(tile.ids[own]), none, pa.nulls(len(who), pa.float64()), pa.array(tile.label[own]), _raw(tile.u[own]), pa.ListArray.from_arrays(off, pa.array(met[np.argsort(r, kind="stable")])), pa.array(radius[who])],
        ["id", "other", "cos", "label", "u", "asks", "radius"],
    )


def _at_cell(index: Index, cells: Cells, width: int, k: int, least_cos: float, apart: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells to what `_at_home` gives, every vector compared with all of its cell."""
        for t in grouped(batches, ["tile"]):
            tile = _Tile(index, t, width, k, least_cos, apart)
            own = np.full(len(t), int(t["tile"][0].as_py()) - index.tiles)
            for s in range(0, len(t), ROWS):
                rows = np.arange(s, min(s + ROWS, len(t)))
                a, b, cos = tile.verified(tile.u[rows], tile.ids[rows], tile.label[rows])
                if len(a):
                    yield _found(tile.ids[rows[a]], tile.ids[b], cos)
                radius = _reached(len(rows), k, a, cos, index.radius)
                r, met = cells.asks(index, tile.u[rows], tile.h[rows], radius, own[rows])
                if len(r):
                    yield _asking(tile, rows, radius, r, met)

    return search


def _at_home(index: Index, cells: Cells, width: int, k: int, least_cos: float, apart: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles to (id, other, cos) of the best found at home, and for vectors that must ask elsewhere (id, label, u, asks,
        radius), others null."""
        for t in grouped(batches, ["tile"]):
            tile, own, cell = _Tile(index, t, width, k, least_cos, apart), int(t["tile"][0].as_py()), t["cell"].to_numpy()
            left = np.arange(len(t))
            for part in (FIRST, 1.0):
                again = []
                for rows in groups(tile.h, left, Q):
                    a, b, cos = tile.ask(tile.u[rows], tile.ids[rows], tile.label[rows], tile.key[:, rows], index.radius * part)
                    # the k-th, if it is within the radius that these windows serve
                    reach = 1 - (index.radius * part) ** 2 / 2
                    done = np.bincount(a[cos >= reach], minlength=len(rows)) >= k if part < 1 else np.ones(len(rows), bool)
                    keep = done[a]
                    if keep.any():
                        yield _found(tile.ids[rows[a[keep]]], tile.ids[b[keep]], cos[keep])
                    again.append(rows[~done])
                    radius = _reached(len(rows), k, a, cos, index.radius)[done]
                    settled = rows[done]
                    if not len(settled):
                        continue
                    r, met = cells.asks(index, tile.u[settled], tile.h[settled], radius, cell[settled])
                    r, met = r[met != own], met[met != own]
                    if len(r):
                        yield _asking(tile, settled, radius, r, met)
                left = np.concatenate(again) if again else left[:0]

    return search


def _found(q: np.ndarray, other: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    n = len(q)
    return pa.RecordBatch.from_arrays(
        [pa.array(q), pa.array(other), pa.array(cos), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.float64())], ["id", "other", "cos", "label", "u", "asks", "radius"]
    )


def _elsewhere(index: Index, width: int, k: int, least_cos: float, apart: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates of a tile (radius null) and then, in order of radius, the queries that come to it, an Arrow batch at a
        time, to (id, other, cos)."""
        held: list[pa.Table] = []
        tile, at = None, None
        for b in batches:
            for t in grouped(iter([b]), ["tile"]):
                where = int(t["tile"][0].as_py())
                if where != at:
                    held, tile, at = [], None, where
                is_query = t["radius"].is_valid()
                own, t = t.filter(pc.invert(is_query)), t.filter(is_query)
                if len(own):
                    held.append(own)
                if not len(t) or not held:
                    continue
                tile = tile or _Tile(index, pa.concat_tables(held), width, k, least_cos, apart)
                u, ids, label, radius = _from_raw(t["u"], width), t["id"].to_numpy(), t["label"].to_numpy(), t["radius"].to_numpy()
                if where >= index.tiles:
                    for s in range(0, len(u), ROWS):
                        q, p, cos = tile.verified(u[s : s + ROWS], ids[s : s + ROWS], label[s : s + ROWS])
                        if len(q):
                            yield pa.RecordBatch.from_pydict({"id": ids[s + q], "other": tile.ids[p], "cos": cos})
                    continue
                h = index.project(u).astype(np.float32)
                key = np.ascontiguousarray(index.rounded(h).T)
                level = np.ceil(radius / index.radius * 8).astype(np.int64)
                for one in np.unique(level):
                    for rows in groups(h, np.flatnonzero(level == one), Q):
                        q, p, cos = tile.ask(u[rows], ids[rows], label[rows], key[:, rows], float(radius[rows].max()))
                        if len(q):
                            yield pa.RecordBatch.from_pydict({"id": ids[rows[q]], "other": tile.ids[p], "cos": cos})

    return search


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which each goes to another one of n hash partitions."""
    rows = spark.range(64 * n + 256).select("id", F.pmod(F.hash(F.col("id")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    got = {r["p"]: r["id"] for r in rows}
    return [got.get(i, i) for i in range(n)]


def similar(vectors: DataFrame, k: int, least_cos: float, width: int = 64, apart: bool = False, tiles: int | None = None) -> DataFrame:
    """vectors(id bigint, label bigint, z array<float>), usable and distinct, to id, other, cos: for each its k most similar
    others with at least that cosine (ties to the smaller id); with `apart`, only others of another label.

    Recall depends on COLLISIONS and the windows; it is measured against brute force in the tests.
    """
    spark = vectors.sparkSession
    schema = "id bigint, other bigint, cos double"
    n = vectors.count()
    h = F.xxhash64("id", F.lit(7))
    # about twice the sample, of which it then is the smallest numbers
    some = vectors.select("id", "z") if n <= 2 * SAMPLE else vectors.select("id", "z").filter(F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * 2 * SAMPLE / n) + 1)
    sample = some.orderBy(h).limit(SAMPLE).select("z").toArrow()["z"]
    if not len(sample):
        return spark.createDataFrame([], schema)
    sample = unit(sample.combine_chunks().flatten().to_numpy(zero_copy_only=False), width)
    cells = Cells(sample, least_cos, tiles or max(TILES, -(-n // TILE)))
    every = shared.stored(vectors.select("id", "label", "z").mapInArrow(_in_cells(cells, width), "cell bigint, angle double, id bigint, label bigint, u binary"), "cells")
    sizes = {r["cell"]: (r["n"], r["widest"]) for r in every.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest")).collect()}  # CELLS + 1 rows at most
    cells.measured({c: x for c, x in sizes.items() if c >= 0})
    many = np.flatnonzero(cells.big).tolist()
    index = Index(sample, sum(x[0] for c, x in sizes.items() if c < 0 or c in many), least_cos, tiles)
    keys = F.array(*[F.lit(x).cast("bigint") for x in even_keys(spark, index.tiles)])
    at_tile = lambda df: df.withColumn("key", F.element_at(keys, (F.col("tile") + 1).cast("int"))).repartition(index.tiles, "key").sortWithinPartitions("tile").drop("key")
    parts = max(TILES, -(-n // TILE))
    at_place = lambda df, *order: df.repartition(parts, "tile").sortWithinPartitions("tile", *order)
    is_loose = (F.col("cell") < 0) | F.col("cell").isin(many)
    loose = shared.stored(every.filter(is_loose).select("cell", "id", "label", "u").mapInArrow(_placed(index, width), "tile bigint, id bigint, label bigint, u binary, cell bigint"), "tiles")
    celled = every.filter(~is_loose).select((F.col("cell") + index.tiles).alias("tile"), "id", "label", "u")
    schema_home = "id bigint, other bigint, cos double, label bigint, u binary, asks array<bigint>, radius double"
    home = at_tile(loose).mapInArrow(_at_home(index, cells, width, k, least_cos, apart), schema_home)
    if len(cells.means):
        home = home.unionByName(at_place(celled).mapInArrow(_at_cell(index, cells, width, k, least_cos, apart), schema_home))
    first = shared.stored(home, "home")
    found = first.filter("other is not null").select("id", "other", "cos")
    asking = first.filter("other is null").select(F.explode("asks").alias("tile"), "id", "label", "u", "radius")
    placed = loose.drop("cell").unionByName(celled) if len(cells.means) else loose.drop("cell")
    wanted = [r["tile"] for r in asking.select("tile").distinct().collect()]  # CELLS and the tiles at most
    both = placed.filter(F.col("tile").isin(wanted)).withColumn("radius", F.lit(None).cast("double")).unionByName(asking)
    more = at_place(both, "radius").mapInArrow(_elsewhere(index, width, k, least_cos, apart), schema)
    rank = Window.partitionBy("id").orderBy(F.desc(F.round("cos", 12)), "other")
    return found.unionByName(more).withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= k).drop("_n")


def folded(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vectors(id, z) to the distinct vectors (id: the smallest of its copies, z, copies) and, for those with copies, the
    table (copy, id). Both are stored."""
    distinct = shared.stored(vectors.groupBy("z").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "z", "copies"), "distinct")
    twins = distinct.filter("copies > 1").select("id", "z")
    copies = shared.stored(vectors.select(F.col("id").alias("copy"), "z").join(twins, "z").select("copy", "id"), "copies")
    return distinct, copies


def most_similar(vectors: DataFrame, k: int = 5, least_cos: float = 0.8, width: int = 64) -> DataFrame:
    """vectors(id bigint, z array<float>) to id, other, cos: the k most similar other usable vectors of every usable one
    that reach least_cos; ties go to the smaller id.

    Vectors that are not usable (see `usable`) neither ask nor answer; exact copies answer each other with a cosine of 1.
    """
    rows = vectors.filter(F.col("id").isNotNull() & usable(F.col("z"), width)).select("id", "z")
    distinct, copies = folded(rows)
    found = shared.stored(similar(distinct.withColumn("label", F.col("id")), k, least_cos, width), "similar")
    few = Window.partitionBy("id").orderBy("copy")
    heads = copies.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1).select("id", "copy")  # at most k + 1 of a group
    # what each distinct vector offers: itself and its first copies
    offers = heads.unionByName(distinct.filter("copies = 1").select("id", F.col("id").alias("copy")))
    wanted = found.select("id", F.col("other").alias("o"), "cos").join(offers.select(F.col("id").alias("o"), "copy"), "o").select("id", F.col("copy").alias("other"), "cos")
    wanted = wanted.unionByName(heads.select("id", F.col("copy").alias("other"), F.lit(1.0).alias("cos")))
    rank = Window.partitionBy("id").orderBy(F.desc(F.round("cos", 12)), "other")
    best = wanted.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= k + 1)
    single = best.join(copies.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("asked"), "other", "cos")
    many = best.join(copies, "id").select(F.col("copy").alias("asked"), "other", "cos")
    again = Window.partitionBy("asked").orderBy(F.desc(F.round("cos", 12)), "other")
    out = single.unionByName(many).filter("asked <> other").withColumn("n", F.row_number().over(again)).filter(F.col("n") <= k)
    return out.select(F.col("asked").alias("id"), "other", "cos")
