"""Graphs as edge tables: adjacency of cells, components and their bridging, walks, and shortest paths on a road network.

Loops are rounds of joins, each round a table in the shared folder: lineage stays short and a lost executor costs a round.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import shared
from trackloom.arrow import grouped
from trackloom.functions import geo
from trackloom.functions.columns import mixer
from trackloom.operators.nearest import k_nearest, nearest_segment_at
from trackloom.operators.proximity import region_edges
from trackloom.operators.statistics import mixed_numbers


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with src < dst; loops and nulls go."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()


def queen_contiguity(regions: DataFrame, digits: int = 7) -> DataFrame:
    """regions(region, geometry WKB) to the undirected pairs that share a vertex, compared to so many decimals.

    A vertex belongs to a few regions, so that the join on it stays small; both ends of every edge are vertices, level edges'
    too, since each also ends another edge.
    """
    edges = regions.select("region", "geometry").filter("geometry is not null").mapInArrow(region_edges, "region string, x0 double, y0 double, x1 double, y1 double")
    at = lambda x, y: F.struct(F.round(x, digits).alias("x"), F.round(y, digits).alias("y"))
    v = edges.select("region", F.explode(F.array(at("x0", "y0"), at("x1", "y1"))).alias("v")).distinct()
    return undirected(v.select(F.col("region").alias("src"), "v").join(v.select(F.col("region").alias("dst"), "v"), "v"))


def knn_graph(points: DataFrame, k: int, slack: float = 1.02) -> DataFrame:
    """points(id, lon, lat) to the undirected pairs of the k nearest within slack times the median distance of the k-th, and
    to its nearest for each point left alone by that."""
    near = k_nearest(points.withColumnRenamed("id", "point"), points.withColumnRenamed("id", "place"), k + 1)
    pairs = shared.stored(near.filter("point <> place").withColumn("r", F.row_number().over(Window.partitionBy("point").orderBy("dist_m", "place"))).filter(F.col("r") <= k), "knn")
    limit = pairs.filter(F.col("r") == k).agg((F.percentile("dist_m", F.lit(0.5)) * slack).alias("limit"))
    kept = pairs.join(F.broadcast(limit)).filter(F.col("dist_m") <= F.col("limit"))
    alone = pairs.filter("r = 1").join(kept.select(F.explode(F.array("point", "place")).alias("point")).distinct(), "point", "left_anti")
    return undirected(kept.select(F.col("point").alias("src"), F.col("place").alias("dst")).unionByName(alone.select(F.col("point").alias("src"), F.col("place").alias("dst"))))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree of every node, 0 for one without edges."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(d, "id", "left").fillna(0, ["degree"])


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (the smallest id in it) by taking the least label around and then that label's label."""
    both = shared.stored(edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct(), "edges")
    labels = nodes.select("id", F.col("id").alias("component")).distinct()
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near.select(F.col("src").alias("id"), "near"), "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        top = step.select(F.col("id").alias("at"), F.col("to").alias("component"))
        labels = shared.stored(step.join(top, F.col("to") == F.col("at")).select("id", "component", (F.col("component") < F.col("was")).alias("moved")), "components")
        moved = labels.filter("moved").limit(1).count()
        labels = labels.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def bridged(points: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """edges and, until there is one component, for each but the largest the shortest edge that leaves it: points(id, lon,
    lat). Every round at least halves the number of the smaller components."""
    edges = undirected(edges)
    for _ in range(rounds):
        comp = components(points, edges)
        size = comp.groupBy("component").count()
        main = size.orderBy(F.desc("count"), "component").limit(1).select("component")
        outside = shared.stored(points.join(comp.join(F.broadcast(main), "component", "left_anti"), "id"), "outside")
        if not outside.limit(1).count():
            return edges
        pairs, k = None, 4
        while pairs is None or open_.limit(1).count():  # noqa: F821 - set below
            ask = outside if pairs is None else open_  # noqa: F821
            near = k_nearest(ask.select(F.col("id").alias("point"), "lon", "lat"), points.withColumnRenamed("id", "place"), k)
            own = near.join(comp.select(F.col("id").alias("point"), F.col("component").alias("c0")), "point").join(comp.select(F.col("id").alias("place"), F.col("component").alias("c1")), "place").filter("c0 <> c1")
            found = shared.stored(own.groupBy("c0").agg(F.min(F.struct("dist_m", "point", "place")).alias("e")), "bridges")
            pairs = found if pairs is None else pairs.unionByName(found)
            # a component all of whose points saw only itself asks for more
            open_ = shared.stored(outside.join(pairs.select(F.col("c0").alias("component")), "component", "left_anti"), "open")
            k *= 8
        edges = shared.stored(undirected(edges.unionByName(pairs.select(F.col("e.point").alias("src"), F.col("e.place").alias("dst")))), "edges")
    return edges


def best_edges(edges: DataFrame) -> DataFrame:
    """edges(u, v, k, travel_time, ...) with one edge for each (u, v): the fastest, ties to the smaller k; those without a
    travel time go."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.filter("travel_time is not null").groupBy("u", "v").agg(F.min_by(F.struct(*rest), F.struct("travel_time", "k")).alias("e")).select("u", "v", "e.*")


def with_travel_time(edges: DataFrame, default_kmh: float = 40.0) -> DataFrame:
    """edges(length, speed_kmh): a missing speed is the mean of its kind (`highway`), then the default; travel_time in s."""
    w = Window.partitionBy("highway")
    speed = F.coalesce("speed_kmh", F.avg("speed_kmh").over(w), F.lit(default_kmh))
    return edges.withColumn("speed_kmh", speed).withColumn("travel_time", F.col("length") / (F.col("speed_kmh") / 3.6))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids of the largest weakly connected component, ties to the one of the smaller id."""
    comp = components(nodes, edges)
    top = comp.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return comp.join(F.broadcast(top.select("component")), "component", "left_semi").select("id")


def snapped(points: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """points(point, lon, lat) and nodes(id, lon, lat) to point, node, dist_m: the nearest node of each point; with edges(u, v),
    the nearer end of its nearest edge (ties to the smaller ids), and the distance to that end."""
    if edges is None:
        return k_nearest(points, nodes.withColumnRenamed("id", "place"), 1).select("point", F.col("place").alias("node"), "dist_m")
    end = lambda k: nodes.select(F.col("id").alias(k), F.col("lon").alias(f"x{k}"), F.col("lat").alias(f"y{k}"))
    wired = shared.stored(undirected(edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))).select(F.col("src").alias("u"), F.col("dst").alias("v")).join(end("u"), "u").join(end("v"), "v"), "wired")
    name = F.struct("u", "v")
    near = nearest_segment_at(points, wired.select(name.alias("name"), F.col("xu").alias("x0"), F.col("yu").alias("y0"), F.col("xv").alias("x1"), F.col("yv").alias("y1")))
    both = near.select("point", "lon", "lat", "name.u", "name.v").join(wired, ["u", "v"])
    to = lambda k: F.struct(F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col(f"y{k}"), F.col(f"x{k}")), 3).alias("dist_m"), F.col(k).alias("node"))
    return both.select("point", F.least(to("u"), to("v")).alias("e")).select("point", "e.node", "e.dist_m")


def _dijkstra(first: np.ndarray, to: np.ndarray, cost: np.ndarray, source: int, goals: set[int]) -> tuple[dict[int, float], dict[int, int]]:
    best, before, done, left = {source: 0.0}, {}, set(), set(goals)
    queue = [(0.0, source)]
    while queue and left:
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        left.discard(u)
        for i in range(first[u], first[u + 1]):
            v, e = int(to[i]), d + float(cost[i])
            if e < best.get(v, np.inf):
                best[v], before[v] = e, u
                heapq.heappush(queue, (e, v))
    return {g: best[g] for g in goals if g in done}, before


#: Edges of a network that may be broadcast to the path search (as three arrays, about 20 bytes each).
MAX_EDGES = 20_000_000


def shortest_paths(edges: DataFrame, legs: DataFrame) -> DataFrame:
    """edges(u, v, travel_time) and legs(leg, origin, dest) to leg, travel_s, path (array of nodes): one search for each
    origin serves all its legs; a leg without a path gives no row, one from a node to itself a path of that node.

    The network is packed to arrays and broadcast if it has at most MAX_EDGES edges, which is checked; larger ones go by
    `frontier_paths`, with the same result but for paths of equal time. Legs are what grows, and they stay distributed.
    """
    spark = edges.sparkSession
    n = edges.count()
    if n > MAX_EDGES:
        return frontier_paths(edges, legs)
    e = edges.select("u", "v", "travel_time").toPandas()
    names, code = np.unique(np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()]), return_inverse=True)
    u, v = code[: len(e)], code[len(e) :]
    order = np.argsort(u, kind="stable")
    first = np.searchsorted(u[order], np.arange(len(names) + 1))
    net = spark.sparkContext.broadcast((names, first, v[order], e["travel_time"].to_numpy(float)[order]))

    def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, first, to, cost = net.value
        for part in rows:
            out = []
            for origin, own in part.groupby("origin"):
                at = int(np.searchsorted(names, origin))
                if at == len(names) or names[at] != origin:
                    continue
                goal = np.searchsorted(names, own["dest"].to_numpy())
                ok = (goal < len(names)) & (names[np.minimum(goal, len(names) - 1)] == own["dest"].to_numpy())
                dist, before = _dijkstra(first, to, cost, at, set(goal[ok].tolist()))
                for leg, g in zip(own["leg"].to_numpy()[ok], goal[ok].tolist(), strict=True):
                    if g in dist:
                        path = [g]
                        while path[-1] != at:
                            path.append(before[path[-1]])
                        out.append((leg, dist[g], [names[x] for x in reversed(path)]))
            yield pd.DataFrame(out, columns=["leg", "travel_s", "path"])

    kinds = dict(edges.dtypes)
    asked = legs.select("leg", "origin", "dest").repartition("origin").sortWithinPartitions("origin")
    return asked.mapInPandas(search, f"leg {dict(legs.dtypes)['leg']}, travel_s double, path array<{kinds['u']}>")


def frontier_distances(edges: DataFrame, origins: DataFrame, rounds: int = 200) -> DataFrame:
    """edges(u, v, travel_time) and origins(origin) to origin, node, travel_s: rounds in which improved nodes offer their
    edges, without anything broadcast, for networks of any size."""
    dist = origins.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("travel_s")).distinct()
    front = dist
    for _ in range(rounds):
        offer = front.join(edges.select(F.col("u").alias("node"), "v", "travel_time"), "node").groupBy("origin", F.col("v").alias("node")).agg(F.min(F.col("travel_s") + F.col("travel_time")).alias("new"))
        full = shared.stored(dist.join(offer, ["origin", "node"], "full").select("origin", "node", F.least("travel_s", "new").alias("travel_s"), (F.col("travel_s").isNull() | (F.col("new") < F.col("travel_s"))).alias("better")), "distances")
        dist, front = full.drop("better"), full.filter("better").drop("better")
        if not front.limit(1).count():
            return dist
    raise RuntimeError(f"distances did not settle in {rounds} rounds")


def frontier_paths(edges: DataFrame, legs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """As `shortest_paths`, without anything broadcast: distances by rounds in which improved nodes offer their edges and are
    remembered as where the best offer came from, then the paths by walking back, an edge a round."""
    known = edges.select(F.explode(F.array("u", "v")).alias("origin")).distinct()
    asked = shared.stored(legs.select("leg", "origin", "dest").join(known, "origin", "left_semi"), "legs")
    own = edges.select("u", "v", "travel_time").filter("travel_time is not null")
    none = F.lit(None).cast(dict(edges.dtypes)["u"])
    best = asked.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("d"), none.alias("before")).distinct()
    front = best
    for _ in range(rounds):
        offer = front.join(own.withColumnRenamed("u", "node"), "node").groupBy("origin", F.col("v").alias("node")).agg(F.min(F.struct((F.col("d") + F.col("travel_time")).alias("d"), F.col("node").alias("before"))).alias("o"))
        full = best.join(offer, ["origin", "node"], "full")
        better = F.col("o.d").isNotNull() & (F.col("d").isNull() | (F.col("o.d") < F.col("d")))
        kept = shared.stored(full.select("origin", "node", F.when(better, F.col("o.d")).otherwise(F.col("d")).alias("d"), F.when(better, F.col("o.before")).otherwise(F.col("before")).alias("before"), F.coalesce(better, F.lit(False)).alias("better")), "frontier")
        best, front = kept.drop("better"), kept.filter("better").drop("better")
        if not front.limit(1).count():
            break
    else:
        raise RuntimeError(f"distances did not settle in {rounds} rounds")
    back = best.select("origin", F.col("node").alias("at"), "before")
    walk = asked.join(best.select("origin", F.col("node").alias("dest"), F.col("d").alias("travel_s")), ["origin", "dest"]).select("leg", "origin", F.col("dest").alias("at"), "travel_s", F.array("dest").alias("path"))
    done = None
    for i in range(rounds):
        whole = walk.filter("at = origin").select("leg", "travel_s", "path")
        done = whole if done is None else done.unionByName(whole)
        on = walk.filter("at <> origin").join(back, ["origin", "at"])
        walk = shared.stored(on.select("leg", "origin", F.col("before").alias("at"), "travel_s", F.concat(F.array("before"), "path").alias("path")), "walk")
        if not walk.limit(1).count():
            return done
        if i % 16 == 15:
            done = shared.stored(done, "paths")
    raise RuntimeError(f"paths of more than {rounds} edges")


def path_stats(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths(leg, path) over edges(u, v, travel_time, length): leg, edges, travel_s, length_m."""
    steps = paths.select("leg", F.posexplode("path").alias("i", "u"), "path").withColumn("v", F.get("path", F.col("i") + 1)).filter("v is not null").select("leg", "u", "v")
    s = steps.join(edges.select("u", "v", "travel_time", "length"), ["u", "v"]).groupBy("leg").agg(F.count(F.lit(1)).alias("edges"), F.sum("travel_time").alias("travel_s"), F.sum("length").alias("length_m"))
    return paths.select("leg").join(s, "leg", "left").fillna(0)


#: Nodes whose index a task may hold (some 50 bytes each).
WALKED = 5_000_000
#: Ends of edges that are combined at a time, and that a file of lists holds about.
ENDS = 2_000_000


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _ends_by_node(kind: str):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges to src and, as bytes, its neighbours among the edges held, both ways."""

        def work(src: np.ndarray, dst: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = np.concatenate([src, dst]), np.concatenate([dst, src]).astype(kind)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            off = np.append(_runs(a), len(a))
            for s in range(0, len(off) - 1, 10_000):
                e = min(s + 10_000, len(off) - 1)
                where = ((off[s : e + 1] - off[s]) * b.itemsize).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(where.tobytes()), pa.py_buffer(b[off[s] : off[e]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(a[off[s:e]]), lists], ["src", "ends"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch["src"].to_numpy(), batch["dst"].to_numpy()))
            rows += batch.num_rows
            if rows >= ENDS // 2:
                yield from work(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
        if rows:
            yield from work(*map(np.concatenate, zip(*held, strict=True)))

    return combine


def _neighbour_lists(kind: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (src, ends) in the order of src: the distinct neighbours in order go to a file of this attempt, and a row
        says of each src how many there are and where."""
        name = f"{path}/{uuid.uuid4().hex}"
        at = 0
        with open(name, "wb") as out:
            for t in grouped(batches, ["src"]):
                ends = np.unique(np.frombuffer(b"".join(t["ends"].to_pylist()), kind))
                out.write(ends.tobytes())
                yield pa.RecordBatch.from_arrays([t["src"].combine_chunks().slice(0, 1), *(pa.array([x]) for x in (len(ends), name, at))], ["node", "n", "part", "at"])
                at += len(ends)

    return write


def _walked(index: str, kind: str, length: int, seed: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, walk, x) to whole walks; lists are mapped, not read, and the index of the nodes is held."""
        t = pq.read_table(index).sort_by("node").combine_chunks()
        node, n, at = (t[c].to_numpy() for c in ("node", "n", "at"))
        names = pa.array(t["part"].to_pylist()).dictionary_encode()
        part, lists = names.indices.to_numpy(), [np.memmap(x, kind, "r") for x in names.dictionary.to_pylist()]
        for b in batches:
            if not b.num_rows:
                continue
            path = np.empty((b.num_rows, length), np.int64)
            path[:, 0], x = b["node"].to_numpy(), b["x"].to_numpy()
            for step in range(1, length):
                here = np.searchsorted(node, path[:, step - 1])
                to = at[here] + mixed_numbers(x + step * 7919, seed) % n[here]
                order = np.argsort(part[here], kind="stable")
                for rows in np.split(order, _runs(part[here][order])[1:]):
                    path[rows, step] = lists[part[here[rows[0]]]][to[rows]]
            off = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * length)
            yield pa.RecordBatch.from_arrays([b["node"], b["walk"], pa.ListArray.from_arrays(off, pa.array(path.ravel()))], ["node", "walk", "path"])

    return walk


def random_walks(edges: DataFrame, walks: int, length: int, seed: int = 1) -> DataFrame:
    """node, walk, path: uniform walks from every node; at each step a mixed number picks one of the neighbours in order.

    The neighbours' lists are files in the shared folder, which tasks map into memory, so that a walk goes to its end in one
    task and nothing moves from step to step. Keys that are no integers, a shared folder that is not mounted as files, and
    more nodes than a task's index may hold (WALKED) go by joins.
    """
    spark = edges.sparkSession
    kinds = dict(edges.dtypes)
    folder = urlparse(shared.scratch(spark, "lists"))
    whole = {kinds["src"], kinds["dst"]} <= {"tinyint", "smallint", "int", "bigint"}
    pairs = edges.dropna(subset=["src", "dst"])
    if not whole or folder.scheme not in ("", "file"):
        return joined_walks(pairs, walks, length, seed)
    long = pairs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    low, high, n = long.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst")), F.count(F.lit(1))).collect()[0]
    if not n:
        return joined_walks(pairs, walks, length, seed)
    kind = "int32" if -(2**31) <= low and high < 2**31 else "int64"
    os.makedirs(folder.path)
    cores = spark.sparkContext.defaultParallelism
    ends = long.mapInArrow(_ends_by_node(kind), "src bigint, ends binary").repartition(max(cores, -(-2 * n // ENDS)), "src").sortWithinPartitions("src")
    index = shared.stored(ends.mapInArrow(_neighbour_lists(kind, folder.path), "node bigint, n bigint, part string, at bigint"), "index")
    nodes = index.count()
    if nodes > WALKED:
        return joined_walks(pairs, walks, length, seed)
    of_kind = F.col("node").cast(kinds["src"])
    start = index.select("node", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")).withColumn("x", F.xxhash64(of_kind, "walk") % 1_000_003 + F.col("walk"))
    begun = start.repartition(max(cores, -(-nodes * walks // 50_000)))
    at = urlparse(index.inputFiles()[0]).path.rpartition("/")[0]
    done = begun.mapInArrow(_walked(at, kind, length, seed), "node bigint, walk int, path array<bigint>")
    return done.select(of_kind.alias("node"), "walk", F.col("path").cast(f"array<{kinds['src']}>").alias("path"))


def joined_walks(edges: DataFrame, walks: int, length: int, seed: int = 1) -> DataFrame:
    """random_walks by rounds: each step is one join with the neighbours in order."""
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()
    w = Window.partitionBy("src")
    ranked = shared.stored(both.select("src", "dst", (F.row_number().over(w.orderBy("dst")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n")), "neighbours")
    count = ranked.select("src", "n").distinct()
    state = count.select(F.col("src").alias("node"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")).withColumns({"at": F.col("node"), "path": F.array("node")})
    for step in range(1, length):
        pick = mixer(F.xxhash64("node", "walk") % 1_000_003 + step * 7919 + F.col("walk"), seed)
        drawn = state.join(count.withColumnRenamed("src", "at"), "at").withColumn("i", (pick % F.col("n")).cast("int"))
        state = drawn.drop("n").join(ranked.select(F.col("src").alias("at"), "i", "dst"), ["at", "i"]).select("node", "walk", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        if step % 8 == 0:
            state = shared.stored(state, "walks")
    return state.drop("at")


def node_vectors(walks: DataFrame, width: int = 64, window: int = 16, min_count: int = 3, seed: int = 1) -> DataFrame:
    """node, vector: skip-gram vectors of the nodes, their walks as sentences."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    text = walks.select(F.transform("path", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=width, windowSize=window, minCount=min_count, seed=seed, inputCol="words", outputCol="v").fit(text)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vector"))


def grid_network(nodes_side: int, spark, step_m: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """A road network to test with: nodes(id, lon, lat) on a square grid and edges both ways with length and speed."""
    n = nodes_side
    nodes = spark.range(n * n).select("id", (-80 + (F.col("id") % n) * 0.001).alias("lon"), (26 + F.floor(F.col("id") / n) * 0.001).alias("lat"))
    right, up = F.when(F.col("id") % n < n - 1, F.col("id") + 1), F.when(F.col("id") < n * (n - 1), F.col("id") + n)
    one = nodes.select(F.col("id").alias("u"), F.explode(F.filter(F.array(right, up), lambda x: x.isNotNull())).alias("v"))
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
    speed = 20 + (F.col("u") * 7 + F.col("v") * 13) % 60
    return nodes, both.select("u", "v", F.lit(0).alias("k"), F.lit(step_m).alias("length"), speed.cast("double").alias("speed_kmh"), F.lit("road").alias("highway"))


