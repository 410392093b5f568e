"""Overlapping, nested and gapped intervals made into continuous periods and the gaps between them.

Whole seconds become integer cells (2s for the instant s, 2s + 1 for the open second behind it), so that intervals that
touch share a cell and an interval of no length is one cell. Every interval is cut at the borders of chunks of 2^LEVELS
cells and decomposed there into canonical dyadic blocks; blocks below an ancestor that is present go, sibling pairs merge
upward, and blocks side by side coalesce into runs. This runs once before the shuffle (a combiner: a hot entity sends
its runs, not its rows) and once behind it, by entity and chunk, so that a hot entity is spread over its chunks. A chunk
has at most 2^LEVELS / 2 runs. Runs at the edge of a chunk are then joined over the borders: two rows for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import shared

#: A chunk is 2^19 cells, about three days.
LEVELS = 19
#: Rows gathered before the combiner works on them.
COMBINE_ROWS = 200_000


def dyadic_runs(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, non-adjacent runs (group, lo, hi), sorted, of the cells covered by half-open [lo, hi) in 0..2^levels."""
    side = 1 << levels
    starts, sizes = [], []
    for k in range(levels + 1):  # the canonical blocks of each interval
        left, right = -(-lo >> k), hi >> k
        open_ = left < right
        base = group * (side + 1)  # a cell between groups, so that no run crosses
        a = open_ & (left & 1 == 1)
        b = open_ & (right & 1 == 1)
        starts += [base[a] + (left[a] << k), base[b] + ((right[b] - 1) << k)]
        sizes += [np.full(a.sum(), k), np.full(b.sum(), k)]
    start, level = np.concatenate(starts), np.concatenate(sizes)
    order = np.lexsort((-level, start))
    start, level = start[order], level[order]
    reach = np.maximum.accumulate(start + (1 << level)) if len(start) else start
    free = np.ones(len(start), bool)
    free[1:] = reach[:-1] < (start + (1 << level))[1:]  # not below an ancestor, nor a copy
    start, level = start[free], level[free]
    blocks, rest = [], np.empty(0, np.int64)
    for k in range(levels):  # sibling pairs upward
        here = np.sort(np.concatenate([start[level == k], rest]))
        offset = (here % (side + 1)) >> k
        pair = np.zeros(len(here), bool)
        if len(here) > 1:
            pair[:-1] = (here[1:] == here[:-1] + (1 << k)) & (offset[:-1] & 1 == 0)
        second = np.roll(pair, 1) if len(here) else pair
        rest = here[pair]
        alone = here[~(pair | second)]
        blocks.append((alone, np.full(len(alone), k)))
    top = np.concatenate([start[level == levels], rest])
    blocks.append((top, np.full(len(top), levels)))
    start = np.concatenate([b[0] for b in blocks])
    level = np.concatenate([b[1] for b in blocks])
    order = np.argsort(start)
    start, end = start[order], (start + (1 << level))[order]
    if not len(start):
        return start, start, start
    first = np.concatenate([[True], start[1:] != end[:-1]])
    last = np.concatenate([first[1:], [True]])
    g = start[first] // (side + 1)
    return g, start[first] - g * (side + 1), end[last] - g * (side + 1)


def _groups(key: pa.ChunkedArray, chunk: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """A dense number for each pair of key and chunk; the keys, and each group's key number and chunk."""
    coded = key.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    low = chunk.min()
    width = int(chunk.max() - low) + 1
    there, group = np.unique(codes * width + (chunk - low), return_inverse=True)
    return group.astype(np.int64), coded.dictionary, there // width, there % width + low


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, start_s, end_s) to (entity, chunk, lo, hi)."""

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        lo, hi = t["start_s"].to_numpy() * 2, t["end_s"].to_numpy() * 2 + 1
        c0, c1 = lo >> LEVELS, (hi - 1) >> LEVELS
        times = c1 - c0 + 1
        part = (np.cumsum(times) - times) // COMBINE_ROWS  # long intervals have many chunks
        for s in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(part)) + 1):
            row = np.repeat(s, times[s])
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(times[s]) - times[s], times[s]) + c0[row]
            base = chunk << LEVELS
            group, names, name, at = _groups(t["entity"].take(pa.array(row)), chunk)
            g, a, b = dyadic_runs(group, np.maximum(lo[row] - base, 0), np.minimum(hi[row] - base, 1 << LEVELS))
            yield from pa.table({"entity": names.take(pa.array(name[g])), "chunk": at[g], "lo": a, "hi": b}).to_batches(max_chunksize=50_000)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= COMBINE_ROWS:
            yield from work(held)
            held = []
    if held:
        yield from work(held)


def _merged(t: pa.Table) -> pa.Table:
    """The runs of each entity and chunk in place of its rows; all rows are of one `_group`."""
    group, names, name, at = _groups(t["entity"], t["chunk"].to_numpy())
    g, a, b = dyadic_runs(group, t["lo"].to_numpy(), t["hi"].to_numpy())
    return pa.table({"entity": names.take(pa.array(name[g])), "chunk": at[g], "lo": a, "hi": b, "_group": np.full(len(g), t["_group"][0].as_py())}, schema=t.schema)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of `_group` as tables of about COMBINE_ROWS that cut no group; a group with more rows than that is
    merged as it comes, so that a task holds no more than the runs of a chunk and COMBINE_ROWS."""
    held: list[pa.RecordBatch] = []
    rows, most = 0, COMBINE_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held)
            group = t["_group"].to_numpy()
            cut = len(group) - int(np.argmax(group[::-1] != group[-1])) if group[0] != group[-1] else 0
            if cut:
                yield t.slice(0, cut)
            t = t.slice(cut)
            if len(t) >= COMBINE_ROWS // 2:
                t = _merged(t)
            held, rows = t.to_batches(), len(t)
            most = rows + COMBINE_ROWS
    if held:
        yield pa.Table.from_batches(held)


def _finish(max_gap: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(entity, chunk, lo, hi) in the order of `_group` to inner periods and gaps, and the edge runs of each chunk."""
        for t in _whole_groups(batches):
            yield from inner(t)

    def inner(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group, names, name, at = _groups(t["entity"], t["chunk"].to_numpy())
        g, a, b = dyadic_runs(group, t["lo"].to_numpy(), t["hi"].to_numpy())
        base = at[g] << LEVELS
        a, b = a + base, b + base
        first = np.concatenate([[True], g[1:] != g[:-1]])
        last = np.concatenate([first[1:], [True]])
        edge = first | last
        hole = np.flatnonzero(~last)
        hole = hole[(a[hole + 1] - (b[hole] - 1)) // 2 <= max_gap]
        parts = [
            ("period", np.flatnonzero(~edge), a[~edge] // 2, (b[~edge] - 1) // 2),
            ("gap", hole, (b[hole] - 1) // 2, a[hole + 1] // 2),
            ("edge", np.flatnonzero(edge), a[edge], b[edge]),
        ]
        for kind, i, x, y in parts:
            if len(i):
                yield from pa.table({"entity": names.take(pa.array(name[g[i]])), "kind": pa.array([kind]).take(pa.array(np.zeros(len(i), np.int32))), "from_s": x, "to_s": y, "chunk": at[g[i]]}).to_batches(max_chunksize=50_000)

    return finish


def periods_and_gaps(intervals: DataFrame, max_gap: int) -> DataFrame:
    """intervals(entity, start_s, end_s) to entity, kind (`period` or `gap`), from_s, to_s.

    Periods are the longest spans covered by intervals (closed at both ends, so that touching ones belong together); gaps
    are the holes of at most max_gap seconds between two successive periods of an entity. Left out: rows with a null, or
    that end before they start. Repeated rows change nothing; an empty input gives no rows.
    """
    clean = intervals.select("entity", F.col("start_s").cast("bigint"), F.col("end_s").cast("bigint")).filter("entity is not null and start_s is not null and end_s >= start_s")
    runs = clean.mapInArrow(_combine, "entity string, chunk bigint, lo bigint, hi bigint")
    parts = shared.stored(runs.withColumn("_group", F.xxhash64("entity", "chunk")).repartition("entity", "chunk").sortWithinPartitions("_group").mapInArrow(_finish(max_gap), "entity string, kind string, from_s bigint, to_s bigint, chunk bigint"), "periods", ["kind"])
    inner = parts.filter("kind <> 'edge'").select("entity", "kind", "from_s", "to_s")
    w = Window.partitionBy("entity").orderBy("from_s", "to_s")
    edges = parts.filter("kind = 'edge'").withColumn("_new", F.coalesce((F.lag("to_s").over(w) < F.col("from_s")).cast("int"), F.lit(1)))
    joined = (
        edges.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("entity", "_run")
        .agg(F.min("from_s").alias("a"), F.max("to_s").alias("b"), F.min("chunk").alias("c0"), F.max("chunk").alias("c1"))
    )
    v = Window.partitionBy("entity").orderBy("_run")
    spans = joined.select("entity", (F.col("a") / 2).cast("bigint").alias("from_s"), ((F.col("b") - 1) / 2).cast("bigint").alias("to_s"), "c0", F.lag("c1").over(v).alias("c_before"), F.lag("b").over(v).alias("b_before"))
    before = ((F.col("b_before") - 1) / 2).cast("bigint")
    # holes inside one chunk are there already
    outer = spans.select(
        "entity",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("from_s"), F.col("to_s")),
                    F.when(F.col("c_before").isNotNull() & (F.col("c_before") < F.col("c0")) & (F.col("from_s") - before <= max_gap), F.struct(F.lit("gap").alias("kind"), before.alias("from_s"), F.col("from_s").alias("to_s"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("x"),
    )
    return inner.unionByName(outer.select("entity", "x.kind", "x.from_s", "x.to_s"))
