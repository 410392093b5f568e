"""Trips of a person stitched to segments, the links between them, and legs between successive stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo

JOIN_M, JOIN_S, HARD_S = 100.0, 4 * 3600, 8 * 3600


#: Seconds of a chunk of a person's time, and segments of a chunk of their segments.
CHUNK_S, CHUNK_SEGMENTS = 30 * 86_400, 4_096


def beside(df: DataFrame, by: str, at: Column, order: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """Adds the value of the row before (or ahead) in the order of its key. `at` numbers chunks of a key along that order: the
    rows of a chunk are one window, and what lies over its border comes from a table with one row a chunk, so that a key
    with a third of all rows is many tasks."""
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    chunked = df.withColumn("_chunk", at).withColumn("_value", value)
    w = Window.partitionBy(by, "_chunk").orderBy(*order)
    ends = chunked.groupBy(by, "_chunk").agg(edge("_value", F.struct(*order)).alias("_end"))
    near = ends.select(by, "_chunk", step("_end").over(Window.partitionBy(by).orderBy("_chunk")).alias("_border"))
    inner = chunked.withColumn("_near", step("_value").over(w))
    return inner.join(near, [by, "_chunk"], "left").withColumn(name, F.coalesce("_near", "_border")).drop("_chunk", "_value", "_near", "_border")


def running_sum(df: DataFrame, by: str, at: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of the values up to the row, by chunks as in `beside`."""
    chunked = df.withColumn("_chunk", at).withColumn("_value", value)
    w = Window.partitionBy(by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = chunked.groupBy(by, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(by, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = chunked.withColumn("_own", F.sum("_value").over(w))
    return inner.join(base, [by, "_chunk"], "left").withColumn(name, F.col("_base") + F.col("_own")).drop("_chunk", "_value", "_own", "_base")


def tagged(trips: DataFrame, metres: Callable[..., Column] = geo.geodesic, join_m: float = JOIN_M, join_s: int = JOIN_S, hard_s: int = HARD_S) -> DataFrame:
    """trips(person_id, trip_id, start_s, end_s, lon0, lat0, lon1, lat1) with gap_s and dist_m from the trip before, its
    seg_id (from 0, without holes) and the tag of what separates it from the one before: `continue` within join_s and join_m
    (an overlap counts as a gap below 0), else `soft_break` within hard_s and join_m, else `hard_break`; null for the first.

    Order within a person: start, end, trip_id.
    """
    order, month = ["start_s", "end_s", "trip_id"], F.floor(F.col("start_s") / CHUNK_S)
    before = beside(trips, "person_id", month, order, F.struct("end_s", "lon1", "lat1"), "_before")
    before = before.withColumns({"prev_end": F.col("_before.end_s"), "prev_lon": F.col("_before.lon1"), "prev_lat": F.col("_before.lat1")}).drop("_before")
    gap = F.col("start_s") - F.col("prev_end")
    t = before.withColumn("gap_s", gap).withColumn("dist_m", F.when(F.col("prev_end").isNotNull(), metres(F.col("prev_lat"), F.col("prev_lon"), F.col("lat0"), F.col("lon0"))))
    near = F.col("dist_m") <= join_m
    tag = F.when(F.col("gap_s").isNull(), None).when((F.col("gap_s") <= join_s) & near, "continue").when((F.col("gap_s") <= hard_s) & near, "soft_break").otherwise("hard_break")
    t = t.withColumn("tag", tag)
    return running_sum(t, "person_id", month, order, F.coalesce(F.col("tag") != "continue", F.lit(False)).cast("bigint"), "seg_id")


def segments(stitched: DataFrame) -> DataFrame:
    """One row a segment: num_trips, link_count, start and end, the longest, mean and total gap of its links in hours (0
    without links), and what ended it (`final` for a person's last)."""
    linked = F.when(F.col("tag") == "continue", F.col("gap_s") / 3600)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = stitched.groupBy("person_id", "seg_id").agg(
        F.count(F.lit(1)).alias("num_trips"),
        F.count(linked).alias("link_count"),
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        zero(F.max(linked)).alias("max_gap_h"),
        zero(F.avg(linked)).alias("mean_gap_h"),
        zero(F.sum(linked)).alias("total_gap_h"),
        F.min_by("tag", F.struct("start_s", "end_s", "trip_id")).alias("_opened"),
    )
    opened = F.struct(F.col("_opened").alias("tag"))  # never null itself
    s = beside(s, "person_id", F.floor(F.col("seg_id") / CHUNK_SEGMENTS), ["seg_id"], opened, "_next", ahead=True)
    return s.withColumn("ended_by", F.coalesce("_next.tag", F.lit("final"))).drop("_opened", "_next")


def segment_lines(stitched: DataFrame) -> DataFrame:
    """person_id, seg_id, line: the start of the first trip and the ends of all, in order (array<struct<lon, lat>>)."""
    order = F.struct("start_s", "end_s", "trip_id")
    g = stitched.groupBy("person_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")).alias("p")))).alias("ends"), F.min_by(F.struct(F.col("lon0").alias("lon"), F.col("lat0").alias("lat")), order).alias("first"))
    return g.select("person_id", "seg_id", F.concat(F.array("first"), F.transform("ends", lambda x: x["p"])).alias("line"))


def links(stitched: DataFrame) -> DataFrame:
    """One row for each pair of trips joined: link_idx from 0 in its segment, times, gap and distance, both positions."""
    w = Window.partitionBy("person_id", "seg_id").orderBy("start_s", "end_s", "trip_id")
    return stitched.filter("tag = 'continue'").select(
        "person_id",
        "seg_id",
        (F.row_number().over(w) - 1).alias("link_idx"),
        F.col("prev_end").alias("stop_s"),
        F.col("start_s").alias("next_start_s"),
        "gap_s",
        (F.col("gap_s") / 3600).alias("gap_h"),
        "dist_m",
        F.col("prev_lon").alias("lon_a"),
        F.col("prev_lat").alias("lat_a"),
        F.col("lon0").alias("lon_b"),
        F.col("lat0").alias("lat_b"),
    )


def legs(steps: DataFrame, key: str = "person_id", order: str = "step_order", carried: tuple[str, ...] = ("poi", "lon", "lat"), at: Column | None = None) -> DataFrame:
    """Each step with the next of its person as next_...; a person's last step has none and is left out. `at` numbers the
    chunks of a person that are one window; without it the order is a number and CHUNK_SEGMENTS of it are one."""
    here = beside(steps, key, F.floor(F.col(order) / CHUNK_SEGMENTS) if at is None else at, [order], F.struct(*carried, order), "_next", ahead=True)
    return here.withColumns({f"next_{c}": F.col(f"_next.{c}") for c in (*carried, order)}).drop("_next").filter(F.col(f"next_{order}").isNotNull())
