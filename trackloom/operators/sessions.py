"""Sessions of activity, kept in a table that takes batches as they arrive.

A session of a key ends where the next interval starts more than `gap` seconds after the latest end so far. Intervals
whose starts lie in one slot of width `gap` (floor(start / gap)) always share a session, since no start in the slot can
be more than `gap` after another; so rows are first folded to one per key and slot by a hash aggregate with map-side
combine. A key then has at most (span / gap) slots, however many rows it has: a key that holds a third of all rows costs
its rows in the combine only, and the window behind it sees a bounded group.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import shared

SCHEMA = "key string, session_start bigint, session_end bigint, n_events bigint"


def _islands(spans: DataFrame, gap: int, *sums: str) -> DataFrame:
    """spans(key, session_start, session_end, ...) merged where one starts at most gap after the latest end before it."""
    w = Window.partitionBy("key").orderBy("session_start", "session_end")
    before = F.max("session_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("session_start") - before > gap).cast("int"), F.lit(1)))
    return (
        marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "_island")
        .agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), *[F.sum(s).alias(s) for s in sums])
        .drop("_island")
    )


def sessionize(events: DataFrame, gap: int) -> DataFrame:
    """events(key, start_s, end_s) to sessions: key, session_start, session_end, n_events.

    Rows without key, start or end are left out; an empty input gives no rows; repeated rows count again in n_events.
    """
    spans = (
        events.filter("key is not null and start_s is not null and end_s is not null")
        .withColumn("_slot", F.floor(F.col("start_s") / F.lit(gap)) if gap > 0 else F.col("start_s"))
        .groupBy("key", "_slot")
        .agg(F.min("start_s").alias("session_start"), F.max("end_s").alias("session_end"), F.count(F.lit(1)).alias("n_events"))
        .drop("_slot")
    )
    return _islands(spans, gap, "n_events")


class SessionTable:
    """Sessions stored by the unit (a span of time) in which they start, each unit in a folder of its own version.

    A batch is made into local sessions, merged with the stored sessions of every unit within `gap` of them, bridged
    sessions becoming one; the rows of the units touched are written as a new version and put in place of the old ones by
    renaming one small manifest: a reader has all rows from before the batch or all from after it. Units not touched keep
    their files. A batch that fails leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, gap: int, unit: int = 28 * 86400, once_by_id: bool = False):
        self.spark, self.path, self.gap, self.unit, self.once_by_id = spark, path, gap, unit, once_by_id

    def manifest(self) -> dict:
        text = shared.read_text(self.spark, f"{self.path}/manifest.json")
        return json.loads(text) if text else {"version": 0, "units": {}, "ids": []}

    def _read(self, units: dict) -> DataFrame:
        if not units:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{x['dir']}" for x in units.values()])

    def sessions(self) -> DataFrame:
        return self._read(self.manifest()["units"])

    def merge(self, events: DataFrame, batch: int | None = None) -> None:
        """Takes a batch of events(key, start_s, end_s and, with once_by_id, id).

        A batch that has a number is taken once: one no larger than the last taken is passed over. If another writer has been
        in between, the manifest is left alone and the batch fails.

        once_by_id: an id that an earlier batch or row had is not counted again; rows without an id all count.
        """
        held = self.manifest()
        if batch is not None and batch <= held.get("batch", -1):
            return
        version, ids = held["version"] + 1, list(held["ids"])
        own = f"{version}-{uuid.uuid4().hex[:8]}"
        if self.once_by_id:
            named, rest = events.filter("id is not null").dropDuplicates(["id"]), events.filter("id is null")
            if ids:
                named = named.join(self.spark.read.schema("id bigint").parquet(*[f"{self.path}/{x}" for x in ids]), "id", "left_anti")
            fresh = shared.stored(named.select("key", "start_s", "end_s", "id"), "fresh")
            fresh.select("id").write.mode("overwrite").parquet(f"{self.path}/ids-{own}")
            ids.append(f"ids-{own}")
            events = fresh.unionByName(rest.select("key", "start_s", "end_s", "id"))
        unit_of = F.floor(F.col("session_start") / F.lit(self.unit)).alias("unit")
        local = shared.stored(sessionize(events, self.gap), "local")
        # one row per unit of time: their number depends on the calendar, not on the data's size
        spans = local.groupBy(unit_of).agg(F.min("session_start").alias("lo"), F.max("session_end").alias("hi")).collect()
        done = {"version": version, "units": held["units"], "ids": ids, "batch": held.get("batch", -1) if batch is None else batch}
        if not spans:
            if batch is not None or self.once_by_id:
                self._publish(held, done)
            return
        near = {u: x for u, x in held["units"].items() if any(int(u) == s["unit"] or x["lo"] - self.gap <= s["hi"] and s["lo"] <= x["hi"] + self.gap for s in spans)}
        merged = _islands(local.unionByName(self._read(near)), self.gap, "n_events") if near else local
        folder = f"v{own}"
        merged.select("*", unit_of).write.mode("overwrite").partitionBy("unit").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(SCHEMA + ", unit bigint").parquet(f"{self.path}/{folder}")
        now = written.groupBy("unit").agg(F.min("session_start").alias("lo"), F.max("session_end").alias("hi")).collect()
        units = {u: x for u, x in held["units"].items() if u not in near}
        units |= {str(r["unit"]): {"dir": f"{folder}/unit={r['unit']}", "lo": r["lo"], "hi": r["hi"]} for r in now}
        self._publish(held, done | {"units": units})

    def _publish(self, held: dict, now: dict) -> None:
        if self.manifest()["version"] != held["version"]:
            raise RuntimeError("another writer has changed the session table")
        shared.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(now))


def sessions_by_batches(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], gap: int, arrival: str, batches: int, once_by_id: bool = False) -> DataFrame:
    """rows, replayed through a SessionTable in `batches` spans of arrival time: key, session_start, session_end, n_events.

    prepare makes a batch of rows into (key, start_s, end_s[, id]); it comes behind the filter on arrival, which reaches
    the scan, so that a row is parsed in its own batch only. Rows without an arrival come with the last batch.
    """
    spark = rows.sparkSession
    table = SessionTable(spark, shared.scratch(spark, "sessions"), gap, once_by_id=once_by_id)
    at = F.col(arrival)
    ends = rows.agg(F.min(at).cast("timestamp_ntz").alias("lo"), F.max(at).cast("timestamp_ntz").alias("hi")).first()
    if ends["lo"] is None or batches < 2:
        table.merge(prepare(rows))
        return table.sessions()
    step = (ends["hi"] - ends["lo"]) / batches
    cuts = [F.lit(ends["lo"] + step * i).cast("timestamp_ntz") for i in range(1, batches)]
    for i in range(batches):
        if i == 0:
            part = rows.filter(at < cuts[0])
        elif i < batches - 1:
            part = rows.filter((at >= cuts[i - 1]) & (at < cuts[i]))
        else:
            part = rows.filter(at.isNull() | (at >= cuts[-1]))
        table.merge(prepare(part))
    return table.sessions()
