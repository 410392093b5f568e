"""Queries on the general problems, by name, and their SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.times import usable_trips
from trackloom.operators.intervals import periods_and_gaps
from trackloom.operators.proximity import containing_region, within_distance
from trackloom.operators.sessions import sessions_by_batches
from trackloom.plans.geometry_sql import EDGES, holding
from trackloom.sources import records

SESSION_GAP_S = 4 * 3600
HOLE_S = 72 * 3600
NEAR_M = 75.0
#: Spans of arrival time in which the session table takes the trips.
BATCHES = 4


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keyed = lambda t: usable_trips(t).withColumnRenamed("participantId", "key")
    return sessions_by_batches(_read(spark, d, "trips"), keyed, SESSION_GAP_S, "received_at", BATCHES).select(F.col("key").alias("participantId"), "session_start", "session_end")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with duration and number of trips; a trip delivered again counts once."""
    keyed = lambda t: usable_trips(t, F.col("trip_id").alias("id")).withColumnRenamed("participantId", "key")
    s = sessions_by_batches(_read(spark, d, "trips"), keyed, SESSION_GAP_S, "received_at", BATCHES, once_by_id=True)
    return s.select(F.col("key").alias("participantId"), "session_start", "session_end", (F.col("session_end") - F.col("session_start")).alias("duration_s"), F.col("n_events").alias("n_trips"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    trips = usable_trips(_read(spark, d, "trips")).withColumnRenamed("participantId", "entity")
    return periods_and_gaps(trips, HOLE_S).withColumnRenamed("entity", "participantId")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ends = _read(spark, d, "trips").select(F.col("trip_id").alias("point"), F.col("tripEndLongitude").alias("lon"), F.col("tripEndLatitude").alias("lat"))
    places = _read(spark, d, "pois").select(F.col("PLACEKEY").alias("place"), F.col("LONGITUDE").alias("lon"), F.col("LATITUDE").alias("lat"))
    return within_distance(ends, places, NEAR_M).select(F.col("point").alias("trip_id"), F.col("place").alias("PLACEKEY"))


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cell that holds the end of each trip."""
    ends = _read(spark, d, "trips").select(F.col("trip_id").alias("point"), F.col("tripEndLongitude").alias("lon"), F.col("tripEndLatitude").alias("lat"))
    cells = _read(spark, d, "cells").select(F.col("hex_id").alias("region"), "geometry")
    return containing_region(ends, cells).select(F.col("point").alias("trip_id"), F.col("region").alias("hex_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return records.failures(_read(spark, d, "poi_raw"))


def p7_valid_places(spark: SparkSession, d: str) -> DataFrame:
    return records.valid_rows(_read(spark, d, "poi_raw"), "US_POI")


def p7_valid_subset(spark: SparkSession, d: str) -> DataFrame:
    return records.valid_rows(_read(spark, d, "poi_raw"), "Hull_FL_poi_vec_subset")


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p2_found, p4_found, p4_cells, p7_found, p7_valid_places, p7_valid_subset)}

_FORM = r"'^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.0+)?(Z|[+-]\d{2}:\d{2})$'"


def _seconds(c: str) -> str:
    off = f"case when {c} like '%Z' then 0 else (case when substr({c}, -6, 1) = '-' then -1 else 1 end) * (try_cast(substr({c}, -5, 2) as int) * 3600 + try_cast(substr({c}, -2, 2) as int) * 60) end"
    return f"case when regexp_matches({c}, {_FORM}) then epoch(try_cast(replace(substr({c}, 1, 19), 'T', ' ') as timestamp))::bigint - ({off}) end"


USABLE = f"""usable as (select * from (select trip_id, btrim.p as p, {_seconds("tripStartDate")} as s, {_seconds("tripEndDate")} as e
from trips, lateral (select trim(participantId, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) as p) btrim)
where p <> '' and e >= s)"""

_ISLANDS = """marked as (select *, coalesce(cast(s - max(e) over (partition by p order by s, e rows between unbounded preceding and 1 preceding) > {gap} as int), 1) as fresh from usable),
island as (select *, sum(fresh) over (partition by p order by s, e rows unbounded preceding) as i from marked)"""

_P7 = r"""with raw as (select raw_id, source_file, coalesce(record, '') as r, case source_file when 'Hull_FL_poi_vec_subset' then 5 when 'US_POI' then 7 else -1 end as width from poi_raw),
ok as (select *, regexp_full_match(r, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') as quoted from raw),
cells as (select *, case when quoted then list_transform(regexp_extract_all(',' || r, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda x: case when x like '"%' then replace(x[2:len(x) - 1], '""', '"') else x end) end as c from ok),
said as (select raw_id, case when not quoted then 'quoting' when len(c) <> width then 'column_count'
when width = 5 and not (regexp_full_match(c[5], '(?i)\s*point\s*\(\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s+[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*\)\s*')
and abs(try_cast(regexp_extract(c[5], '([^(\s]+)\s+[^\s)]+\s*\)', 1) as double)) <= 180 and abs(try_cast(regexp_extract(c[5], '([^(\s]+)\s*\)', 1) as double)) <= 90) then 'geometry'
when regexp_full_match(c[2], '[\s\v\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]*') or regexp_matches(c[2], '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]') then 'location_name' end as reason from cells)
select raw_id, reason from said where reason is not null"""

def _valid(source: str, *columns: str) -> str:
    picked = ", ".join(f"c[{i}] as {c}" for i, c in enumerate(columns, 1))
    head = _P7.rpartition("select raw_id, reason")[0]
    return f"{head}select raw_id, {picked} from said join cells using (raw_id) where reason is null and source_file = '{source}'"


SQL = {
    "p7_valid_places": _valid("US_POI", "PLACEKEY", "LOCATION_NAME", "TOP_CATEGORY", "SUB_CATEGORY", "LONGITUDE", "LATITUDE", "REGION"),
    "p7_valid_subset": _valid("Hull_FL_poi_vec_subset", "PLACEKEY", "LOCATION_NAME", "label_pair", "hex_id", "geometry"),
    "p1_found": f"with {USABLE}, {_ISLANDS.format(gap=SESSION_GAP_S)} select p as participantId, min(s) as session_start, max(e) as session_end from island group by p, i",
    "p1_sessions": f"with {USABLE}, {_ISLANDS.format(gap=SESSION_GAP_S)} select p as participantId, min(s) as session_start, max(e) as session_end, max(e) - min(s) as duration_s, count(distinct trip_id) as n_trips from island group by p, i",
    "p2_found": f"""with {USABLE}, {_ISLANDS.format(gap=0)},
period as (select p, min(s) as s, max(e) as e from island group by p, i),
hole as (select p, lag(e) over (partition by p order by s) as s, s as e from period)
select p as participantId, 'period' as kind, s as from_s, e as to_s from period
union all select p, 'gap', s, e from hole where e - s <= {HOLE_S}""",
    "p4_found": f"""with t as (select distinct trip_id, tripEndLongitude as x, tripEndLatitude as y from trips),
q as (select distinct PLACEKEY, LONGITUDE as u, LATITUDE as v from pois),
a as (select *, floor(y / 0.001)::int as i, floor(x / 0.002)::int as j from t where abs(x) <= 180 and abs(y) <= 90 and not isnan(x) and not isnan(y) and not (x = 0 and y = 0)),
b as (select *, floor(v / 0.001)::int + di as i, floor(u / 0.002)::int + dj as j from q, (select unnest([-1, 0, 1]) as di), (select unnest([-1, 0, 1]) as dj) where abs(u) <= 180 and abs(v) <= 90 and not isnan(u) and not isnan(v) and not (u = 0 and v = 0))
select distinct trip_id, PLACEKEY from a join b using (i, j)
where 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(v - y) / 2), 2) + cos(radians(y)) * cos(radians(v)) * pow(sin(radians(u - x) / 2), 2)))) <= {NEAR_M}""",
    "p4_cells": f"""with {EDGES}, q as (select distinct trip_id as point, tripEndLongitude as lon, tripEndLatitude as lat from trips where abs(tripEndLongitude) <= 180 and abs(tripEndLatitude) <= 90 and not isnan(tripEndLongitude) and not isnan(tripEndLatitude) and not (tripEndLongitude = 0 and tripEndLatitude = 0)),
{holding("q")} select point as trip_id, hex_id from held""",
    "p7_found": _P7,
}
