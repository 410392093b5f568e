"""The entities of the mobility model over the test tables, in Spark and, word for word, in SQL.

visits(traj_id, pt_idx, hex_id): an hourly series from `events`; labels(traj_id, cluster); poi_counts(hex_id, cat_name,
cat_count) and places from `part`; trips with usable dates and positions from `trips`; hexes of `cells`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.columns import HOURS
from trackloom.functions.times import usable_trips
from trackloom.operators.proximity import placed
from trackloom.plans.geometry_sql import EDGES, double, holding  # noqa: F401 - read by the queries beside the entities
from trackloom.plans.problems import USABLE
from trackloom.plans.registry import read

CELLS, CLUSTERS = 97, 4


def visits(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    begin = e.agg(F.min(seconds).alias("begin"))
    hour = F.floor((seconds - F.col("begin")) / 3600)
    return e.join(F.broadcast(begin)).select(F.col("user_id").alias("traj_id"), (hour % HOURS + 1).cast("int").alias("pt_idx"), (F.col("event_id") * 7919 % CELLS).alias("hex_id"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("traj_id")).distinct().withColumn("cluster", (F.col("traj_id") * 31 % CLUSTERS).cast("int"))


def poi_counts(spark: SparkSession, d: str) -> DataFrame:
    """Categories of each cell; cell 13 has no places."""
    p = read(spark, d, "part").select((F.col("p_partkey") * 37 % CELLS).alias("hex_id"), F.col("p_brand").alias("cat_name")).filter("hex_id <> 13")
    return p.groupBy("hex_id", "cat_name").agg(F.count(F.lit(1)).alias("cat_count"))


def trips(spark: SparkSession, d: str) -> DataFrame:
    """Usable trips of valid positions, each trip_id once (its first delivery)."""
    raw = read(spark, d, "trips")
    cols = {"tripStartLongitude": "lon0", "tripStartLatitude": "lat0", "tripEndLongitude": "lon1", "tripEndLatitude": "lat1"}
    t = usable_trips(raw, "trip_id", *[F.col(a).alias(b) for a, b in cols.items()]).withColumnRenamed("participantId", "person_id")
    return t.filter(placed(F.col("lon0"), F.col("lat0")) & placed(F.col("lon1"), F.col("lat1"))).dropDuplicates(["trip_id"])


def places(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pois")
    return p.filter(placed(F.col("LONGITUDE"), F.col("LATITUDE")) & F.col("PLACEKEY").isNotNull()).groupBy("PLACEKEY").agg(
        F.min(F.struct("LONGITUDE", "LATITUDE")).alias("p"), F.min("TOP_CATEGORY").alias("top"), F.min("SUB_CATEGORY").alias("sub")
    ).select("PLACEKEY", F.col("p.LONGITUDE").alias("lon"), F.col("p.LATITUDE").alias("lat"), "top", "sub")


VISITS = f"""visits as (select user_id as traj_id, cast((floor((epoch(ts) - (select min(floor(epoch(ts))) from events)) / 3600))::bigint % {HOURS} + 1 as int) as pt_idx, event_id * 7919 % {CELLS} as hex_id from events)"""
LABELS = f"labels as (select distinct user_id as traj_id, cast(user_id * 31 % {CLUSTERS} as int) as cluster from events)"
POI_COUNTS = f"poi_counts as (select p_partkey * 37 % {CELLS} as hex_id, p_brand as cat_name, count(*) as cat_count from part where p_partkey * 37 % {CELLS} <> 13 group by 1, 2)"
OK = "abs({x}) <= 180 and abs({y}) <= 90 and not isnan({x}) and not isnan({y}) and not ({x} = 0 and {y} = 0)"
TRIPS = f"""{USABLE}, own as (select distinct trip_id, p as person_id, s as start_s, e as end_s, tripStartLongitude as lon0, tripStartLatitude as lat0, tripEndLongitude as lon1, tripEndLatitude as lat1 from usable join trips using (trip_id)
where {OK.format(x='tripStartLongitude', y='tripStartLatitude')} and {OK.format(x='tripEndLongitude', y='tripEndLatitude')})"""
PLACES = f"""places as (select PLACEKEY, p.lon as lon, p.lat as lat, top, sub from (select PLACEKEY, min({{'lon': LONGITUDE, 'lat': LATITUDE}}) as p, min(TOP_CATEGORY) as top, min(SUB_CATEGORY) as sub from pois
where {OK.format(x='LONGITUDE', y='LATITUDE')} and PLACEKEY is not null group by PLACEKEY))"""
#: Haversine metres in SQL.
METRES = "(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def nearest_of(points: str, segments: str, piece_m: float = 500.0) -> str:
    """`nearest`: the name of the segment (name, x0, y0, x1, y1) nearest to each row of a table (point, lon, lat)."""
    vec = lambda x, y: f"cos(radians({y})) * cos(radians({x})), cos(radians({y})) * sin(radians({x})), sin(radians({y}))"
    n = METRES.format(lat1="y0", lon1="x0", lat2="y1", lon2="x1")
    return f"""piece as (select name, x0 + (x1 - x0) * i / n as ax, y0 + (y1 - y0) * i / n as ay, x0 + (x1 - x0) * (i + 1) / n as bx, y0 + (y1 - y0) * (i + 1) / n as by_ from (select *, unnest(range(0, n)) as i from (select *, greatest(1, ceil({n} / {piece_m}))::int as n from {segments}))),
pvec as (select point, [{vec("lon", "lat")}] as p from {points}),
svec as (select name, [{vec("ax", "ay")}] as a, [{vec("bx", "by_")}] as b from piece),
apart as (select point, name, [a[1] - p[1], a[2] - p[2], a[3] - p[3]] as ap, [b[1] - a[1], b[2] - a[2], b[3] - a[3]] as ab from pvec, svec),
along as (select *, case when list_dot_product(ab, ab) > 0 then greatest(0.0, least(1.0, -list_dot_product(ab, ap) / list_dot_product(ab, ab))) else 0.0 end as t from apart),
far as (select point, name, round(12742000.0 * asin(least(1.0, sqrt(pow(ap[1] + t * ab[1], 2) + pow(ap[2] + t * ab[2], 2) + pow(ap[3] + t * ab[3], 2)) / 2)), 3) as dist_m from along),
nearest as (select point, min_by(name, (dist_m, name)) as name, min(dist_m) as dist_m from far group by 1)"""
