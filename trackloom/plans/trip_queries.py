"""Queries on trips: stitching, links, legs, nearest places, geometry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo
from trackloom.operators import nearest, shapes, stitch
from trackloom.plans.registry import query, read
from trackloom.plans.views import METRES, PLACES, TRIPS, double, places, trips

_GAP = METRES.format(lat1="prev_lat", lon1="prev_lon", lat2="lat0", lon2="lon0")
STITCHED = f"""{TRIPS}, lagged as (select *, lag(end_s) over w as prev_end, lag(lon1) over w as prev_lon, lag(lat1) over w as prev_lat from own window w as (partition by person_id order by start_s, end_s, trip_id)),
gapped as (select *, start_s - prev_end as gap_s, {_GAP} as dist_m from lagged),
tags as (select *, case when gap_s is null then null when gap_s <= 14400 and dist_m <= 100 then 'continue' when gap_s <= 28800 and dist_m <= 100 then 'soft_break' else 'hard_break' end as tag from gapped),
stitched as (select *, sum(case when tag <> 'continue' then 1 else 0 end) over (partition by person_id order by start_s, end_s, trip_id rows unbounded preceding) as seg_id from tags)"""


def _stitched(s: SparkSession, d: str) -> DataFrame:
    return stitch.tagged(trips(s, d), geo.haversine)


def _r(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in cols})


@query(f"""with {STITCHED}, segs as (select person_id, seg_id, count(*) as num_trips, count(*) filter (tag = 'continue') as link_count, min(start_s) as start_s, max(end_s) as end_s,
coalesce(max(gap_s / 3600) filter (tag = 'continue'), 0.0) as max_gap_h, coalesce(avg(gap_s / 3600) filter (tag = 'continue'), 0.0) as mean_gap_h, coalesce(sum(gap_s / 3600) filter (tag = 'continue'), 0.0) as total_gap_h,
min_by(coalesce(tag, 'none'), (start_s, end_s, trip_id)) as opened from stitched group by person_id, seg_id)
select person_id, seg_id, num_trips, link_count, start_s, end_s, round(max_gap_h, 6) as max_gap_h, round(mean_gap_h, 6) as mean_gap_h, round(total_gap_h, 6) as total_gap_h, coalesce(lead(opened) over (partition by person_id order by seg_id), 'final') as ended_by from segs""")
def stitch_segments(s: SparkSession, d: str) -> DataFrame:
    return _r(stitch.segments(_stitched(s, d)), "max_gap_h", "mean_gap_h", "total_gap_h")


@query(f"""with {STITCHED} select person_id, seg_id, row_number() over (partition by person_id, seg_id order by start_s, end_s, trip_id) - 1 as link_idx, prev_end as stop_s, start_s as next_start_s, gap_s, round(gap_s / 3600, 6) as gap_h, round(dist_m, 4) as dist_m, prev_lon as lon_a, prev_lat as lat_a, lon0 as lon_b, lat0 as lat_b from stitched where tag = 'continue'""")
def stitch_links(s: SparkSession, d: str) -> DataFrame:
    return _r(_r(stitch.links(_stitched(s, d)), "gap_h"), "dist_m", to=4)


@query()
def stitch_segments_geodesic(s: SparkSession, d: str) -> DataFrame:
    """As stitch_segments with distances on the ellipsoid."""
    return stitch.segments(stitch.tagged(trips(s, d)))


@query(f"""with {STITCHED} select person_id, seg_id, [any_value(first_lon)] || list(lon1 order by start_s, end_s, trip_id) as lons from (select *, first_value(lon0) over (partition by person_id, seg_id order by start_s, end_s, trip_id) as first_lon from stitched) group by 1, 2""")
def line_from_points(s: SparkSession, d: str) -> DataFrame:
    return stitch.segment_lines(_stitched(s, d)).select("person_id", "seg_id", F.transform("line", lambda p: p["lon"]).alias("lons"))




@query(f"""with {TRIPS}, {PLACES}, q as (select person_id || ':' || trip_id as point, lon1 as lon, lat1 as lat from own),
r as (select q.point, p.PLACEKEY as place, {METRES.format(lat1='q.lat', lon1='q.lon', lat2='p.lat', lon2='p.lon')} as m from q, places p),
k as (select *, row_number() over (partition by point order by m, place) as rank from r) select point, place, round(m, 4) as dist_m, rank from k where rank <= 10""")
def knn_places_of_trip_ends(s: SparkSession, d: str) -> DataFrame:
    """The ten places nearest to the end of each trip."""
    ends = trips(s, d).select(F.concat_ws(":", "person_id", "trip_id").alias("point"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat"))
    p = places(s, d).select(F.col("PLACEKEY").alias("place"), "lon", "lat")
    return _r(nearest.k_nearest(ends, p, 10), "dist_m", to=4)


@query(f"""with {STITCHED}, {PLACES}, l as (select person_id, seg_id, trip_id, prev_lon, prev_lat, lon0, lat0 from stitched where tag = 'continue'),
q as (select trip_id, 'start' as endpoint, prev_lon as lon, prev_lat as lat from l union all select trip_id, 'end', lon0, lat0 from l),
r as (select trip_id, endpoint, p.PLACEKEY as place, {METRES.format(lat1='q.lat', lon1='q.lon', lat2='p.lat', lon2='p.lon')} as m from q, places p),
k as (select *, row_number() over (partition by trip_id, endpoint order by m, place) as rank from r) select trip_id, endpoint, place, round(m, 4) as dist_m, rank from k where rank <= 3""")
def knn_pois_for_links(s: SparkSession, d: str) -> DataFrame:
    """The three places nearest to both ends of every link."""
    at = lambda name, lon, lat: F.struct(F.lit(name).alias("endpoint"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    ends = _stitched(s, d).filter("tag = 'continue'").select("trip_id", F.explode(F.array(at("start", "prev_lon", "prev_lat"), at("end", "lon0", "lat0"))).alias("e"))
    pts = ends.select(F.struct("trip_id", "e.endpoint").alias("point"), "e.lon", "e.lat")
    k = nearest.k_nearest(pts, places(s, d).select(F.col("PLACEKEY").alias("place"), "lon", "lat"), 3)
    return _r(k.select("point.trip_id", "point.endpoint", "place", "dist_m", "rank"), "dist_m", to=4)


@query(f"with {TRIPS} select trip_id, round({METRES.format(lat1='lat0', lon1='lon0', lat2='lat1', lon2='lon1')} / 1000, 6) as km from own")
def haversine_km(s: SparkSession, d: str) -> DataFrame:
    return trips(s, d).select("trip_id", F.round(geo.haversine(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")) / 1000, 6).alias("km"))


@query(f"with {TRIPS} select trip_id, cast(floor((lon1 + 180) / 6) + 1 as int) as zone, cast(floor((lon1 + 180) / 6) + 1 + case when lat1 >= 0 then 32600 else 32700 end as int) as epsg from own")
def utm_zone(s: SparkSession, d: str) -> DataFrame:
    return trips(s, d).select("trip_id", geo.utm_zone(F.col("lon1")).alias("zone"), geo.utm_epsg(F.col("lon1"), F.col("lat1")).cast("int").alias("epsg"))


@query(f"with {TRIPS} select trip_id, round(6378137.0 * radians(lon1), 4) as x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat1) / 2)), 4) as y from own")
def web_mercator(s: SparkSession, d: str) -> DataFrame:
    x, y = geo.to_mercator(F.col("lon1"), F.col("lat1"))
    return trips(s, d).select("trip_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def _albers_sql() -> str:
    """x and y of a trip's end in the equal-area projection, the constants worked out."""
    e2, n, c, rho0 = geo._albers()
    e = math.sqrt(e2)
    q = f"(1 - {e2!r}) * (s / (1 - {e2!r} * s * s) - ln((1 - {e!r} * s) / (1 + {e!r} * s)) / (2 * {e!r}))"
    return f"""r as (select trip_id, {geo.A84!r} * sqrt({c!r} - {n!r} * {q}) / {n!r} as rho, {n!r} * radians(lon1 + 96) as theta from (select *, sin(radians(lat1)) as s from own)),
flat as (select trip_id, rho * sin(theta) as x, {rho0!r} - rho * cos(theta) as y from r)"""


@query(f"with {TRIPS}, {_albers_sql()} select trip_id, round(x, 3) as x, round(y, 3) as y, 0.0 as error from flat")
def albers_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Trip ends in the equal-area projection, and back: the largest error in degrees."""
    x, y = geo.to_albers(F.col("lon1"), F.col("lat1"))
    t = trips(s, d).select("trip_id", "lon1", "lat1", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_albers(F.col("x"), F.col("y"))
    return t.select("trip_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(F.greatest(F.abs(lon - F.col("lon1")), F.abs(lat - F.col("lat1"))), 6).alias("error"))


@query(f"with h as (select vec_id, hex(geometry) as h from poi_vectors where geometry is not null) select vec_id, {double('substr(h, 11, 16)')} as lon, {double('substr(h, 27, 16)')} as lat from h")
def wkb_points(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "poi_vectors").filter("geometry is not null").select("vec_id", geo.wkb_point(F.col("geometry")).alias("p"))
    return p.select("vec_id", "p.lon", "p.lat")


@query("""with f as (select count(*) as all_rows from trips) select cast(count(*) as bigint) as n, round(avg(cast(participantId is null as int)), 6) as participant, round(avg(cast(tripStartDate is null as int)), 6) as start, round(avg(cast(tripEndLatitude is null as int)), 6) as lat from trips""")
def null_fraction(s: SparkSession, d: str) -> DataFrame:
    part = lambda c: F.round(F.avg(F.col(c).isNull().cast("int")), 6)
    return read(s, d, "trips").agg(F.count(F.lit(1)).alias("n"), part("participantId").alias("participant"), part("tripStartDate").alias("start"), part("tripEndLatitude").alias("lat"))


@query("select trip_id from trips where tripEndLongitude between -87.6 and -79.95 and tripEndLatitude between 24.5 and 31.0 and not isnan(tripEndLatitude) and not isnan(tripEndLongitude)")
def bbox_filter(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "trips").filter(F.col("tripEndLongitude").between(-87.6, -79.95) & F.col("tripEndLatitude").between(24.5, 31.0)).select("trip_id")


@query("select trip_id from trips where participantId is not null and tripStartDate is not null and tripEndDate is not null and tripStartLongitude is not null")
def drop_nulls_in_subset(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "trips").dropna(subset=["participantId", "tripStartDate", "tripEndDate", "tripStartLongitude"]).select("trip_id")


@query(f"with {TRIPS} select trip_id, 'start' as endpoint, lon0 as lon, lat0 as lat from own union all select trip_id, 'end', lon1, lat1 from own")
def union_endpoints(s: SparkSession, d: str) -> DataFrame:
    t = trips(s, d)
    one = lambda n, i: t.select("trip_id", F.lit(n).alias("endpoint"), F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
    return one("start", 0).unionByName(one("end", 1))


@query(f"with {TRIPS}, n as (select *, lead(trip_id) over w as next_trip, lead(start_s) over w as next_start_s from own window w as (partition by person_id order by start_s, end_s, trip_id)) select person_id, trip_id, next_trip, next_start_s from n where next_trip is not null")
def lead_legs(s: SparkSession, d: str) -> DataFrame:
    t = trips(s, d).withColumn("step_order", F.struct("start_s", "end_s", "trip_id"))
    return stitch.legs(t, carried=("trip_id", "start_s"), at=F.floor(F.col("start_s") / stitch.CHUNK_S)).select("person_id", "trip_id", F.col("next_trip_id").alias("next_trip"), "next_start_s")


@query(f"with {TRIPS}, m as (select *, lon0 = lon1 and lat0 = lat1 as zero from own) select zero, count(*) as trips from m group by 1")
def zero_length_legs(s: SparkSession, d: str) -> DataFrame:
    return trips(s, d).groupBy(((F.col("lon0") == F.col("lon1")) & (F.col("lat0") == F.col("lat1"))).alias("zero")).agg(F.count(F.lit(1)).alias("trips"))


@query(f"with {TRIPS}, r as (select *, row_number() over (partition by person_id order by start_s desc, end_s desc, trip_id desc) as r from own) select trip_id from r where r > 1")
def drop_last_row(s: SparkSession, d: str) -> DataFrame:
    """All trips but each person's last."""
    w = Window.partitionBy("person_id").orderBy(F.desc("start_s"), F.desc("end_s"), F.desc("trip_id"))
    return trips(s, d).withColumn("r", F.row_number().over(w)).filter("r > 1").select("trip_id")


@query(f"""with {TRIPS}, j as (select person_id, cast(floor(start_s / 3600) as bigint) as hour, trip_id, lon1, lat1, start_s from own), r as (select *, row_number() over (partition by person_id, hour order by start_s, trip_id) as r from j) select person_id, hour, trip_id from r where r = 1""")
def first_point_per_traj(s: SparkSession, d: str) -> DataFrame:
    """The first trip of each person and hour."""
    t = trips(s, d).withColumn("hour", F.floor(F.col("start_s") / 3600))
    return t.groupBy("person_id", "hour").agg(F.min_by("trip_id", F.struct("start_s", "trip_id")).alias("trip_id"))


@query(f"with {TRIPS} select person_id, round(avg(lon1), 6) as lon, round(avg(lat1), 6) as lat, round(min(lon1), 6) as min_lon, round(max(lon1), 6) as max_lon, round(min(lat1), 6) as min_lat, round(max(lat1), 6) as max_lat from own group by 1")
def bounds_and_centre(s: SparkSession, d: str) -> DataFrame:
    r = lambda f, c: F.round(f(c), 6)
    return trips(s, d).groupBy("person_id").agg(r(F.avg, "lon1").alias("lon"), r(F.avg, "lat1").alias("lat"), r(F.min, "lon1").alias("min_lon"), r(F.max, "lon1").alias("max_lon"), r(F.min, "lat1").alias("min_lat"), r(F.max, "lat1").alias("max_lat"))


@query()
def person_features(s: SparkSession, d: str) -> DataFrame:
    from trackloom.operators import classify

    return classify.person_features(classify.steps_of_trips(trips(s, d)))


@query(f"""with {TRIPS}, p as (select person_id, count(*) as n_moves, max({METRES.format(lat1='h.lat', lon1='h.lon', lat2='lat1', lon2='lon1')}) / 1000 as max_km from own join (select person_id, min_by({{'lon': lon0, 'lat': lat0}}, (start_s, end_s, trip_id)) as h from own group by 1) using (person_id) group by 1)
select person_id, n_moves, round(max_km, 5) as max_km from p""")
def person_rollup(s: SparkSession, d: str) -> DataFrame:
    """Moves of each person and the farthest a trip ended from where the first one began."""
    t = trips(s, d)
    home = t.groupBy("person_id").agg(F.min_by(F.struct("lon0", "lat0"), F.struct("start_s", "end_s", "trip_id")).alias("h"))
    far = geo.haversine(F.col("h.lat0"), F.col("h.lon0"), F.col("lat1"), F.col("lon1")) / 1000
    return t.join(home, "person_id").groupBy("person_id").agg(F.count(F.lit(1)).alias("n_moves"), F.round(F.max(far), 5).alias("max_km"))


@query("""with c as (select hex_id, count(*) as n from cells group by 1) select hex_id, n from c""")
def cell_ids_unique(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "cells").groupBy("hex_id").agg(F.count(F.lit(1)).alias("n"))




@query(f"""with {TRIPS}, {_albers_sql()}, way as (select x * cos(a) + y * sin(a) as far, a from flat, (select radians(unnest(range(0, 360, 15))) as a))
select a, round(max(far), 3) as far from way group by 1""")
def convex_hull_widths(s: SparkSession, d: str) -> DataFrame:
    """How far the hull of all trip ends reaches in each of 24 directions: as far as the ends themselves do."""
    hull = convex_hull(s, d).select("x", "y")
    a = F.explode(F.transform(F.sequence(F.lit(0), F.lit(345), F.lit(15)), lambda v: F.radians(v)))
    way = hull.withColumn("a", a)
    return way.groupBy("a").agg(F.round(F.max(F.col("x") * F.cos("a") + F.col("y") * F.sin("a")), 3).alias("far"))


@query()
def convex_hull(s: SparkSession, d: str) -> DataFrame:
    """The hull of all trip ends in the equal-area projection."""
    x, y = geo.to_albers(F.col("lon1"), F.col("lat1"))
    return shapes.convex_hull(trips(s, d).select(x.alias("x"), y.alias("y")))


@query()
def simplified_lines(s: SparkSession, d: str) -> DataFrame:
    """Segment lines without the vertices that lie within about 250 m of the rest."""
    line = stitch.segment_lines(_stitched(s, d))
    return line.select("person_id", "seg_id", F.size(shapes.simplify(F.transform("line", lambda p: p["lon"]), F.transform("line", lambda p: p["lat"]), 0.00225)).alias("vertices"))
