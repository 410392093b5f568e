"""Queries on graphs, routes, hourly positions, simulation, clusters and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.operators import agents, classify, cluster, features, graph, hourly, models, nearest, pairwise, proximity, stitch, textprep
from trackloom.operators import statistics as S
from trackloom.plans.registry import query, read
from trackloom.plans.views import EDGES, METRES, OK, PLACES, TRIPS, holding, nearest_of, places, trips
from trackloom.sources import io

R = 6

# graphs. Suppliers are nodes; each is joined to two others by arithmetic on its key, all within its nation.
_EDGES = "edges as (select distinct least(a.s_suppkey, b.s_suppkey) as src, greatest(a.s_suppkey, b.s_suppkey) as dst from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey and (b.s_suppkey - a.s_suppkey) % 3 <> 0)"


def _edges(s: SparkSession, d: str) -> DataFrame:
    a = read(s, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("src"))
    b = read(s, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("dst"))
    return a.join(b, "s_nationkey").filter("src < dst and (dst - src) % 3 <> 0").select("src", "dst")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "supplier").select(F.col("s_suppkey").alias("id"))


@query(f"""with recursive {_EDGES}, both_ways as (select src, dst from edges union all select dst, src from edges), reach as (select s_suppkey as id, s_suppkey as r from supplier union select reach.id, both_ways.dst from reach join both_ways on reach.r = both_ways.src)
select id, min(r) as component from reach group by 1""")
def components(s: SparkSession, d: str) -> DataFrame:
    return graph.components(_nodes(s, d), _edges(s, d))


@query(f"with {_EDGES}, e as (select src as id from edges union all select dst from edges) select s_suppkey as id, count(e.id) as degree from supplier left join e on e.id = s_suppkey group by 1")
def degrees(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_nodes(s, d), graph.undirected(_edges(s, d)))


@query(f"with {EDGES}, v as (select distinct hex_id, round(x, 7) as x, round(y, 7) as y from corner) select distinct a.hex_id as src, b.hex_id as dst from v a join v b on a.x = b.x and a.y = b.y and a.hex_id < b.hex_id")
def cell_contiguity(s: SparkSession, d: str) -> DataFrame:
    return graph.queen_contiguity(_cells(s, d))


def _cells(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "cells").select(F.col("hex_id").alias("region"), "geometry")


def _centres(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "cells").select(F.col("hex_id").alias("region"), "geometry").mapInArrow(proximity.region_edges, "region string, x0 double, y0 double, x1 double, y1 double")
    return e.groupBy("region").agg(F.avg((F.col("x0") + F.col("x1")) / 2).alias("lon"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("lat"))


@query()
def cell_knn_graph(s: SparkSession, d: str) -> DataFrame:
    return graph.knn_graph(_centres(s, d).withColumnRenamed("region", "id"), 6)


@query(f"""with {PLACES}, {EDGES}, q as (select PLACEKEY as point, lon, lat from places), {holding("q")}, rest as (select * from q where point not in (select point from held)),
seg as (select hex_id as name, x0, y0, x1, y1 from edge), {nearest_of("rest", "seg")} select point, hex_id as region, 0.0 as dist_m from held union all select point, name, dist_m from nearest""")
def nearest_cell_join(s: SparkSession, d: str) -> DataFrame:
    """The cell that holds each place, or the one whose border is nearest."""
    return nearest.nearest_region(places(s, d).select(F.col("PLACEKEY").alias("point"), "lon", "lat"), _cells(s, d))


@query(f"""with {EDGES}, q as (select distinct trip_id as point, tripEndLongitude as lon, tripEndLatitude as lat from trips where {OK.format(x="tripEndLongitude", y="tripEndLatitude")}), {holding("q")}, rest as (select * from q where point not in (select point from held)),
seg as (select hex_id as name, x0, y0, x1, y1 from edge), {nearest_of("rest", "seg")} select point, hex_id as region, 'within' as how, 0.0 as dist_m from held union all select point, name, 'nearest', dist_m from nearest""")
def within_or_nearest_cell(s: SparkSession, d: str) -> DataFrame:
    """The cell that holds the end of each trip, and for ends outside all cells the one whose border is nearest."""
    ends = read(s, d, "trips").select(F.col("trip_id").alias("point"), F.col("tripEndLongitude").alias("lon"), F.col("tripEndLatitude").alias("lat")).filter(proximity.placed(F.col("lon"), F.col("lat"))).distinct()
    found = nearest.nearest_region(ends, _cells(s, d))
    return found.select("point", "region", F.when(F.col("dist_m") > 0, "nearest").otherwise("within").alias("how"), "dist_m")


@query()
def random_walks(s: SparkSession, d: str) -> DataFrame:
    return graph.random_walks(_edges(s, d), 16, 128)


# routes: a grid of 30 x 30 junctions; legs are trips, their ends folded onto it
_SIDE = 30


def _network(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph.grid_network(_SIDE, s)
    return nodes, graph.best_edges(graph.with_travel_time(edges))


def _legs(s: SparkSession, d: str) -> DataFrame:
    n = _SIDE * _SIDE
    return trips(s, d).select(F.col("trip_id").alias("leg"), (F.col("trip_id") * 7919 % n).alias("origin"), (F.col("trip_id") * 104_729 % n).alias("dest"))


@query()
def shortest_paths(s: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(_network(s)[1], _legs(s, d))


@query()
def route_stats(s: SparkSession, d: str) -> DataFrame:
    _, edges = _network(s)
    return graph.path_stats(graph.shortest_paths(edges, _legs(s, d)).select("leg", "path"), edges)


@query(f"""with {TRIPS}, q as (select distinct trip_id as point, lon1 as lon, lat1 as lat from own), node as (select i::bigint as id, -80 + (i % 30) * 0.001 as lon, 26 + floor(i / 30) * 0.001 as lat from (select unnest(range(0, 900)) as i)),
link as (select a.id as u, b.id as v, a.lon as x0, a.lat as y0, b.lon as x1, b.lat as y1 from node a join node b on (b.id = a.id + 1 and a.id % 30 < 29) or b.id = a.id + 30),
seg as (select {{'u': u, 'v': v}} as name, x0, y0, x1, y1 from link), {nearest_of("q", "seg")},
end_ as (select q.point, n.id as node, round({METRES.format(lat1="q.lat", lon1="q.lon", lat2="n.lat", lon2="n.lon")}, 3) as dist_m from nearest e join q using (point) join node n on n.id in (e.name.u, e.name.v))
select point, min_by(node, (dist_m, node)) as node, min(dist_m) as dist_m from end_ group by 1""")
def snapped_nodes(s: SparkSession, d: str) -> DataFrame:
    """The nearer end of the road nearest to the end of each trip."""
    nodes, edges = _network(s)
    return graph.snapped(trips(s, d).select(F.col("trip_id").alias("point"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), nodes, edges)


# paths of persons
@query(f"""with {TRIPS}, st as (select person_id, row_number() over (partition by person_id order by start_s, end_s, trip_id) as o, case when lat1 < 26.5 then floor(lon1)::varchar end as county, round(lon1, 3)::varchar || ':' || round(lat1, 3)::varchar as poi, lon1, lat1 from own),
h as (select person_id, county as hc, lon1 as hx, lat1 as hy from st where o = 1)
select person_id, count(*) - 1 as n_moves, bool_or(coalesce(county <> hc, county is not null and hc is null)) as left_home_county, bool_or(county is null) as touched_outside_zone, round(max({METRES.replace('6371000.0', '6371009.0').format(lat1='hy', lon1='hx', lat2='lat1', lon2='lon1')}) / 1000, 5) as max_dist_km from st join h using (person_id) group by 1""")
def person_path_features(s: SparkSession, d: str) -> DataFrame:
    f = classify.person_features(classify.steps_of_trips(trips(s, d)))
    return f.select("person_id", "n_moves", "left_home_county", "touched_outside_zone", F.round("max_dist_km", 5).alias("max_dist_km"))


@query()
def trajectory_labels(s: SparkSession, d: str) -> DataFrame:
    return classify.person_features(classify.steps_of_trips(trips(s, d))).select("person_id", classify.trajectory_label().alias("label"))


def _travel(s: SparkSession, d: str) -> DataFrame:
    t = trips(s, d).select("person_id", F.struct("start_s", "end_s", "trip_id").alias("o"), (F.col("end_s") - F.col("start_s")).cast("double").alias("travel_s"), "lon0", "lat0", "lon1", "lat1")
    from pyspark.sql.window import Window

    step = F.row_number().over(Window.partitionBy("person_id").orderBy("o"))
    return t.withColumn("step", step).drop("o").withColumns({"origin_poi": F.when(F.col("step") == 1, "home").when(F.col("step") % 3 == 0, "Grocery Stores").otherwise("Restaurants"), "dest_poi": F.lit("home")})


@query()
def curfew_intervals(s: SparkSession, d: str) -> DataFrame:
    """Each person's trips as stays and moves on the simulated clock of a week."""
    return hourly.intervals_with_curfew(_travel(s, d))


@query()
def hourly_positions(s: SparkSession, d: str) -> DataFrame:
    return hourly.hourly_positions(hourly.intervals_with_curfew(_travel(s, d), hours=hourly.HOURS), warp_seed=7)


_BINS = f"""{TRIPS}, i as (select person_id, start_s - min(start_s) over (partition by person_id) as a, end_s - min(start_s) over (partition by person_id) as b, lon1, lat1 from own where end_s > start_s),
o as (select person_id, h::int as hour, (least(b, h * 3600) - greatest(a, (h - 1) * 3600))::double as w, lon1, lat1 from i, (select unnest(range(1, 25)) as h) where least(b, h * 3600) > greatest(a, (h - 1) * 3600)),
g as (select person_id, hour, sum(lon1 * w) / sum(w) as lon, sum(lat1 * w) / sum(w) as lat from o group by all), hm as (select person_id, min_by({{'lon': lon1, 'lat': lat1}}, (a, b)) as home from i group by 1),
f as (select hm.person_id, h::int as hour, last_value(g.lon ignore nulls) over w as lon, last_value(g.lat ignore nulls) over w as lat, home from hm cross join (select unnest(range(1, 25)) as h) left join g on g.person_id = hm.person_id and g.hour = h window w as (partition by hm.person_id order by h rows unbounded preceding))"""


@query(f"with {_BINS} select person_id, hour, round(coalesce(lon, home.lon), {R}) as lon, round(coalesce(lat, home.lat), {R}) as lat from f")
def hourly_stays(s: SparkSession, d: str) -> DataFrame:
    """Each trip a stay at its end for as long as it took, on the person's own clock: mean positions of the first day."""
    from pyspark.sql.window import Window

    t0 = F.min("start_s").over(Window.partitionBy("person_id"))
    own = trips(s, d).filter("end_s > start_s").withColumn("t0", t0)
    i = own.select("person_id", F.lit("stay").alias("kind"), (F.col("start_s") - F.col("t0")).cast("double").alias("start_s"), (F.col("end_s") - F.col("t0")).cast("double").alias("end_s"), *[F.col(f"{c}1").alias(f"{c}{k}") for c in ("lon", "lat") for k in "01"])
    return hourly.hourly_positions(i, 24).withColumns({c: F.round(c, R) for c in ("lon", "lat")})


def _people(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select(F.col("c_custkey").alias("person_id"))


@query("select count(*) as people, true as even from customer")
def cohort_split(s: SparkSession, d: str) -> DataFrame:
    """Customers in three cohorts as even as can be."""
    c = agents.cohorts(_people(s, d), ["sip_home_grocery", "sip_hospital", "evac_out_of_zone"]).groupBy("cohort").count()
    return c.agg(F.sum("count").alias("people"), (F.max("count") - F.min("count") <= 1).alias("even"))


@query()
def homes_by_population(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "nation").select(F.col("n_name").alias("county"), F.col("n_nationkey"))
    pop = read(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("population")).join(n, "n_nationkey").select("county", "population")
    h = read(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("place"), "county")
    return agents.homes(_people(s, d), pop, h)


@query()
def simulate_agents(s: SparkSession, d: str) -> DataFrame:
    """Every participant of the trips walked through a day's plan from where their first trip began."""
    first = trips(s, d).groupBy("person_id").agg(F.min_by(F.struct("lon0", "lat0"), F.struct("start_s", "end_s", "trip_id")).alias("h"))
    people = first.select("person_id", F.col("h.lon0").alias("lon"), F.col("h.lat0").alias("lat"), F.floor("h.lon0").cast("string").alias("home_county"))
    p = places(s, d).select(F.col("PLACEKEY").alias("place"), F.trim("top").alias("category"), F.floor("lon").cast("string").alias("county"), "lon", "lat")
    return agents.day_plans(people, p, ["Grocery", "Eating Out", "home"])


# clusters and models over the embeddings
def _emb(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query()
def kmeans_labels(s: SparkSession, d: str) -> DataFrame:
    return cluster.kmeans(_emb(s, d), 5)[0].select("id", "cluster")


_UNROLL = "e as (select vec_id as id, label, cast(embedding as double[]) as x from embeddings), p as (select a.id, a.label as la, b.label as lb, avg(list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(z[1] - z[2], 2)))) as m from e a join e b on a.id <> b.id group by all)"


@query(f"with {_UNROLL}, ab as (select id, la as label, max(m) filter (la = lb) as a, min(m) filter (la <> lb) as b from p group by 1, 2) select id, label, round(coalesce((b - a) / greatest(a, b), 0.0), {R}) as silhouette from ab")
def silhouette_exact(s: SparkSession, d: str) -> DataFrame:
    """Of the given labels, on squared distances."""
    return cluster.silhouette(_emb(s, d), label="label").withColumn("silhouette", F.round("silhouette", R))


@query(f"""with e as (select vec_id as id, label, cast(embedding as double[]) as x from embeddings), u as (select label, unnest(x) as v, generate_subscripts(x, 1) as k from e), c as (select label, list(a order by k) as c from (select label, k, avg(v) as a from u group by all) group by 1),
r as (select e.label as cluster, id, sqrt(list_sum(list_transform(list_zip(x, c), lambda z: pow(z[1] - z[2], 2)))) as dist from e join c using (label)), k as (select *, row_number() over (partition by cluster order by dist, id) as rank from r) select cluster, id, rank, round(dist, {R}) as dist from k where rank <= 5""")
def representatives(s: SparkSession, d: str) -> DataFrame:
    """The five vectors nearest to the mean of each label."""
    e = _emb(s, d).withColumnRenamed("label", "cluster")
    sums = cluster.cluster_sums(e).withColumn("m", F.col("s") / F.col("n"))
    c = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda z: z["m"]).alias("c")).orderBy("cluster").collect()  # one row a label
    n = max(r["cluster"] for r in c) + 1
    at = {r["cluster"]: r["c"] for r in c}
    return cluster.representatives(e, [at.get(i, []) for i in range(n)], 5).withColumn("dist", F.round("dist", R))


@query()
def constrained_kmeans(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d)
    _, centres, _ = cluster.kmeans(e, 4)
    return cluster.constrained(e, centres, -(-e.count() // 4) + 5)


@query()
def k_selection(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(cluster.sweep(_emb(s, d), list(range(2, 16))))


@query()
def gap_statistic(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(cluster.gap_statistic(_emb(s, d), [2, 3], 2))


@query()
def mixture_criteria(s: SparkSession, d: str) -> DataFrame:
    e, _ = cluster.principal_components(_emb(s, d), 4)
    return s.createDataFrame(cluster.mixture_criteria(e.select("id", F.col("pc").alias("x")), [2, 3]))


@query()
def principal_components(s: SparkSession, d: str) -> DataFrame:
    e, _ = cluster.principal_components(_emb(s, d), 3)
    return e.select("id", *[F.col("pc")[i].alias(f"pc{i}") for i in range(3)])


@query()
def classifier_choice(s: SparkSession, d: str) -> DataFrame:
    e = models.split(_emb(s, d).withColumn("label", (F.col("label") < 5).cast("int")), "id")
    return models.choose_classifier(e, names=("logistic", "forest"))


@query(f"""select round(regr_slope(l_extendedprice, l_quantity), {R - 2}) as coefficient, round(regr_r2(l_extendedprice, l_quantity), {R}) as r2 from lineitem""")
def least_squares(s: SparkSession, d: str) -> DataFrame:
    m = models.least_squares(read(s, d, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice")
    return m.filter("term = 'l_quantity'").select(F.round("coefficient", R - 2).alias("coefficient"), F.round("r2", R).alias("r2"))


@query()
def imputed_columns(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("a"), (F.col("o_totalprice") * 2 + F.col("o_custkey")).alias("b"))
    return models.imputed(x, ["a", "b"])


@query("with n as (select label, count(*) as n from embeddings group by 1) select label, f::int as fold, (n // 5 + (f < n % 5)::int)::bigint as count from n, (select unnest(range(0, 5)) as f) where n // 5 + (f < n % 5)::int > 0")
def stratified_folds(s: SparkSession, d: str) -> DataFrame:
    return models.folds(_emb(s, d), "id", 5, by="label").groupBy("label", "fold").count()


@query()
def mmd2_fixed_gamma(s: SparkSession, d: str) -> DataFrame:
    """Between each two labels, over all vectors."""
    return S.mmd2_features(_emb(s, d), 0.5)


_ALL = "e as (select vec_id as id, label, cast(embedding as double[]) as x from embeddings), p as (select a.id as i, b.id as j, a.label as la, b.label as lb, list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(z[1] - z[2], 2))) as d2 from e a join e b on a.id <> b.id)"


@query(f"""with {_ALL}, k as (select i, la = lb as same from p qualify row_number() over (partition by i order by round(sqrt(d2), 9), j) <= 10)
select round((select sqrt(min(d2)) from p where la <> lb) / (select sqrt(max(d2)) from p where la = lb), {R}) as dunn, (select round(avg(m), {R}) from (select avg(same::int) as m from k group by i)) as knn_purity""")
def pair_geometry(s: SparkSession, d: str) -> DataFrame:
    g = pairwise.geometry(_emb(s, d))
    return g.select(F.round("dunn", R).alias("dunn"), F.round("knn_purity", R).alias("knn_purity"))


@query(f"""with {_ALL}, k as (select la, lb, sum(exp(-0.5 * d2)) as s from p group by 1, 2), n as (select label, count(*) as n from e group by 1)
select x.la::int as a, x.lb::int as b, round(aa.s / (na.n * (na.n - 1)) + bb.s / (nb.n * (nb.n - 1)) - 2 * x.s / (na.n * nb.n), {R}) as mmd2
from k x join n na on na.label = x.la join n nb on nb.label = x.lb join k aa on aa.la = x.la and aa.lb = x.la join k bb on bb.la = x.lb and bb.lb = x.lb where x.la < x.lb""")
def mmd2_pairs(s: SparkSession, d: str) -> DataFrame:
    """Exactly, between each two labels, from the test with its draws."""
    return pairwise.mmd_test(_emb(s, d), 99, 0.5).select("a", "b", F.round("mmd2", R).alias("mmd2"))


@query(f"""with {_ALL}, n as (select label, count(*) as m from e group by 1), g as (select count(*) as g, sum(m) as n from n), w as (select sum(d2 / 2 / m) as ssw from p join n on n.label = p.la where la = lb), t as (select sum(d2) / 2 / (select n from g) as sst from p)
select round(((sst - ssw) / (g - 1)) / (ssw / (n - g)), {R}) as f, round((sst - ssw) / sst, {R}) as r2 from w, t, g""")
def permanova_of_distances(s: SparkSession, d: str) -> DataFrame:
    """From a table of distances between every two rows, as any distance may be given."""
    e = _emb(s, d)
    pairs = pairwise.warped_pairs(e, dims=64)  # of one step each: the Euclidean distance
    t = pairwise.permanova_distances(pairs, e.select("id", F.col("label").cast("int").alias("label")), 19)
    return t.select(F.round("f", R).alias("f"), F.round("r2", R).alias("r2"))


@query(f"""with e as (select vec_id as id, label, vec_id % 4 as step, cast(embedding as double[]) as x from embeddings), p as (select a.id, a.step, a.label as la, b.label as lb, avg(list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(z[1] - z[2], 2)))) as m from e a join e b on a.step = b.step and a.id <> b.id group by all),
ab as (select id, step, max(m) filter (la = lb) as a, min(m) filter (la <> lb) as b from p group by 1, 2) select step, count(*) as n, round(avg(coalesce((b - a) / greatest(a, b), 0)), {R}) as silhouette from ab group by 1""")
def separability_per_step(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d).withColumn("step", F.col("id") % 4)
    return cluster.separability(e, "step").withColumn("silhouette", F.round("silhouette", R))


@query(f"""with e as (select vec_id as id, label, cast(embedding as double[]) as x from embeddings), f as (select id, x[1] as x, x[2] as y from e),
r as (select id, 1 / (1 + x * x + y * y) as a, 1 / (1 + pow(x - 1, 2) + pow(y - 1, 2)) as b from f), q as (select id, a / (a + b) as qa, b / (a + b) as qb from r),
t as (select id, qa, qa * qa / sum(qa) over () as ta, qb * qb / sum(qb) over () as tb from q) select id, round(qa, {R}) as q0, round(ta / (ta + tb), {R}) as target0 from t""")
def soft_clusters(s: SparkSession, d: str) -> DataFrame:
    e = _emb(s, d).select("id", F.slice("x", 1, 2).alias("x"))  # two dimensions of their own, compared with two centres
    t = cluster.soft_assignment(e, [[0.0, 0.0], [1.0, 1.0]])
    return t.select("id", F.round(F.col("q")[0], R).alias("q0"), F.round(F.col("target")[0], R).alias("target0"))


_GUESS = "g as (select l_returnflag, avg(l_quantity::double) as gq, avg(l_discount::double * 100) as gd from lineitem group by 1), r as (select l_linestatus, l_quantity::double as q, l_discount::double * 100 as d, gq, gd from lineitem join g using (l_returnflag))"


def _guessed(s: SparkSession, d: str) -> DataFrame:
    l = read(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount").cast("double") * 100).alias("d"))  # noqa: E741
    return l.join(l.groupBy("l_returnflag").agg(F.avg("q").alias("gq"), F.avg("d").alias("gd")), "l_returnflag")


@query(f"with {_GUESS} select 'quantity' as feature, round(sqrt(avg(pow(q - gq, 2))), {R}) as rmse, round(100 * sqrt(avg(pow(q - gq, 2))) / (max(q) - min(q)), {R}) as nrmse_pct, count(*) as n from r union all select 'discount', round(sqrt(avg(pow(d - gd, 2))), {R}), round(100 * sqrt(avg(pow(d - gd, 2))) / (max(d) - min(d)), {R}), count(*) from r")
def reconstruction_errors(s: SparkSession, d: str) -> DataFrame:
    t = features.reconstruction(_guessed(s, d), {"quantity": ("q", "gq"), "discount": ("d", "gd")})
    return t.select("feature", F.round("rmse", R).alias("rmse"), F.round("nrmse_pct", R).alias("nrmse_pct"), "n")


@query(f"with {_GUESS} select l_linestatus, round(avg((q * gq + d * gd) / sqrt((q * q + d * d) * (gq * gq + gd * gd))), {R}) as cosine, count(*) as n from r where q * q + d * d > 0 group by 1")
def reconstruction_cosines(s: SparkSession, d: str) -> DataFrame:
    t = features.step_cosine(_guessed(s, d), "l_linestatus", {"quantity": ("q", "gq"), "discount": ("d", "gd")})
    return t.withColumn("cosine", F.round("cosine", R))


@query()
def warped_sequences(s: SparkSession, d: str) -> DataFrame:
    """The warped distance between the hourly values of every two persons of the events: all hours, by any path."""
    e = read(s, d, "events").select("user_id", (F.col("event_id") % 48).alias("h"), "value").groupBy("user_id", "h").agg(F.avg("value").alias("v"))
    seq = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda p: p["v"]).alias("x"))  # 48 at most
    return pairwise.warped_pairs(seq, "user_id")


@query()
def lm_blocks(s: SparkSession, d: str) -> DataFrame:
    named = read(s, d, "pois").groupBy("PLACEKEY").agg(F.min("LOCATION_NAME").alias("LOCATION_NAME"))
    t = io.place_text(places(s, d).select("PLACEKEY", F.col("top").alias("TOP_CATEGORY"), F.col("sub").alias("SUB_CATEGORY")).join(named, "PLACEKEY"))
    return textprep.blocks(t.withColumn("k", F.pmod(F.xxhash64("PLACEKEY"), F.lit(1_000_000_007))), "k", "concatenated", 64, 100_000_000)


@query()
def place_text_vectors(s: SparkSession, d: str) -> DataFrame:
    return textprep.hashed_vector(read(s, d, "pois").select("PLACEKEY", F.concat_ws(" ", "TOP_CATEGORY", "SUB_CATEGORY").alias("t")), "t", 16).select("PLACEKEY", "embedding")


@query()
def map_features(s: SparkSession, d: str) -> DataFrame:
    """Segment lines as GeoJSON features."""
    lines = stitch.segment_lines(stitch.tagged(trips(s, d), geo.haversine))
    return io.geojson_features(lines, "line", "person_id", "seg_id")


@query(f"with {PLACES} select PLACEKEY from places where lon > -80.5 and lon < -79.5 and lat > 25.7 and lat < 26.6")
def point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    """Places in a box, by the parity of a ring's edges."""
    corners = ((-80.5, 25.7), (-79.5, 25.7), (-79.5, 26.6), (-80.5, 26.6), (-80.5, 25.7))
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in corners])
    return places(s, d).filter(geo.in_ring(F.col("lon"), F.col("lat"), ring)).select("PLACEKEY")
