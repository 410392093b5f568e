"""Queries on plain table work: expressions, filters, joins, aggregates, reshaping, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import columns as K
from trackloom.operators import features as X
from trackloom.plans.registry import query, read
from trackloom.plans.views import LABELS, POI_COUNTS, VISITS, labels, poi_counts, visits

R = 6
_NORM = "coalesce(nullif(trim({c}, ' '), ''), '<null_val>')"
_KEY = f"{_NORM.format(c='TOP_CATEGORY')} || '[sep]' || {_NORM.format(c='SUB_CATEGORY')}"


@query("select PLACEKEY, coalesce(TOP_CATEGORY, '<null_val>') || '[sep]' || coalesce(SUB_CATEGORY, '<null_val>') || '[sep]' || coalesce(LOCATION_NAME, '<null_val>') as concatenated from pois")
def null_fill_concat(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "pois").select("PLACEKEY", K.joined_text(F.col("TOP_CATEGORY"), F.col("SUB_CATEGORY"), F.col("LOCATION_NAME")).alias("concatenated"))


@query(f"select {_KEY} as class_key, count(*) as n from pois group by 1")
def norm_token_key(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "pois").groupBy(K.class_key(F.col("TOP_CATEGORY"), F.col("SUB_CATEGORY")).alias("class_key")).agg(F.count(F.lit(1)).alias("n"))


@query("select vec_id, split_part(label_pair, '[sep]', 1) as category from poi_vectors")
def category_prefix(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "poi_vectors").select("vec_id", K.category(F.col("label_pair")).alias("category"))


@query(f"with {VISITS} select pt_idx // 4 * 4 as bucket, greatest(0, least(142, pt_idx - 1)) as slot, (pt_idx + 7) % 24 as hour, count(*) as n from visits group by all")
def hour_bucket_4h(s: SparkSession, d: str) -> DataFrame:
    p = F.col("pt_idx")
    return visits(s, d).groupBy(K.hour_bucket(p).alias("bucket"), K.time_slot(p).alias("slot"), K.hour_from_start(p, 7).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("with t as (select floor(epoch(ts) - (select min(floor(epoch(ts))) from events))::bigint as t from events) select t, cast(floor(t / 86400) + 1 as int) as day, cast((floor(t / 3600)::bigint + 1) % 24 as int) as hour from t")
def day_hour_clock(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    t = e.join(F.broadcast(e.agg(F.min("s").alias("m")))).select((F.col("s") - F.col("m")).alias("t"))
    return t.select("t", K.day_of_seconds(F.col("t")).alias("day"), K.hour_of_seconds(F.col("t")).alias("hour"))


@query(f"select h as hour, round(sin(h * 2 * pi() / 24), {R}) + 0.0 as sin1, round(cos(h * 2 * pi() / 24), {R}) + 0.0 as cos1, round(sin(h * 4 * pi() / 24), {R}) + 0.0 as sin2, round(cos(h * 4 * pi() / 24), {R}) + 0.0 as cos2 from (select distinct cast(event_id % 24 as int) as h from events)")
def cyclic_hour_features(s: SparkSession, d: str) -> DataFrame:
    h = read(s, d, "events").select((F.col("event_id") % 24).cast("int").alias("hour")).distinct()
    return h.select("hour", *K.cyclic(F.col("hour"), 2)).withColumns({c: F.round(c, R) + 0.0 for c in ("sin1", "cos1", "sin2", "cos2")})


@query(f"select pos, dim, round(case when dim % 2 = 0 then sin(pos * exp(dim // 2 * 2 * -ln(10000.0) / 64)) else cos(pos * exp(dim // 2 * 2 * -ln(10000.0) / 64)) end, {R}) as x from (select unnest(range(0, 143)) as pos), (select unnest(range(0, 64)) as dim)")
def sinusoidal_positions(s: SparkSession, d: str) -> DataFrame:
    grid = s.range(143).withColumnRenamed("id", "pos").withColumn("dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))))
    return grid.select("pos", "dim", F.round(K.sinusoidal(F.col("pos"), F.col("dim"), 64), R).alias("x"))


@query(f"with e as (select vec_id, cast(embedding as double[]) as x from embeddings) select vec_id, list_transform(x, lambda v: round(v / (sqrt(list_dot_product(x, x)) + 1e-12), {R})) as u from e")
def vector_l2_normalize(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select("vec_id", F.transform(K.unit(F.col("embedding")), lambda x: F.round(x, R)).alias("u"))


def _parsed(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, x) written as text and read again. The text has every digit a float needs, and what rounds to zero
    keeps its sign, as in SQL."""
    text = vectors.select("vec_id", F.concat(F.lit("[ "), F.array_join(F.transform("x", lambda v: v.cast("string")), "  ", "null"), F.lit("]")).alias("t"))
    rounded = lambda v: F.round(F.abs(v), 4) * F.signum(v)
    return text.select("vec_id", F.transform(K.parse_vector(F.col("t")), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), v.cast("double")).otherwise(rounded(v.cast("double")))).alias("v"))


@query("select vec_id, list_transform(embedding[1:8], lambda x: round(x::double, 4)) as v from embeddings")
def vector_parse(s: SparkSession, d: str) -> DataFrame:
    return _parsed(read(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("x")))


@query(f"select vec_id, {', '.join(f'round(embedding[{i + 1}]::double, {R}) as z{i}' for i in range(8))} from embeddings")
def vector_to_columns(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select("vec_id", *[F.round(F.col("embedding")[i].cast("double"), R).alias(f"z{i}") for i in range(8)])


@query("select vec_id, list_transform(embedding, lambda x: round(x::double, 4)) as v from embeddings")
def vector_parse_whole(s: SparkSession, d: str) -> DataFrame:
    return _parsed(read(s, d, "embeddings").select("vec_id", F.col("embedding").alias("x")))


@query(f"select vec_id, {', '.join(f'round(embedding[{i + 1}]::double, {R}) as z{i}' for i in range(64))} from embeddings")
def vector_to_columns_whole(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select("vec_id", *[F.round(F.col("embedding")[i].cast("double"), R).alias(f"z{i}") for i in range(64)])


@query("select o_orderpriority as label, try_cast(nullif(regexp_extract(o_orderpriority, '-?[0-9]+', 0), '') as int) as k, (lower(o_orderpriority) like 'evac%')::int as evac from orders group by 1")
def binary_collapse(s: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return read(s, d, "orders").select(p.alias("label")).distinct().select("label", K.first_integer(F.col("label")).alias("k"), K.is_evacuation(F.col("label")).alias("evac"))


@query("select o_orderpriority as label, dense_rank() over (order by o_orderpriority) - 1 as alpha, dense_rank() over (order by first) - 1 as seen from (select o_orderpriority, min(o_orderkey) as first from orders group by 1)")
def label_encodings(s: SparkSession, d: str) -> DataFrame:
    """Numbers of labels in the order of the alphabet, and of first appearance."""
    g = read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.min("o_orderkey").alias("first"))
    return g.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("alpha"), (F.dense_rank().over(Window.orderBy("first")) - 1).alias("seen"))


@query(f"with m as (select l_shipmode, sum(l_extendedprice) as v from (select l_returnflag || l_linestatus as l_shipmode, l_extendedprice from lineitem) group by 1) select l_shipmode as k, round((v - min(v) over ()) / (max(v) over () - min(v) over ()), {R}) as up, round(1 - (v - min(v) over ()) / (max(v) over () - min(v) over ()), {R}) as down from m")
def min_max_scale(s: SparkSession, d: str) -> DataFrame:
    m = read(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    b = F.broadcast(m.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    up = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return m.join(b).select("k", F.round(up, R).alias("up"), F.round(1 - up, R).alias("down"))


@query(f"with m as (select avg(o_totalprice) as a, stddev_pop(o_totalprice) as s from orders) select o_orderkey, round((o_totalprice - a) / s, {R}) as z from orders, m")
def z_score(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    m = F.broadcast(o.agg(F.avg("o_totalprice").alias("a"), F.stddev_pop("o_totalprice").alias("s")))
    return o.join(m).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("a")) / F.col("s"), R).alias("z"))


@query("select s_suppkey, n_name as county, s_acctbal from supplier left join (select * from nation where n_regionkey < 3) on s_nationkey = n_nationkey")
def left_lookup_county(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("county"))
    return read(s, d, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "county", "s_acctbal")


@query("select s_suppkey, case when n_name is null then 'out' else 'in' end as zone from supplier left join (select * from nation where n_regionkey < 3) on s_nationkey = n_nationkey")
def zone_filter(s: SparkSession, d: str) -> DataFrame:
    """In or out of the zone, which is whether there is a county."""
    return left_lookup_county(s, d).select("s_suppkey", F.when(F.col("county").isNull(), "out").otherwise("in").alias("zone"))


@query(f"with {VISITS}, {LABELS} select cluster, count(*) as n from visits join labels using (traj_id) group by 1")
def inner_align_labels(s: SparkSession, d: str) -> DataFrame:
    """Visits with the cluster of their trajectory, whose table must have each trajectory once."""
    return visits(s, d).join(K.assert_unique(labels(s, d), "traj_id"), "traj_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, count(o_orderkey) as n from orders right join customer on o_custkey = c_custkey group by 1")
def right_join_labels(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return o.join(read(s, d, "customer").select("c_custkey"), "c_custkey", "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(f"with {POI_COUNTS}, g as (select distinct cat_name from poi_counts), h as (select unnest(range(0, 97)) as hex_id) select hex_id, cat_name, coalesce(cat_count, 0) as n from h cross join g left join poi_counts using (hex_id, cat_name)")
def grid_outer_align(s: SparkSession, d: str) -> DataFrame:
    p = poi_counts(s, d)
    cats = p.agg(F.array_sort(F.collect_set("cat_name")).alias("cats"))  # the categories, a fixed list
    grid = s.range(97).withColumnRenamed("id", "hex_id").join(F.broadcast(cats)).select("hex_id", F.explode("cats").alias("cat_name"))
    return grid.join(p, ["hex_id", "cat_name"], "left").select("hex_id", "cat_name", F.coalesce("cat_count", F.lit(0)).alias("n"))


_TOPN = f"{POI_COUNTS}, rk as (select hex_id, cat_name, row_number() over (partition by hex_id order by cat_count desc, cat_name) as r from poi_counts)"


@query(f"with {_TOPN} select hex_id, list(cat_name order by r) as labels from rk where r <= 3 group by 1")
def topn_labels_per_cell(s: SparkSession, d: str) -> DataFrame:
    rows = poi_counts(s, d).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("cat_count").cast("int"))))
    return X.top_labels(rows, "hex_id", "cat_name", 3)


def _topn(s: SparkSession, d: str, n: int) -> DataFrame:
    w = Window.partitionBy("hex_id").orderBy(F.desc("cat_count"), "cat_name")
    r = poi_counts(s, d).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return r.groupBy("hex_id").agg(K.ordered_list(F.col("r"), F.col("cat_name")).alias("labels"))


@query(f"with {_TOPN}, t as (select hex_id, list(cat_name order by r) as labels from rk where r <= 3 group by 1) select hex_id, coalesce(labels, ['<null_val>']) as labels from (select unnest(range(0, 97)) as hex_id) left join t using (hex_id)")
def anti_fill_null_label(s: SparkSession, d: str) -> DataFrame:
    """Every cell with its labels, those without any with the null label alone."""
    cells = s.range(97).withColumnRenamed("id", "hex_id")
    return cells.join(_topn(s, d, 3), "hex_id", "left").select("hex_id", F.coalesce("labels", F.array(F.lit(K.NULL_LABEL))).alias("labels"))


@query(f"""with {_TOPN}, t as (select hex_id, list(cat_name order by r) as a from rk where r <= 3 group by 1), g as (select hex_id, list(cat_name order by cat_name) as b from (select *, row_number() over (partition by hex_id order by cat_name) as q from poi_counts) where q <= 6 group by 1),
x as (select coalesce(a, ['<null_val>']) as a, coalesce(b, []) as b from (select unnest(range(0, 97)) as hex_id) left join t using (hex_id) left join g using (hex_id)), o as (select *, len(list_intersect(a, b)) as n from x)
select count(*) as cells, round(avg((n >= 1)::int), {R}) as hit_any, round(avg((n = len(a))::int), {R}) as hit_perfect, round(avg((n >= 1)::int) filter (a <> ['<null_val>']), {R}) as known_any, round(avg((n = len(a))::int) filter (a <> ['<null_val>']), {R}) as known_perfect from o""")
def hit_rate_topn(s: SparkSession, d: str) -> DataFrame:
    """How often the six first categories of a cell by name hold its three most frequent."""
    w = Window.partitionBy("hex_id").orderBy("cat_name")
    g = poi_counts(s, d).withColumn("q", F.row_number().over(w)).filter("q <= 6").groupBy("hex_id").agg(K.ordered_list(F.col("q"), F.col("cat_name")).alias("guess"))
    t = anti_fill_null_label(s, d).join(g, "hex_id", "left").withColumn("guess", F.coalesce("guess", F.array().cast("array<string>")))
    h = X.hit_rates(t, "labels", "guess", K.NULL_LABEL)
    return h.select("cells", *[F.round(c, R).alias(c) for c in ("hit_any", "hit_perfect", "known_any", "known_perfect")])


@query("with c as (select distinct c_mktsegment as s from customer) select a.s as a, b.s as b from c a join c b on a.s < b.s")
def label_pairs_theta(s: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct labels, from the sorted list of them."""
    x = read(s, d, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("all"))  # a handful of segments
    a = x.select("all", F.posexplode("all").alias("i", "a"))
    return a.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))


@query("select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as last_order from orders group by 1")
def dedupe_keep_last(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("select c_mktsegment, n_name, sum(o_totalprice) as v from (select c_mktsegment, n_name, round(o_totalprice)::bigint as o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) group by all")
def inner_chain(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").select("o_custkey", F.round("o_totalprice").cast("bigint").alias("p"))
    c = read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    n = read(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "o_custkey").join(n, "c_nationkey").groupBy("c_mktsegment", "n_name").agg(F.sum("p").alias("v"))


@query(f"with e as (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as k from embeddings), m as (select label, k, avg(v) as a, count(*) as n from e group by all) select label, max(n) as n, list(round(a, {R}) order by k) as mean from m group by 1")
def class_mean_vector(s: SparkSession, d: str) -> DataFrame:
    m = X.mean_vector(read(s, d, "embeddings"), ["label"], "embedding")
    return m.withColumn("mean", F.transform("mean", lambda x: F.round(x, R)))


@query(f"with r as (select vec_id % 37 as cell, label, embedding, count(*) over (partition by vec_id % 37, label)::double as c from embeddings), e as (select cell, c * c as w, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as k from r), m as (select cell, k, sum(w * v) / sum(w) as a, count(*) as n from e group by all) select cell, max(n) as n, list(round(a, {R}) order by k) as mean from m group by 1")
def weighted_cell_vector(s: SparkSession, d: str) -> DataFrame:
    m = X.category_weighted_vector(read(s, d, "embeddings").withColumn("cell", F.col("vec_id") % 37), "cell", "label", "embedding")
    return m.withColumn("mean", F.transform("mean", lambda x: F.round(x, R)))


@query(f"with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all), r as (select *, row_number() over (partition by c_nationkey order by n desc, c_mktsegment) as r from c) select c_nationkey, round(avg(c_acctbal), {R}) as mean, any_value(m) as mode from customer join (select c_nationkey, c_mktsegment as m from r where r = 1) using (c_nationkey) group by 1")
def mode_mean_per_traj(s: SparkSession, d: str) -> DataFrame:
    """Mean balance and most frequent segment (the smallest of equals) of each nation."""
    return read(s, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), R).alias("mean"), F.mode("c_mktsegment", True).alias("mode"))


@query("select o_orderpriority as truth, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def crosstab_confusion(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("truth")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return x.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query(f"select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), {R}) as q25, round(median(l_extendedprice), {R}) as q50, round(quantile_cont(l_extendedprice, 0.95), {R}) as q95 from lineitem group by 1")
def percentiles(s: SparkSession, d: str) -> DataFrame:
    q = read(s, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select("l_returnflag", *[F.round(F.col("q")[i], R).alias(n) for i, n in enumerate(("q25", "q50", "q95"))])


@query(f"select round(corr(l_quantity, l_extendedprice), {R}) as qe, round(corr(l_quantity, l_discount), {R}) as qd, round(corr(l_extendedprice, l_tax), {R}) as et from lineitem")
def correlation(s: SparkSession, d: str) -> DataFrame:
    c = lambda a, b: F.round(F.corr(a, b), R)
    return read(s, d, "lineitem").agg(c("l_quantity", "l_extendedprice").alias("qe"), c("l_quantity", "l_discount").alias("qd"), c("l_extendedprice", "l_tax").alias("et"))


@query("select cast(floor(o_totalprice / 25000) as int) as bin, count(*) as n from orders group by 1")
def histogram(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 25000).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with x as (select c_acctbal as v from customer), h as (select stddev_samp(v) * pow(count(*), -0.2) as h, count(*) as n from x), g as (select unnest(range(0, 20)) * 500.0 as x0) select x0::double as at, round(sum(exp(-0.5 * pow((x0 - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) as density from g, x, h group by x0")
def kernel_density(s: SparkSession, d: str) -> DataFrame:
    """A Gaussian density at 20 places, its width by the number of rows: each row adds to all places in one pass."""
    x = read(s, d, "customer").select(F.col("c_acctbal").alias("v")).filter("v is not null")
    h = F.broadcast(x.agg((F.stddev_samp("v") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"), F.count(F.lit(1)).alias("n")))
    at = F.explode(F.array(*[F.lit(i * 500.0) for i in range(20)])).alias("at")
    k = F.exp(F.pow((F.col("at") - F.col("v")) / F.col("h"), 2) * -0.5)
    return x.join(h).select("v", "h", "n", at).groupBy("at", "h", "n").agg(F.sum(k).alias("s")).select("at", F.round(F.col("s") / (F.col("n") * F.col("h") * 2.5066282746310002), 9).alias("density"))


@query("select o_custkey, bool_or(o_totalprice > 300000) as big, count(distinct o_orderpriority) as kinds, list_sort(list(distinct o_orderstatus)) as seen from orders group by 1")
def any_flag_distinct_set(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 300000).alias("big"), F.countDistinct("o_orderpriority").alias("kinds"), F.array_sort(F.collect_set("o_orderstatus")).alias("seen"))


@query("select o_custkey, string_agg('<tr><td>' || o_orderkey || '</td></tr>', '' order by o_orderdate, o_orderkey) as html from orders group by 1")
def ordered_string_agg(s: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.lit("<tr><td>"), F.col("o_orderkey"), F.lit("</td></tr>"))
    return read(s, d, "orders").groupBy("o_custkey").agg(F.concat_ws("", K.ordered_list(F.struct("o_orderdate", "o_orderkey"), cell)).alias("html"))


@query(f"with {VISITS} select round(count(*) / (count(distinct traj_id) * 143.0), {R}) as coverage from visits")
def coverage_ratio(s: SparkSession, d: str) -> DataFrame:
    return visits(s, d).agg(F.round(F.count(F.lit(1)) / (F.countDistinct("traj_id") * 143.0), R).alias("coverage"))


@query("with m as (select max(n) as most, sum(n) as n from (select o_orderpriority, count(*) as n from orders group by 1)) select round(most / n, 6) as majority from m")
def majority_baseline(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "orders").groupBy("o_orderpriority").count()
    return n.agg(F.round(F.max("count") / F.sum("count"), 6).alias("majority"))


@query("with w as (select user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select user_id, count(*) as n from w where p is null or p <> event_type group by 1")
def consecutive_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Events of each user left when those of the same kind as the one before go."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(s, d, "events").withColumn("p", F.lag("event_type").over(w))
    return e.filter(~F.col("p").eqNullSafe(F.col("event_type"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_HOURLY_WIDE = "select user_id % 50 as person, event_id % 6 + 1 as h, min(value) as v from events group by all"


@query(f"with x as ({_HOURLY_WIDE}) select person, {', '.join(f'max(v) filter (h = {h}) as h{h:03d}' for h in range(1, 7))} from x group by 1")
def pivot_hourly(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "events").groupBy((F.col("user_id") % 50).alias("person"), F.format_string("h%03d", F.col("event_id") % 6 + 1).alias("h")).agg(F.min("value").alias("v"))
    return x.groupBy("person").pivot("h", [f"h{i:03d}" for i in range(1, 7)]).agg(F.max("v"))


@query(f"with x as ({_HOURLY_WIDE}) select person, h::int as pt_idx, v from x where v is not null")
def unpivot_hourly(s: SparkSession, d: str) -> DataFrame:
    wide = pivot_hourly(s, d)
    long = wide.unpivot("person", [c for c in wide.columns if c != "person"], "h", "v").filter("v is not null")
    return long.select("person", F.substring("h", 2, 3).cast("int").alias("pt_idx"), "v")


@query("select distinct c_nationkey as k from customer intersect select distinct s_nationkey from supplier")
def category_intersection(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(s, d, "supplier").select("s_nationkey"))


@query("select distinct p_size as k from part except select distinct p_size from part where p_brand = 'Brand#11'")
def category_difference(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "part")
    return p.select(F.col("p_size").alias("k")).subtract(p.filter("p_brand = 'Brand#11'").select("p_size"))


@query("with r as (select l_orderkey, l_linenumber, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) as a, row_number() over (order by l_extendedprice, l_orderkey, l_linenumber) as b from lineitem) select l_orderkey, l_linenumber, case when a <= 5 then 'top' else 'bottom' end as side from r where a <= 5 or b <= 5")
def best_and_worst(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    side = lambda n, o: x.orderBy(o, "l_orderkey", "l_linenumber").limit(5).select("l_orderkey", "l_linenumber", F.lit(n).alias("side"))
    return side("top", F.desc("l_extendedprice")).unionByName(side("bottom", F.asc("l_extendedprice")))


def _mix(x: str) -> str:
    return f"((({x}) % 2147483647 * 48271 + 12346) % 2147483647 * 16807 % 2147483647)"


@query(f"with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {_mix('o_orderkey')}, o_orderkey) as r from orders) select o_orderkey, o_orderpriority from r where r <= 20")
def balanced_sample(s: SparkSession, d: str) -> DataFrame:
    """Twenty orders of each priority, drawn by a mixed number."""
    w = Window.partitionBy("o_orderpriority").orderBy(K.mixer(F.col("o_orderkey")), "o_orderkey")
    return read(s, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 20").select("o_orderkey", "o_orderpriority")


@query(f"select case when {_mix('o_custkey')} % 100 < 70 then 'train' when {_mix('o_custkey')} % 100 < 85 then 'valid' else 'test' end as part, count(*) as n from orders group by 1")
def split_by_group(s: SparkSession, d: str) -> DataFrame:
    """70, 15 and 15 of 100 customers: all orders of one fall into one part."""
    m = K.mixer(F.col("o_custkey")) % 100
    return read(s, d, "orders").groupBy(F.when(m < 70, "train").when(m < 85, "valid").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with e as (select vec_id, cast(embedding as double[]) as x from embeddings), t as (select vec_id, unnest(x) as v, generate_subscripts(x, 1) - 1 as i from e), r as (select *, row_number() over (partition by vec_id order by v desc, i) as r from t) select vec_id, list(i::int order by r) as places, round(any_value(v) filter (r = 1), {R}) as best from r where r <= 5 group by 1")
def vector_top_k(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "embeddings").select("vec_id", K.top_k(F.transform("embedding", lambda x: x.cast("double")), 5).alias("t"))
    return t.select("vec_id", F.transform("t", lambda x: x["i"].cast("int")).alias("places"), F.round(F.col("t")[0]["p"], R).alias("best"))


@query("with s as (select user_id, event_id % 200 as step, value from events), m as (select user_id, greatest(0, least(142, step - 1))::int as slot, avg(value) as v from s group by all), l as (select user_id, max(slot) as last from m group by 1) select user_id, g.slot::int as slot, (g.slot % 24)::int as hour, g.slot > last as padded, round(v, 6) as value, v is not null as value_observed from l cross join (select unnest(range(0, 143)) as slot) g left join m using (user_id, slot)")
def masked_sequences(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("user_id", (F.col("event_id") % 200).alias("step"), "value")
    return X.masked_sequences(e, "user_id", "step", ["value"]).withColumn("value", F.round("value", R))


@query(f"select 'value' as dim, round(avg(v), {R}) as mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-6)), {R}) as std from (select user_id, greatest(0, least(142, event_id % 200 - 1)) as slot, avg(value) as v from events group by all)")
def masked_feature_stats(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("user_id", (F.col("event_id") % 200).alias("step"), "value")
    return X.masked_stats(X.masked_sequences(e, "user_id", "step", ["value"]), ["value"]).select("dim", F.round("mean", R).alias("mean"), F.round("std", R).alias("std"))


@query(f"""with m as (select user_id, greatest(0, least(142, event_id % 200 - 1))::int as slot, avg(value) as v from events group by all), g as (select slot % 24 as hour, avg(v) as guess from m group by 1), e as (select v - guess as e from m join g on g.hour = m.slot % 24 where v is not null)
select round(avg(e * e), {R}) as mse, round(avg(case when abs(e) <= 1 then e * e / 2 else abs(e) - 0.5 end), {R}) as huber, round(sqrt(avg(e * e)), {R}) as rmse, count(*) as n from e""")
def hour_mean_error(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("user_id", (F.col("event_id") % 200).alias("step"), "value")
    t = X.masked_error(X.hour_mean_baseline(X.masked_sequences(e, "user_id", "step", ["value"]), "value"), "value", "guess")
    return t.select(*[F.round(c, R).alias(c) for c in ("mse", "huber", "rmse")], "n")


@query()
def sequence_latents(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("user_id", (F.col("event_id") % 200).alias("step"), "value")
    seq = X.masked_sequences(e, "user_id", "step", ["value"])
    return X.sequence_latent(X.standardized(seq, ["value"], X.masked_stats(seq, ["value"])), "user_id", ["value"])
