"""Queries on series and tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import composition as C
from trackloom.operators import statistics as S
from trackloom.operators import timeseries as T
from trackloom.plans.composition_queries import BASE
from trackloom.plans.registry import query, read
from trackloom.plans.views import labels, poi_counts, visits

R = 6
#: An hourly series of each cluster, with holes where the number of visits ends in 3.
_HOURLY = f"{BASE}, hv as (select cluster, pt_idx, count(*) as n from visits join labels using (traj_id) group by all), series as (select cluster, pt_idx, case when n % 10 <> 3 then n::double end as v from hv)"


def _series(s: SparkSession, d: str) -> DataFrame:
    n = visits(s, d).join(labels(s, d), "traj_id").groupBy("cluster", "pt_idx").agg(F.count(F.lit(1)).alias("n"))
    return n.select("cluster", "pt_idx", F.when(F.col("n") % 10 != 3, F.col("n").cast("double")).alias("v"))


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in cols})


_FILLED = f"""{_HOURLY}, m as (select *, last_value(case when v is not null then pt_idx end ignore nulls) over a as ta, last_value(v ignore nulls) over a as va, first_value(case when v is not null then pt_idx end ignore nulls) over b as tb, first_value(v ignore nulls) over b as vb from series
window a as (partition by cluster order by pt_idx rows between unbounded preceding and current row), b as (partition by cluster order by pt_idx rows between current row and unbounded following)),
filled as (select cluster, pt_idx, case when va is null then vb when vb is null or ta = tb then va else va + (vb - va) * (pt_idx - ta) / (tb - ta) end as v from m)"""


@query(f"with {_FILLED} select cluster, pt_idx, round(v, {R}) as v from filled")
def linear_interpolate(s: SparkSession, d: str) -> DataFrame:
    return _r(T.interpolated(_series(s, d), "cluster", "pt_idx", "v"), "v")


@query(f"""with recursive {_HOURLY}, o as (select cluster, pt_idx, v, row_number() over (partition by cluster order by pt_idx) as r from series where v is not null),
e as (select cluster, pt_idx, v, r, v as y from o where r = 1 union all select o.cluster, o.pt_idx, o.v, o.r, e.y * (1 - 2.0::double / 16) + o.v * (2.0::double / 16) from e join o on o.cluster = e.cluster and o.r = e.r + 1)
select cluster, pt_idx, v, round(y, {R}) as smooth from e""")
def ema_smooth(s: SparkSession, d: str) -> DataFrame:
    return _r(T.smoothed(_series(s, d), "cluster", "pt_idx", "v", 15), "smooth")


def _sg() -> str:
    rows = ", ".join("[" + ", ".join(repr(float(x)) for x in T.savgol_weights(11, 2, i)) + "]" for i in range(11))
    return f"[{rows}]"


@query(f"""with {_FILLED}, n as (select *, row_number() over (partition by cluster order by pt_idx) - 1 as r, count(*) over (partition by cluster) as n from filled),
g as (select *, greatest(0, least(r - 5, n - 11)) as b from n), w as (select a.cluster, a.pt_idx, a.r - a.b as i, c.r - a.b as k, c.v from g a join g c on c.cluster = a.cluster and c.r between a.b and a.b + 10)
select cluster, pt_idx, round(sum(v * {_sg()}[i + 1][k + 1]), {R}) as smooth from w group by cluster, pt_idx""")
def savgol_smooth(s: SparkSession, d: str) -> DataFrame:
    filled = T.interpolated(_series(s, d), "cluster", "pt_idx", "v")
    return _r(T.savgol(filled, "cluster", "pt_idx", "v").select("cluster", "pt_idx", "smooth"), "smooth")


@query()
def loess_smooth(s: SparkSession, d: str) -> DataFrame:
    return T.loess(_series(s, d), "cluster", "pt_idx", "v")


@query(f"""with {_FILLED}, p as (select unnest([6.0, 8.0, 12.0, 24.0, 48.0]) as period), x as (select cluster, period, sum(v * cos(2 * pi() * pt_idx / period)) as c, sum(v * sin(2 * pi() * pt_idx / period)) as s, count(*) as n from filled, p group by all)
select cluster, period::double as period, round((c * c + s * s) / n, 4) as power from x""")
def dft_power_by_period(s: SparkSession, d: str) -> DataFrame:
    filled = T.interpolated(_series(s, d), "cluster", "pt_idx", "v")
    return T.dft_power(filled, "cluster", "pt_idx", "v", [6, 8, 12, 24, 48]).withColumn("power", F.round("power", 4))


@query()
def spectrum_periodogram(s: SparkSession, d: str) -> DataFrame:
    return T.spectrum(_series(s, d), "cluster", "pt_idx", "v", whiten=True)


@query()
def spectrum_welch(s: SparkSession, d: str) -> DataFrame:
    return T.spectrum(_series(s, d), "cluster", "pt_idx", "v", "welch", segment=48)


@query(f"with {BASE} select cat_name, round(var_samp(share), 9) as variance from base group by 1 order by round(var_samp(share), 9) desc, cat_name limit 3")
def most_dynamic_category(s: SparkSession, d: str) -> DataFrame:
    base = C.global_baseline(visits(s, d), poi_counts(s, d))
    return T.most_dynamic(base, "cat_name", "share", 3).withColumn("variance", F.round("variance", 9))


def _mix(x: str) -> str:
    return f"((({x}) % 2147483647 * 48271 + 12346) % 2147483647 * 16807 % 2147483647)"


#: Permutations of the registered tests: p can be as small as 1/200.
PERMUTATIONS = 199


def _perm(n: int) -> str:
    return f"""{BASE}, fv as (select traj_id, pt_idx, min(hex_id) as hex_id from visits group by all),
obs0 as (select 0 as b, cluster, pt_idx, hex_id from fv join labels using (traj_id)),
dr as (select b, traj_id, pt_idx, cluster, {_mix('traj_id * 7919 + pt_idx * 104729 + b * 15485863')} as draw from fv join labels using (traj_id), (select unnest(range(1, {n + 1})) as b)),
rk as (select *, row_number() over (partition by b, pt_idx order by traj_id) as i, row_number() over (partition by b, pt_idx order by draw, traj_id) as j from dr),
pm as (select a.b, a.traj_id, a.pt_idx, c.cluster from rk a join rk c on a.b = c.b and a.pt_idx = c.pt_idx and a.i = c.j)"""


@query(f"with {_perm(5)} select b::int as b, traj_id, pt_idx, cluster from pm")
def permute_within_time(s: SparkSession, d: str) -> DataFrame:
    v = visits(s, d).groupBy("traj_id", "pt_idx").agg(F.min("hex_id").alias("hex_id"))
    return S.permuted_within_time(v.join(labels(s, d), "traj_id"), 5)


_STAT = """{p}c as (select distinct {b}, cluster, pt_idx, hex_id from {src} where hex_id in (select hex_id from poi_counts)),
{p}v as (select {b}, cluster, pt_idx from {p}c group by all having count(*) >= 2),
{p}n as (select {b}, cluster, pt_idx, cat_name, sum(cat_count) as n from {p}c join poi_counts using (hex_id) group by all),
{p}s as (select *, n / sum(n) over (partition by {b}, cluster, pt_idx) as share from {p}n),
{p}t as (select {p}v.{b}, {p}v.cluster, base.cat_name, round(sqrt(avg(pow(100 * (coalesce({p}s.share, 0) - base.share), 2))), 9) as t from {p}v join base using (pt_idx) left join {p}s on {p}s.{b} = {p}v.{b} and {p}s.cluster = {p}v.cluster and {p}s.pt_idx = {p}v.pt_idx and {p}s.cat_name = base.cat_name group by all)"""


_DRAWN = f"{_perm(PERMUTATIONS)}, ph as (select b, cluster, pt_idx, hex_id from obs0 union all select b, cluster, pt_idx, hex_id from pm join fv using (traj_id, pt_idx)), {_STAT.format(p='q', b='b', src='ph')}"


@query(f"""with {_DRAWN}, o as (select * from qt where b = 0), r as (select * from qt where b > 0)
select o.cluster, o.cat_name, round(any_value(o.t), {R}) as observed, coalesce(sum((r.t >= o.t)::int), 0)::int as exceed, round((coalesce(sum((r.t >= o.t)::int), 0) + 1) / {PERMUTATIONS + 1}.0, {R}) as p from o left join r using (cluster, cat_name) group by 1, 2""")
def perm_test_composition(s: SparkSession, d: str) -> DataFrame:
    t = S.permutation_test(visits(s, d), labels(s, d), poi_counts(s, d), PERMUTATIONS, min_hex=2)
    return _r(t, "observed", "p").withColumn("exceed", F.col("exceed").cast("int"))


_P = "ps as (select l_orderkey % 40 as id, round(avg(l_discount) * 0.4 - 0.01 + (l_orderkey % 40) * 0.0005, 6) as p from lineitem group by 1)"


def _pvalues(s: SparkSession, d: str) -> DataFrame:
    i = F.col("l_orderkey") % 40
    return read(s, d, "lineitem").groupBy(i.alias("id")).agg(F.round(F.avg("l_discount") * 0.4 - 0.01 + F.first(i) * 0.0005, 6).alias("p"))


@query(f"with {_P}, r as (select *, row_number() over (order by p, id) as r, count(*) over () as m from ps) select id, p, round(least(1, min(p * m / r) over (order by r rows between current row and unbounded following)), {R}) as q from r")
def bh_qvalues(s: SparkSession, d: str) -> DataFrame:
    return _r(S.benjamini_hochberg(_pvalues(s, d), tie="id"), "q")


@query(f"""with {_P}, nul as (select o_orderkey % 200 as b, o_custkey % 40 as id, max(o_totalprice) / 1e6 as t from orders group by 1, 2), top as (select b, max(t) as top from nul group by 1), obs as (select id, 0.3 + p * 20 as observed from ps)
select id, round(observed, {R}) as observed, round((select count(*) from top where top >= observed) / (select count(*) from top), {R}) as p_fwer from obs""")
def fwer_max_stat(s: SparkSession, d: str) -> DataFrame:
    nul = read(s, d, "orders").groupBy((F.col("o_orderkey") % 200).alias("b"), (F.col("o_custkey") % 40).alias("id")).agg((F.max("o_totalprice") / 1e6).alias("t"))
    obs = _pvalues(s, d).select("id", (0.3 + F.col("p") * 20).alias("observed"))
    return _r(S.max_statistic(obs, nul, ["id"]), "observed", "p_fwer")


@query(f"""with x as (select (epoch(l_shipdate) / 86400)::int as day, sum((l_returnflag = 'R')::int)::double as k, count(*)::double as n from lineitem group by 1)
select day, round((k / n + 1.95996 * 1.95996 / (2 * n) - 1.95996 * sqrt(k / n * (1 - k / n) / n + 1.95996 * 1.95996 / (4 * n * n))) / (1 + 1.95996 * 1.95996 / n), {R}) as lo, round((k / n + 1.95996 * 1.95996 / (2 * n) + 1.95996 * sqrt(k / n * (1 - k / n) / n + 1.95996 * 1.95996 / (4 * n * n))) / (1 + 1.95996 * 1.95996 / n), {R}) as hi from x""")
def wilson_ci(s: SparkSession, d: str) -> DataFrame:
    x = read(s, d, "lineitem").groupBy(F.unix_date(F.col("l_shipdate").cast("date")).alias("day")).agg(F.sum((F.col("l_returnflag") == "R").cast("int")).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return x.select("day", F.round(lo, R).alias("lo"), F.round(hi, R).alias("hi"))


@query(f"""with x as (select o_orderpriority as g, sum((o_orderstatus = 'F' and o_totalprice > 150000)::int)::double as tp, sum((o_orderstatus <> 'F' and o_totalprice > 150000)::int)::double as fp, sum((o_orderstatus = 'F' and o_totalprice <= 150000)::int)::double as fn, sum((o_orderstatus <> 'F' and o_totalprice <= 150000)::int)::double as tn from orders group by 1)
select g, round((tp + tn) / (tp + fp + fn + tn), {R}) as accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, {R}) as balanced, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), {R}) as mcc, round(tp / (tp + fp), {R}) as precision, round(tp / (tp + fn), {R}) as recall, round(2 * tp / (2 * tp + fp + fn), {R}) as f1 from x""")
def mcc_bal_acc(s: SparkSession, d: str) -> DataFrame:
    is_f, said = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000
    n = lambda c: F.sum(c.cast("int"))
    x = read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(n(is_f & said).alias("tp"), n(~is_f & said).alias("fp"), n(is_f & ~said).alias("fn"), n(~is_f & ~said).alias("tn"))
    m = S.binary_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return x.select("g", *[F.round(v, R).alias(k) for k, v in m.items()])


@query(f"with {BASE}, l as (select hex_id, cat_name, ln((cat_count + 1e-9) / sum(cat_count + 1e-9) over (partition by hex_id)) as x from poi_counts) select hex_id, cat_name, round(x - avg(x) over (partition by hex_id), {R}) as clr from l")
def clr_transform(s: SparkSession, d: str) -> DataFrame:
    return _r(S.clr(poi_counts(s, d), ["hex_id"], "cat_count").select("hex_id", "cat_name", "clr"), "clr")


@query(f"""with e as (select vec_id as id, label, cast(embedding as double[]) as x from embeddings), p as (select a.id as i, b.id as j, a.label as la, b.label as lb, list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(z[1] - z[2], 2))) as d2 from e a join e b on a.id < b.id),
n as (select label, count(*) as m from e group by 1), t as (select sum(d2) / (select count(*) from e) as sst from p), w as (select sum(d2 / m) as ssw from p join n on p.la = n.label where la = lb)
select 0 as b, round(((sst - ssw) / ((select count(*) from n) - 1)) / (ssw / ((select count(*) from e) - (select count(*) from n))), {R}) as f, round((sst - ssw) / sst, {R}) as r2 from t, w""")
def permanova_f(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    return _r(S.permanova_vectors(e), "f", "r2")


@query()
def permanova_p(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    t = S.permanova_vectors(e, 19)
    own = t.filter("b = 0").select(F.col("f").alias("own"), F.col("r2").alias("explained"))
    return t.filter("b > 0").join(F.broadcast(own)).groupBy("own", "explained").agg(((F.sum((F.col("f") >= F.col("own")).cast("int")) + 1) / 20).alias("p"))


def _poisson(u: str) -> str:
    """How many of the cumulated Poisson(1) probabilities a number in 0..1 exceeds."""
    term = total = math.exp(-1)
    parts = []
    for k in range(1, 9):
        parts.append(f"({u} > {total!r})::int")
        term /= k
        total += term
    return " + ".join(parts)


@query(f"""with d as (select o_totalprice, b, ((((o_orderkey * 7919 + b * 15485863) % 2147483647 * 48271 + 61726) % 2147483647 * 16807 % 2147483647) + 0.5) / 2147483647.0 as u from orders, (select unnest(range(1, 101)) as b)),
m as (select b, sum(({_poisson("u")}) * o_totalprice) / sum({_poisson("u")}) as mean from d group by 1)
select round(quantile_cont(mean, 0.025), 4) as lo, round(quantile_cont(mean, 0.975), 4) as hi from m""")
def bootstrap_mean_ci(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    b = S.bootstrap(rows, 100, 5, F.col("o_totalprice"), F.lit(1.0))
    return b.select((F.col("s0") / F.col("s1")).alias("mean")).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).select(F.round(F.col("ci")[0], 4).alias("lo"), F.round(F.col("ci")[1], 4).alias("hi"))


@query(f"""with {_DRAWN}, t as (select b, cluster, round(sqrt(avg(t * t)), 8) as t from qt group by all), o as (select * from t where b = 0), r as (select * from t where b > 0)
select o.cluster, round(any_value(o.t), {R}) as observed, round((coalesce(sum((r.t >= o.t)::int), 0) + 1) / {PERMUTATIONS + 1}.0, {R}) as p from o left join r using (cluster) group by 1""")
def omnibus_composition(s: SparkSession, d: str) -> DataFrame:
    return _r(S.omnibus_test(visits(s, d), labels(s, d), poi_counts(s, d), PERMUTATIONS, 2), "observed", "p")


@query(f"""with {_DRAWN}, cats as (select distinct cat_name from poi_counts), full_ as (select qv.b, qv.cluster, qv.pt_idx, cats.cat_name, coalesce(qs.share, 0) as share from qv cross join cats left join qs on qs.b = qv.b and qs.cluster = qv.cluster and qs.pt_idx = qv.pt_idx and qs.cat_name = cats.cat_name),
t as (select x.b, x.cluster as a, y.cluster as b_cluster, round(sqrt(avg(pow(100 * (x.share - y.share), 2))), 9) as t from full_ x join full_ y on x.b = y.b and x.pt_idx = y.pt_idx and x.cat_name = y.cat_name and x.cluster < y.cluster group by all),
o as (select * from t where b = 0), r as (select * from t where b > 0),
p as (select o.a, o.b_cluster, any_value(o.t) as observed, (coalesce(sum((r.t >= o.t)::int), 0) + 1) / {PERMUTATIONS + 1}.0 as p from o left join r using (a, b_cluster) group by 1, 2),
k as (select *, row_number() over (order by p, a, b_cluster) as i, count(*) over () as m from p)
select a, b_cluster, round(observed, {R}) as observed, round(p, {R}) as p, round(least(1, min(p * m / i) over (order by i rows between current row and unbounded following)), {R}) as q from k""")
def contrasts_composition(s: SparkSession, d: str) -> DataFrame:
    return _r(S.pairwise_contrasts(visits(s, d), labels(s, d), poi_counts(s, d), PERMUTATIONS, min_hex=2), "observed", "p", "q")


@query(f"""with {_perm(PERMUTATIONS)}, lab as (select 0 as b, traj_id, pt_idx, cluster from fv join labels using (traj_id) union all select b, traj_id, pt_idx, cluster from pm),
n as (select b, cluster, pt_idx, cat_name, sum(cat_count) as n from lab join visits using (traj_id, pt_idx) join poi_counts using (hex_id) group by all),
ok as (select b, cluster, pt_idx, sum(n) as whole from n group by all), cats as (select distinct cat_name from poi_counts),
sh as (select ok.b, ok.cluster, ok.pt_idx, cats.cat_name, coalesce(n.n, 0) / whole as share from ok cross join cats left join n on n.b = ok.b and n.cluster = ok.cluster and n.pt_idx = ok.pt_idx and n.cat_name = cats.cat_name),
dv as (select b, cluster, cat_name, share - avg(share) over (partition by b, pt_idx, cat_name) as d from sh),
t as (select b, cluster, cat_name, round(sqrt(sum(d * d)), 9) as t, count(*) as hours from dv group by all), o as (select * from t where b = 0), r as (select * from t where b > 0)
select o.cluster, o.cat_name, any_value(o.hours) as hours, round(any_value(o.t), {R}) as observed, round((coalesce(sum((r.t >= o.t)::int), 0) + 1) / {PERMUTATIONS + 1}.0, {R}) as p from o left join r using (cluster, cat_name) group by 1, 2""")
def perm_test_centred_counts(s: SparkSession, d: str) -> DataFrame:
    return _r(S.centred_count_test(visits(s, d), labels(s, d), poi_counts(s, d), PERMUTATIONS), "observed", "p")
