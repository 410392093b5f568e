"""Queries on the composition of visited cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import composition as C
from trackloom.plans.registry import query, read
from trackloom.plans.views import LABELS, POI_COUNTS, VISITS, labels, poi_counts, visits

R = 6
BASE = f"""{VISITS}, {LABELS}, {POI_COUNTS},
active as (select distinct pt_idx, hex_id from visits),
gn as (select pt_idx, cat_name, sum(cat_count) as n from active join poi_counts using (hex_id) group by all),
base as (select *, n / sum(n) over (partition by pt_idx) as share from gn)"""
UNIQUE = f"""{BASE}, cc as (select distinct cluster, pt_idx, hex_id from visits join labels using (traj_id) where hex_id in (select hex_id from poi_counts)),
cs as (select cluster, pt_idx, count(*) as cells from cc group by all),
cn as (select cluster, pt_idx, cat_name, sum(cat_count) as n from cc join poi_counts using (hex_id) group by all),
cu as (select cluster, pt_idx, cat_name, n, cells, case when cells >= 3 then n / sum(n) over (partition by cluster, pt_idx) end as share from cn join cs using (cluster, pt_idx))"""
DEVICE = f"""{BASE}, own as (select hex_id, cat_name, cat_count / sum(cat_count) over (partition by hex_id) as share from poi_counts),
dv as (select cluster, pt_idx, hex_id from visits join labels using (traj_id) where hex_id in (select hex_id from poi_counts)),
dn as (select cluster, pt_idx, count(*) as n from dv group by all),
dd as (select cluster, pt_idx, cat_name, sum(share) / any_value(n) as share from dv join own using (hex_id) join dn using (cluster, pt_idx) group by cluster, pt_idx, cat_name)"""


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in cols})


def _base(s: SparkSession, d: str) -> DataFrame:
    return C.global_baseline(visits(s, d), poi_counts(s, d))


def _unique(s: SparkSession, d: str) -> DataFrame:
    return C.cluster_unique(visits(s, d), labels(s, d), poi_counts(s, d), 3)


@query(f"with {BASE} select cat_name, round(sum(share), {R}) as total from base group by 1 order by round(sum(share), 9) desc, cat_name limit 15")
def global_composition_topk(s: SparkSession, d: str) -> DataFrame:
    return _r(C.top_categories(_base(s, d), 15), "total")


@query(f"with {BASE} select pt_idx, count(*) as cells from active group by 1")
def active_cells_per_hour(s: SparkSession, d: str) -> DataFrame:
    return C.active_cells(visits(s, d)).groupBy("pt_idx").agg(F.count(F.lit(1)).alias("cells"))


@query(f"with {BASE} select pt_idx, cat_name, n, round(share, {R}) as share from base")
def global_baseline(s: SparkSession, d: str) -> DataFrame:
    return _r(_base(s, d), "share")


@query(f"with {POI_COUNTS} select hex_id, coalesce(sum(cat_count) filter (cat_name = 'Brand#11'), 0) as b11, coalesce(sum(cat_count) filter (cat_name = 'Brand#12'), 0) as b12, coalesce(sum(cat_count) filter (cat_name = 'absent'), 0) as absent from poi_counts group by 1")
def poi_pivot_counts(s: SparkSession, d: str) -> DataFrame:
    p = poi_counts(s, d).groupBy("hex_id").pivot("cat_name", ["Brand#11", "Brand#12", "absent"]).sum("cat_count").fillna(0)
    return p.withColumnsRenamed({"Brand#11": "b11", "Brand#12": "b12"})


@query(f"with {POI_COUNTS} select hex_id, cat_name, sum(cat_count * cat_count) as n from poi_counts group by all")
def poi_counts_squared_kernel(s: SparkSession, d: str) -> DataFrame:
    """Counts noted on each place row and summed again: the square of the count."""
    c = poi_counts(s, d)
    rows = c.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("cat_count").cast("int"))))
    return rows.groupBy("hex_id", "cat_name").agg(F.sum("cat_count").alias("n"))


@query(f"with {UNIQUE} select cluster, pt_idx, cat_name, n, cells, round(share, {R}) as share from cu")
def cluster_comp_unique(s: SparkSession, d: str) -> DataFrame:
    return _r(_unique(s, d), "share")


@query(f"with {DEVICE} select cluster, pt_idx, cat_name, round(share, {R}) as share from dd")
def cluster_comp_device(s: SparkSession, d: str) -> DataFrame:
    return _r(C.cluster_device(visits(s, d), labels(s, d), poi_counts(s, d)), "share")


@query(f"with {BASE} select cluster, pt_idx, cat_name, sum(cat_count) as n from visits join labels using (traj_id) join poi_counts using (hex_id) group by all")
def cluster_device_counts(s: SparkSession, d: str) -> DataFrame:
    return C.device_counts(visits(s, d), labels(s, d), poi_counts(s, d))


_MASS = "mass as (select cluster, count(distinct traj_id) as devices from visits join labels using (traj_id) group by 1)"


@query(f"with {BASE}, {_MASS} select cluster, devices, round(devices / sum(devices) over (), {R}) as alpha from mass")
def device_mass_share(s: SparkSession, d: str) -> DataFrame:
    return _r(C.device_mass(visits(s, d), labels(s, d)), "alpha")


@query(f"with {UNIQUE}, {_MASS} select pt_idx, cat_name, round(sum(share * devices) / sum(devices), {R}) as share from cu join mass using (cluster) where share is not null group by 1, 2")
def mass_weighted_mix(s: SparkSession, d: str) -> DataFrame:
    return _r(C.mass_weighted_mix(_unique(s, d), C.device_mass(visits(s, d), labels(s, d))), "share")


@query(f"""with {UNIQUE} select cluster, pt_idx, cat_name, round(case when coalesce(b.share, 0) <> 0 then (u.share - b.share) / b.share else 0 end, {R}) as rel,
round(case when coalesce(b.share, 0) <> 0 then u.share / b.share else 1 end, {R}) as ratio, round(ln((u.share + 1e-9) / (coalesce(b.share, 0) + 1e-9)), {R}) as log, round(100 * (u.share - coalesce(b.share, 0)), {R}) as points
from cu u left join base b using (pt_idx, cat_name)""")
def deviation_rel_ratio_log(s: SparkSession, d: str) -> DataFrame:
    df, g = _unique(s, d), _base(s, d)
    names = ["rel", "ratio", "log", "points"]
    out = df.join(g.select("pt_idx", "cat_name", F.col("share").alias("base")), ["pt_idx", "cat_name"], "left")
    for m in names:
        b = F.coalesce("base", F.lit(0.0))
        out = out.withColumn(m, {"rel": F.when(b != 0, (F.col("share") - b) / b).otherwise(0.0), "ratio": F.when(b != 0, F.col("share") / b).otherwise(1.0), "log": F.log((F.col("share") + 1e-9) / (b + 1e-9)), "points": 100 * (F.col("share") - b)}[m])
    return _r(out.select("cluster", "pt_idx", "cat_name", *names), *names)


@query(f"with {UNIQUE} select cluster, pt_idx, cat_name, round(100 * (share - avg(share) over (partition by pt_idx, cat_name)), {R}) as centred from cu")
def delta_pp_centered(s: SparkSession, d: str) -> DataFrame:
    return _r(C.centred_points(_unique(s, d)).select("cluster", "pt_idx", "cat_name", "centred"), "centred")


@query(f"""with {BASE}, cd as (select cluster, pt_idx, cat_name, sum(cat_count) as n from visits join labels using (traj_id) join poi_counts using (hex_id) group by all)
select pt_idx, cluster, cat_name, coalesce(n, 0) as n from (select distinct pt_idx from cd) cross join (select distinct cluster from cd) cross join (select distinct cat_name from cd) left join cd using (pt_idx, cluster, cat_name)""")
def count_tensor_grid(s: SparkSession, d: str) -> DataFrame:
    return C.full_grid(C.device_counts(visits(s, d), labels(s, d), poi_counts(s, d)), ["pt_idx", "cluster", "cat_name"], "n")


@query(f"""with {UNIQUE}, dl as (select cluster, cat_name, 100 * (u.share - b.share) as d from cu u join base b using (pt_idx, cat_name) where u.share is not null)
select cluster, cat_name, round(sqrt(sum(d * d)), {R}) as l2_sum, round(sqrt(avg(d * d)), {R}) as l2_mean, round(max(abs(d)), {R}) as maxabs, count(*) as hours from dl group by all""")
def stat_l2_maxabs(s: SparkSession, d: str) -> DataFrame:
    g = _base(s, d).select("pt_idx", "cat_name", F.col("share").alias("base"))
    dl = _unique(s, d).join(g, ["pt_idx", "cat_name"]).withColumn("d", 100 * (F.col("share") - F.col("base")))
    return _r(C.stat_over_time(dl, ["cluster", "cat_name"]), "l2_sum", "l2_mean", "maxabs")


@query(f"with {BASE} select cat_name, sum(cat_count) as n from poi_counts where hex_id in (select hex_id from visits) group by 1 order by n desc, cat_name limit 10")
def topk_by_poi_mass(s: SparkSession, d: str) -> DataFrame:
    return poi_counts(s, d).join(visits(s, d).select("hex_id"), "hex_id", "left_semi").groupBy("cat_name").agg(F.sum("cat_count").alias("n")).orderBy(F.desc("n"), "cat_name").limit(10)


@query(f"with {BASE}, t as (select cat_name, round(sum(share), 9) as total from base group by 1), r as (select *, row_number() over (order by total desc, cat_name) as r from t) select cat_name, round(total, {R}) as total from r where r between 2 and 5")
def topk_without_largest(s: SparkSession, d: str) -> DataFrame:
    """The categories behind the largest."""
    first = C.top_categories(_base(s, d), 5)
    return _r(first.orderBy(F.desc(F.round("total", 9)), "cat_name").offset(1), "total")
