"""Shares of place categories by hour: the global baseline, three kernels of a cluster's composition, deviations, top-k.

The kernels differ in what they weigh: `unique` takes each visited cell once a cluster and hour, `device` averages the
shares of the devices' cells, `counts` adds up the cells' counts for every device there. All work on long tables
(hour, category, share); a cell without places has no shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIME, CAT = "pt_idx", "cat_name"


def shares(counts: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """Adds share: value over its sum by the keys; null where the sum is 0."""
    whole = F.sum(value).over(Window.partitionBy(*by))
    return counts.withColumn("share", F.col(value) / F.when(whole != 0, whole))


def active_cells(visits: DataFrame) -> DataFrame:
    """pt_idx, hex_id of the cells visited at each hour, each once."""
    return visits.filter("pt_idx is not null and hex_id is not null").select(TIME, "hex_id").distinct()


def global_baseline(visits: DataFrame, poi_counts: DataFrame) -> DataFrame:
    """pt_idx, cat_name, n, share over the hour's active cells."""
    n = active_cells(visits).join(poi_counts, "hex_id").groupBy(TIME, CAT).agg(F.sum("cat_count").alias("n"))
    return shares(n, [TIME])


def top_categories(baseline: DataFrame, k: int) -> DataFrame:
    """The k categories of the largest share summed over the hours, ties by name: cat_name, total."""
    return baseline.groupBy(CAT).agg(F.sum("share").alias("total")).orderBy(F.desc(F.round("total", 9)), CAT).limit(k)


def cluster_unique(visits: DataFrame, labels: DataFrame, poi_counts: DataFrame, min_hex: int = 1) -> DataFrame:
    """cluster, pt_idx, cat_name, n, cells, share; hours with fewer than min_hex cells that have places have a null share."""
    cells = visits.join(labels, "traj_id").select("cluster", TIME, "hex_id").distinct()
    known = cells.join(poi_counts.select("hex_id").distinct(), "hex_id", "left_semi")
    size = known.groupBy("cluster", TIME).agg(F.count(F.lit(1)).alias("cells"))
    n = known.join(poi_counts, "hex_id").groupBy("cluster", TIME, CAT).agg(F.sum("cat_count").alias("n")).join(size, ["cluster", TIME])
    return shares(n, ["cluster", TIME]).withColumn("share", F.when(F.col("cells") >= min_hex, F.col("share")))


def cluster_device(visits: DataFrame, labels: DataFrame, poi_counts: DataFrame) -> DataFrame:
    """cluster, pt_idx, cat_name, share: the mean over the visits of the shares of their cells, cells without a category
    counting as 0 and cells without places not at all."""
    own = shares(poi_counts.withColumnRenamed("cat_count", "n"), ["hex_id"]).select("hex_id", CAT, "share")
    at = visits.join(labels, "traj_id").join(own.select("hex_id").distinct(), "hex_id", "left_semi")
    rows = at.groupBy("cluster", TIME, "hex_id").agg(F.count(F.lit(1)).alias("visits"))
    size = rows.groupBy("cluster", TIME).agg(F.sum("visits").alias("all"))
    return rows.join(own, "hex_id").groupBy("cluster", TIME, CAT).agg(F.sum(F.col("share") * F.col("visits")).alias("s")).join(size, ["cluster", TIME]).select("cluster", TIME, CAT, (F.col("s") / F.col("all")).alias("share"))


def device_counts(visits: DataFrame, labels: DataFrame, poi_counts: DataFrame) -> DataFrame:
    """cluster, pt_idx, cat_name, n: the counts of a cell once for every visit of it."""
    at = visits.join(labels, "traj_id").groupBy("cluster", TIME, "hex_id").agg(F.count(F.lit(1)).alias("visits"))
    return at.join(poi_counts, "hex_id").groupBy("cluster", TIME, CAT).agg(F.sum(F.col("cat_count") * F.col("visits")).alias("n"))


def device_mass(visits: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, devices, alpha: distinct trajectories of each cluster and their part of all."""
    m = visits.join(labels, "traj_id").groupBy("cluster").agg(F.countDistinct("traj_id").alias("devices"))
    return m.withColumn("alpha", F.col("devices") / F.sum("devices").over(Window.partitionBy()))


def mass_weighted_mix(cluster_shares: DataFrame, mass: DataFrame) -> DataFrame:
    """pt_idx, cat_name, share: the clusters' shares weighted by their devices."""
    return cluster_shares.filter("share is not null").join(F.broadcast(mass), "cluster").groupBy(TIME, CAT).agg((F.sum(F.col("share") * F.col("devices")) / F.sum("devices")).alias("share"))


def deviation(cluster_shares: DataFrame, baseline: DataFrame, mode: str = "rel", eps: float = 1e-9) -> DataFrame:
    """Adds deviation: rel (p - g) / g (0 where g is 0), ratio p / g (1 there), log of the ratio with eps added to both, or
    points 100 (p - g)."""
    g = baseline.select(TIME, CAT, F.col("share").alias("base"))
    p, b = F.col("share"), F.coalesce("base", F.lit(0.0))
    value = {
        "rel": F.when(b != 0, (p - b) / b).otherwise(0.0),
        "ratio": F.when(b != 0, p / b).otherwise(1.0),
        "log": F.log((p + eps) / (b + eps)),
        "points": 100 * (p - b),
    }[mode]
    return cluster_shares.join(g, [TIME, CAT], "left").withColumn("deviation", value)


def centred_points(cluster_shares: DataFrame) -> DataFrame:
    """Adds centred: 100 (share - mean share of the clusters) by hour and category."""
    return cluster_shares.withColumn("centred", 100 * (F.col("share") - F.avg("share").over(Window.partitionBy(TIME, CAT))))


def full_grid(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every combination of the keys' values, 0 where df has none. The values of each key are a dimension (hours, clusters,
    categories), not data: they are read off, and their product taken by exploding lists."""
    sets = df.agg(*[F.array_sort(F.collect_set(k)).alias(k) for k in keys])
    grid = sets
    for k in keys:
        grid = grid.withColumn(k, F.explode(k))
    return grid.join(df.select(*keys, value), keys, "left").fillna(0, [value])


def stat_over_time(deltas: DataFrame, by: list[str], value: str = "d") -> DataFrame:
    """by, l2_sum (root of the sum of squares), l2_mean (of their mean), maxabs, hours: over the rows that are not null."""
    d = F.col(value)
    return deltas.filter(d.isNotNull()).groupBy(*by).agg(F.sqrt(F.sum(d * d)).alias("l2_sum"), F.sqrt(F.avg(d * d)).alias("l2_mean"), F.max(F.abs(d)).alias("maxabs"), F.count(d).alias("hours"))
