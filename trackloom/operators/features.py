"""Features of cells and sequences: mean vectors by class and cell, neighbour graphs of cells, masked sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.columns import HOURS, ordered_list, time_slot, unit


def mean_vector(df: DataFrame, by: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """by, n, mean: the mean (weighted, if a weight is given) of an array column, element by element; null vectors are left
    out, null elements of the others too. Elements are summed by place before anything is gathered, so that a class with
    a third of all rows costs its combine and `width` rows."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.filter(F.col(vector).isNotNull()).select(*by, w.alias("_w"), F.posexplode(vector).alias("_k", "_v"))
    sums = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*by, "_k").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return sums.groupBy(*by).agg(F.max("_n").alias("n"), ordered_list(F.col("_k"), F.col("_s") / F.col("_t")).alias("mean"))


def category_weighted_vector(df: DataFrame, cell: str, cat: str, vector: str) -> DataFrame:
    """cell, n, mean with each row weighing as many rows as its cell has of its category, squared."""
    n = F.count(vector).over(Window.partitionBy(cell, cat))
    return mean_vector(df.withColumn("_c", n.cast("double")), [cell], vector, F.col("_c") * F.col("_c"))


def filled(df: DataFrame, vector: str, default: Column) -> DataFrame:
    return df.withColumn(vector, F.coalesce(vector, default))


def masked_sequences(points: DataFrame, key: str, step: str, dims: list[str], length: int = HOURS) -> DataFrame:
    """Rows of (key, step from 1) to one row for each slot 0..length-1 of each key: slot, hour, padded and, for each
    dimension, its mean over the observations there (null where there are none) and whether there is one.

    Steps beyond the series are clipped into it; NaN counts as missing; `padded` is true behind a key's last slot.
    """
    rows = points.select(key, time_slot(F.col(step), length).alias("slot"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in dims])
    last = rows.groupBy(key).agg(F.max("slot").alias("_last"))
    grid = last.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    # no join: Spark takes the grid for as small as the keys it is made from, and would broadcast it
    observed = rows.select(key, "slot", F.lit(None).cast("int").alias("_last"), *[F.when(F.col(key).isNotNull(), F.col(c)).alias(c) for c in dims])
    both = grid.select(key, "slot", "_last", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in dims]).unionByName(observed)
    full = both.groupBy(key, "slot").agg(F.max("_last").alias("_last"), *[F.avg(c).alias(c) for c in dims])
    return full.select(key, "slot", (F.col("slot") % 24).alias("hour"), (F.col("slot") > F.col("_last")).alias("padded"), *dims, *[F.col(c).isNotNull().alias(f"{c}_observed") for c in dims])


def masked_stats(seq: DataFrame, dims: list[str], least: float = 1e-6) -> DataFrame:
    """dim, mean, std over what is observed: std from E[x^2] - E[x]^2, its square at least `least`."""
    parts = [F.struct(F.lit(c).alias("dim"), F.col(c).cast("double").alias("x")) for c in dims]
    rows = seq.select(F.explode(F.array(*parts)).alias("p")).filter("p.x is not null")
    mean, square = F.avg("p.x"), F.avg(F.col("p.x") * F.col("p.x"))
    return rows.groupBy("p.dim").agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(least))).alias("std"))


def standardized(seq: DataFrame, dims: list[str], stats: DataFrame) -> DataFrame:
    """Each dimension less its mean over its std; 0 where unobserved or padded. stats has one row a dimension."""
    wide = stats.groupBy().pivot("dim", dims).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    z = {c: F.when(F.col("padded") | F.col(c).isNull(), 0.0).otherwise((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")) for c in dims}
    return seq.join(F.broadcast(wide)).withColumns(z).drop(*[f"{c}_{x}" for c in dims for x in "ms"])


def masked_error(df: DataFrame, value: str, guess: str, delta: float = 1.0) -> DataFrame:
    """mse, huber, rmse, n over rows where both are there."""
    e = F.col(value) - F.col(guess)
    huber = F.when(F.abs(e) <= delta, e * e / 2).otherwise(delta * (F.abs(e) - delta / 2))
    return df.filter(e.isNotNull()).agg(F.avg(e * e).alias("mse"), F.avg(huber).alias("huber"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def hour_mean_baseline(seq: DataFrame, value: str) -> DataFrame:
    """Adds guess: the mean of the value at the row's hour of the day."""
    by = seq.filter(F.col(value).isNotNull()).groupBy("hour").agg(F.avg(value).alias("guess"))
    return seq.join(F.broadcast(by), "hour", "left")  # 24 rows


def sequence_latent(seq: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """key, latent: a fixed summary in place of a learned encoder: of each dimension the mean, the spread and the first
    daily sine and cosine, over the observed slots; at length one."""
    import math

    angle = F.col("slot") * (2 * math.pi / 24)
    parts = []
    for c in dims:
        x = F.col(c)
        parts += [F.avg(x), F.coalesce(F.stddev_pop(x), F.lit(0.0)), F.avg(x * F.sin(angle)), F.avg(x * F.cos(angle))]
    z = seq.groupBy(key).agg(F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts]).alias("latent"))
    return z.withColumn("latent", unit(F.col("latent")))


def top_labels(df: DataFrame, cell: str, label: str, n: int) -> DataFrame:
    """cell, labels: its n most frequent labels, ties by name."""
    c = df.filter(F.col(label).isNotNull()).groupBy(cell, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(cell).orderBy(F.desc("_n"), label)
    r = c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return r.groupBy(cell).agg(ordered_list(F.col("_r"), F.col(label)).alias("labels"))


def hit_rates(df: DataFrame, true: str, guessed: str, null_label: str) -> DataFrame:
    """Of array columns: cells, hit_any, hit_perfect (all true labels guessed), and the same over cells whose true labels
    are not the null label alone."""
    overlap = F.size(F.array_intersect(true, guessed))
    any_, all_ = (overlap >= 1).cast("double"), (overlap == F.size(F.array_distinct(true))).cast("double")
    known = ~(F.col(true) == F.array(F.lit(null_label)))
    return df.agg(F.count(F.lit(1)).alias("cells"), F.avg(any_).alias("hit_any"), F.avg(all_).alias("hit_perfect"), F.avg(F.when(known, any_)).alias("known_any"), F.avg(F.when(known, all_)).alias("known_perfect"))


def reconstruction(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """feature, rmse, nrmse_pct (over the range of the true values), n: how well each feature's guess (second) meets its value
    (first); rows in which either is null count for nothing."""
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(a).cast("double").alias("v"), F.col(b).cast("double").alias("g")) for n, (a, b) in pairs.items()])
    rows = df.select(F.explode(each).alias("e")).select("e.*").filter("v is not null and g is not null")
    rmse, width = F.sqrt(F.avg((F.col("v") - F.col("g")) * (F.col("v") - F.col("g")))), F.max("v") - F.min("v")
    return rows.groupBy("feature").agg(rmse.alias("rmse"), (100 * rmse / F.when(width > 0, width)).alias("nrmse_pct"), F.count(F.lit(1)).alias("n"))


def step_cosine(df: DataFrame, step: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """step, cosine, n: the mean cosine between the vectors of true and guessed features of a row; rows with a null, or a
    vector of zeros, count for nothing."""
    total = lambda f: sum((f(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs.values()), F.lit(0.0))
    dot, vv, gg = total(lambda a, b: a * b), total(lambda a, b: a * a), total(lambda a, b: b * b)
    cos = dot / F.sqrt(F.when((vv > 0) & (gg > 0), vv * gg))
    return df.select(step, cos.alias("c")).filter("c is not null").groupBy(step).agg(F.avg("c").alias("cosine"), F.count(F.lit(1)).alias("n"))


def sampled_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct keys drawn by a mixed number, the same in every run."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def substituted(wide: DataFrame, key: str, columns: list[str], vectors: DataFrame) -> DataFrame:
    """key, column, value, vector: the i-th filled cell of a row of `wide` (in the order of the columns) takes the i-th vector of
    its key in vectors(key, i from 0, vector). A row whose numbers of cells and vectors differ is an error."""
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]), lambda x: x["value"].isNotNull())
    long = wide.select(key, F.posexplode(cells).alias("i", "x")).select(key, "i", "x.column", "x.value")
    both = long.join(vectors.select(key, F.col("i").cast("int").alias("i"), "vector"), [key, "i"], "full")
    torn = F.col("column").isNull() | F.col("vector").isNull()
    return both.withColumn("vector", F.when(torn, F.raise_error(F.concat(F.lit("cells and vectors differ for "), F.col(key).cast("string")))).otherwise(F.col("vector"))).select(key, "column", "value", "vector")


def columns_to_fill(df: DataFrame, exempt: tuple[str, ...]) -> list[str]:
    """The columns in order, without those exempt."""
    return [c for c in df.columns if c not in exempt]
