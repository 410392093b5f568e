"""Clustering of feature vectors and what is measured of it: k-means, choice of k, constrained sizes, agreement, geometry.

Fits are MLlib's; measures over pairs of rows are taken from sums (of vectors and squares by cluster), which says the same
without forming a pair, except for the exact silhouette, where a row is compared with the sums of each cluster.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import shared
from trackloom.functions.columns import euclidean, mixer
from trackloom.operators.pairwise import assignment


def _vectors(df: DataFrame, x: str = "x") -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.transform(x, lambda v: v.cast("double"))))


def standardised(df: DataFrame, x: str = "x") -> DataFrame:
    """x less its mean over its population deviation (MLlib divides by the sample's; constant dimensions become 0)."""
    v = _vectors(df, x)
    n = df.count()
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(v).transform(v)
    back = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    return scaled.withColumn(x, F.transform(vector_to_array("_s"), lambda z: z * back)).drop("_v", "_s")


def kmeans(df: DataFrame, k: int, seed: int = 0, x: str = "x", init_steps: int = 5) -> tuple[DataFrame, list[list[float]], float]:
    """df with cluster, the centres, and the inertia."""
    v = _vectors(df, x)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", initSteps=init_steps, maxIter=50).fit(v)
    return model.transform(v).drop("_v"), [c.tolist() for c in model.clusterCenters()], float(model.summary.trainingCost)


def representatives(df: DataFrame, centres: list[list[float]], m: int, x: str = "x", key: str = "id") -> DataFrame:
    """cluster, key, rank, dist: the m rows nearest to each cluster's centre, ties by the key."""
    c = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(centres)], "cluster int, _c array<double>")
    d = df.join(F.broadcast(c), "cluster").withColumn("dist", euclidean(F.col(x), F.col("_c")))
    w = Window.partitionBy("cluster").orderBy("dist", key)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= m).select("cluster", key, "rank", "dist")


def cluster_sums(df: DataFrame, x: str = "x", label: str = "cluster") -> DataFrame:
    """label, k (dimension), n, s, q: rows, sum and sum of squares."""
    return df.select(label, F.posexplode(x).alias("k", "_v")).groupBy(label, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"))


def scores(df: DataFrame, x: str = "x", label: str = "cluster") -> dict[str, float]:
    """inertia, between, trace_ratio, calinski_harabasz, davies_bouldin, imbalance and k. Only cluster x dimension sums come
    to the driver; the mean distance to the centre, which sums cannot give, is one more pass."""
    sums = cluster_sums(df, x, label).toPandas()
    by = {c: g.sort_values("k") for c, g in sums.groupby(label)}
    n = np.array([g["n"].iloc[0] for g in by.values()], float)
    centre = np.array([(g["s"] / g["n"]).to_numpy(float) for g in by.values()])
    within = sum(float((g["q"] - g["s"] ** 2 / g["n"]).sum()) for g in by.values())
    whole = (n[:, None] * centre).sum(0) / n.sum()
    between = float((n * ((centre - whole) ** 2).sum(1)).sum())
    k = len(n)
    c = df.sparkSession.createDataFrame([(a, v.tolist()) for a, v in zip(by, centre, strict=True)], f"`{label}` {dict(df.dtypes)[label]}, _c array<double>")
    spread = {r[label]: r["d"] for r in df.join(F.broadcast(c), label).groupBy(label).agg(F.avg(euclidean(F.col(x), F.col("_c"))).alias("d")).collect()}
    s = np.array([spread[a] for a in by])
    apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
    db = float(np.mean([max((s[i] + s[j]) / apart[i, j] for j in range(k) if j != i) for i in range(k)])) if k > 1 else 0.0
    ch = between / (k - 1) / (within / (n.sum() - k)) if k > 1 and n.sum() > k and within > 0 else 0.0
    return {"k": float(k), "inertia": within, "between": between, "trace_ratio": between / within if within else math.inf, "calinski_harabasz": ch, "davies_bouldin": db, "imbalance": float(n.max() / n.min())}


def silhouette(df: DataFrame, x: str = "x", label: str = "cluster", key: str = "id") -> DataFrame:
    """key, label, silhouette on squared Euclidean distances: the mean squared distance of a row to a cluster follows from
    the cluster's sums, so that rows meet clusters (k of them), never rows. A cluster of one has 0."""
    sums = cluster_sums(df, x, label)
    per = sums.groupBy(label).agg(F.max("n").alias("n"), F.sum("q").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda z: z["s"]).alias("s"))
    c = per.select(F.col(label).alias("_l"), "n", "q", "s")
    row = df.select(key, label, x, F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v).alias("_xx"))
    dot = F.aggregate(F.zip_with(x, "s", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    total = F.col("n") * F.col("_xx") + F.col("q") - 2 * dot
    own = F.col(label) == F.col("_l")
    mean = F.when(own, total / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(total / F.col("n"))
    both = row.join(F.broadcast(c)).withColumn("_m", mean)
    ab = both.groupBy(key, label).agg(F.max(F.when(own, F.col("_m"))).alias("a"), F.min(F.when(~own, F.col("_m"))).alias("b"))
    return ab.select(key, label, F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


def sweep(df: DataFrame, ks: list[int], seed: int = 0, x: str = "x", key: str = "id") -> pd.DataFrame:
    """One row for each k with the scores and the mean silhouette."""
    out = []
    for k in ks:
        got, _, _ = kmeans(df, k, seed, x)
        got = got.select(key, x, "cluster").persist()
        out.append({"k": k} | scores(got, x) | {"silhouette": silhouette(got, x, key=key).agg(F.avg("silhouette")).first()[0]} | {"k": k})
        got.unpersist()
    return pd.DataFrame(out)


def knee(ks: list[float], inertia: list[float]) -> float:
    """The k farthest from the chord between the first and last point, both axes scaled to 0..1."""
    x, y = np.asarray(ks, float), np.asarray(inertia, float)
    x, y = (x - x[0]) / (x[-1] - x[0]), (y - y.min()) / max(y.max() - y.min(), 1e-12)
    d = np.abs((y[-1] - y[0]) * x - (x[-1] - x[0]) * y + x[-1] * y[0] - y[-1] * x[0]) / np.hypot(y[-1] - y[0], x[-1] - x[0])
    return float(ks[int(d.argmax())])


def gap_statistic(df: DataFrame, ks: list[int], references: int = 5, seed: int = 0, x: str = "x") -> pd.DataFrame:
    """k, gap, sk: log inertia of uniform reference sets in the data's box less that of the data; sk with ddof 1."""
    width = len(df.select(x).first()[0])
    box = df.select(F.posexplode(x).alias("k", "v")).groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k").collect()
    keyed = df.select(F.monotonically_increasing_id().alias("id"), x)
    out = []
    for k in ks:
        own = math.log(max(kmeans(df.select(x), k, seed, x)[2], 1e-300))
        logs = []
        for r in range(references):
            u = [box[i]["lo"] + (box[i]["hi"] - box[i]["lo"]) * ((mixer(F.xxhash64("id", F.lit(r), F.lit(i)) % 1_000_000_007, seed + 1) + 0.5) / 2147483647.0) for i in range(width)]
            logs.append(math.log(max(kmeans(keyed.select(F.array(*u).alias(x)), k, seed, x)[2], 1e-300)))
        out.append({"k": k, "gap": float(np.mean(logs)) - own, "sk": float(np.std(logs, ddof=1) * math.sqrt(1 + 1 / references)) if references > 1 else 0.0})
    return pd.DataFrame(out)


def k_from_gap(gap: pd.DataFrame) -> int:
    """The smallest k whose gap reaches the next one's less its deviation."""
    for a, b in itertools.pairwise(gap.itertuples()):
        if a.gap >= b.gap - b.sk:
            return int(a.k)
    return int(gap.loc[gap["gap"].idxmax(), "k"])


def adjusted_rand(df: DataFrame, a: str, b: str) -> float:
    """From the contingency table alone."""
    t = df.groupBy(a, b).count().toPandas()
    pairs = lambda v: (v * (v - 1) / 2).sum()
    n = float(t["count"].sum())
    both, x, y = pairs(t["count"].to_numpy(float)), pairs(t.groupby(a, dropna=False)["count"].sum().to_numpy(float)), pairs(t.groupby(b, dropna=False)["count"].sum().to_numpy(float))
    expected = x * y / (n * (n - 1) / 2) if n > 1 else 0.0
    return float((both - expected) / ((x + y) / 2 - expected)) if (x + y) / 2 != expected else 1.0


def stability(df: DataFrame, k: int, draws: int = 5, part: float = 0.8, seed: int = 0, x: str = "x", key: str = "id") -> float:
    """Mean agreement between the clusters of all rows and of subsamples."""
    whole, _, _ = kmeans(df, k, seed, x)
    whole = whole.select(key, F.col("cluster").alias("whole"))
    got = []
    for r in range(draws):
        some = df.filter(mixer(F.xxhash64(key, F.lit(r)) % 1_000_000_007, seed + 1) < part * 2147483647)
        got.append(adjusted_rand(kmeans(some, k, seed + r + 1, x)[0].join(whole, key), "cluster", "whole"))
    return float(np.mean(got))


def mixture_criteria(df: DataFrame, ks: list[int], seed: int = 0, x: str = "x") -> pd.DataFrame:
    """k, loglik, bic, aic of Gaussian mixtures with full covariances."""
    v = _vectors(df, x).select("_v")
    n, d = v.count(), len(df.select(x).first()[0])
    out = []
    for k in ks:
        ll = GaussianMixture(k=k, seed=seed, featuresCol="_v").fit(v).summary.logLikelihood
        p = k - 1 + k * d + k * d * (d + 1) / 2
        out.append({"k": k, "loglik": ll, "bic": p * math.log(n) - 2 * ll, "aic": 2 * p - 2 * ll})
    return pd.DataFrame(out)


def best_mapping(df: DataFrame, cluster: str, truth: str) -> tuple[dict, dict[str, float]]:
    """The assignment of clusters to labels that fits most rows, with its accuracy and the mean recall, precision and F1 of
    the labels. Only the table of counts comes to the driver."""
    t = df.groupBy(cluster, truth).count().toPandas().pivot(index=cluster, columns=truth, values="count").fillna(0)
    rows, cols = list(t.index), list(t.columns)
    best = assignment(t.to_numpy(float))
    to = {rows[i]: cols[j] for i, j in enumerate(best) if j >= 0}
    hit = np.array([sum(t.loc[r, c] for r, v in to.items() if v == c) for c in cols])
    said = np.array([sum(t.loc[r].sum() for r, v in to.items() if v == c) for c in cols])
    have = t.to_numpy().sum(0)
    recall, precision = hit / have, np.divide(hit, said, out=np.zeros_like(hit), where=said > 0)
    f1 = np.divide(2 * recall * precision, recall + precision, out=np.zeros_like(hit), where=recall + precision > 0)
    return to, {"accuracy": float(hit.sum() / have.sum()), "recall": float(recall.mean()), "precision": float(precision.mean()), "f1": float(f1.mean())}


def constrained(df: DataFrame, centres: list[list[float]], most: int, x: str = "x", key: str = "id", rounds: int = 50) -> DataFrame:
    """key, cluster with at most `most` rows in each: every row bids for its nearest centre still open; a centre keeps its
    nearest bidders and the rest bid again. Each round is one window by centre; at least one centre fills a round."""
    c = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(centres)], "cluster int, _c array<double>")
    bids = shared.stored(df.select(key, x).join(F.broadcast(c)).select(key, "cluster", euclidean(F.col(x), F.col("_c")).alias("d")), "bids")
    held, full = None, []
    left = bids
    for _ in range(min(rounds, len(centres) + 1)):
        open_ = left.filter(~F.col("cluster").isin(full)) if full else left
        first = open_.groupBy(key).agg(F.min_by(F.struct("cluster", "d"), F.struct("d", "cluster")).alias("b")).select(key, "b.cluster", "b.d")
        room = {i: most for i in range(len(centres))}
        if held is not None:
            for r in held.groupBy("cluster").count().collect():
                room[r["cluster"]] -= r["count"]
        cap = df.sparkSession.createDataFrame(list(room.items()), "cluster int, room int")
        w = Window.partitionBy("cluster").orderBy("d", key)
        won = shared.stored(first.join(F.broadcast(cap), "cluster").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("room")).select(key, "cluster"), "won")
        held = won if held is None else shared.stored(held.unionByName(won), "held")
        full = [r["cluster"] for r in held.groupBy("cluster").count().filter(F.col("count") >= most).collect()]
        left = shared.stored(left.join(won.select(key), key, "left_anti"), "left")
        if not left.limit(1).count():
            return held
    raise ValueError("the clusters have no room for all rows")


def constrained_kmeans(df: DataFrame, k: int, most: int, seeds: tuple[int, ...] = (0,), x: str = "x", key: str = "id", rounds: int = 20) -> tuple[DataFrame, float]:
    """key, cluster with at most `most` rows in each, and the inertia: from each seed's centres, rows are assigned within the
    bounds and centres moved to their means until the inertia no longer falls; the best seed's is kept."""
    best: tuple[DataFrame, float] | None = None
    for seed in seeds:
        centres = kmeans(df, k, seed, x)[1]
        last = math.inf
        for _ in range(rounds):
            own = shared.stored(constrained(df, centres, most, x, key), "assigned")
            sums = cluster_sums(df.join(own, key), x).collect()  # clusters x dimensions
            inertia = sum(r["q"] - r["s"] ** 2 / r["n"] for r in sums)
            if inertia >= last * (1 - 1e-9):
                break
            last = inertia
            if best is None or inertia < best[1]:
                best = own, inertia
            for r in sums:
                centres[r["cluster"]][r["k"]] = r["s"] / r["n"]
    return best


def separability(df: DataFrame, step: str, x: str = "x", label: str = "label", key: str = "id") -> DataFrame:
    """step, n, silhouette: the mean silhouette (squared distances) of the labels among each step's rows, by their sums; null
    for a step with fewer than two labels."""
    sums = df.select(step, label, F.posexplode(x).alias("k", "_v")).groupBy(step, label, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"))
    per = sums.groupBy(step, F.col(label).alias("_l")).agg(F.max("n").alias("n"), F.sum("q").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda z: z["s"]).alias("s"))  # one entry a dimension
    row = df.select(step, key, label, x, F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v).alias("_xx"))
    dot = F.aggregate(F.zip_with(x, "s", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    total, own = F.col("n") * F.col("_xx") + F.col("q") - 2 * dot, F.col(label) == F.col("_l")
    mean = F.when(own, total / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(total / F.col("n"))
    ab = row.join(per, step).withColumn("_m", mean).groupBy(step, key).agg(F.max(F.when(own, F.col("_m"))).alias("a"), F.min(F.when(~own, F.col("_m"))).alias("b"))
    value = F.when(F.col("b").isNotNull(), F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)))
    return ab.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("silhouette"))


def soft_assignment(df: DataFrame, centres: list[list[float]], alpha: float = 1.0, x: str = "x") -> DataFrame:
    """df with q: for each centre the part by Student's t kernel of the squared distance; and target: q squared over its sum
    over all rows, made to add up to one (what a clustering head is sharpened towards)."""
    far = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v) for c in centres]
    raw = F.array(*[F.pow(1 + d / alpha, F.lit(-(alpha + 1) / 2)) for d in far])
    part = lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda t, w: t + w))
    soft = df.withColumn("_raw", raw).withColumn("q", part(F.col("_raw"))).drop("_raw")
    sums = soft.agg(F.array(*[F.sum(F.col("q")[i]) for i in range(len(centres))]).alias("_f"))
    return soft.join(F.broadcast(sums)).withColumn("_t", F.zip_with("q", "_f", lambda a, b: a * a / b)).withColumn("target", part(F.col("_t"))).drop("_f", "_t")


def principal_components(df: DataFrame, k: int, x: str = "x") -> tuple[DataFrame, list[float]]:
    """df with pc (array of k), and the parts of the variance explained."""
    v = _vectors(df, x)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn("pc", vector_to_array("_p")).drop("_v", "_p"), model.explainedVariance.toArray().tolist()


def uncorrelated(corr: pd.DataFrame, threshold: float = 0.9) -> list[str]:
    """Columns chosen one by one by the fewest conflicts (absolute correlation at the threshold or above), ties by name."""
    a = corr.abs().to_numpy() >= threshold
    np.fill_diagonal(a, False)
    left, out = set(range(len(a))), []
    while left:
        i = min(left, key=lambda j: (sum(a[j, h] for h in left), str(corr.columns[j])))
        out.append(corr.columns[i])
        left -= {i, *[h for h in left if a[i, h]]}
    return out


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None) -> float:
    """Dynamic time warping distance of two sequences of vectors, within a band of the diagonal."""
    n, m = len(a), len(b)
    w = max(band if band is not None else max(n, m), abs(n - m))
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            d[i, j] = cost[i - 1, j - 1] + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return float(d[n, m])
