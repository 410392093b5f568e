"""Tests by permutation, corrections for many tests, intervals, and exact tests on counts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import shared
from trackloom.functions.columns import mixer
from trackloom.operators import composition as C

Z95 = 1.95996


def permuted_within_time(rows: DataFrame, permutations: int, seed: int = 1, time: str = "pt_idx", key: str = "traj_id", label: str = "cluster") -> DataFrame:
    """rows(traj_id, pt_idx, cluster), one a trajectory and hour, to b, traj_id, pt_idx, cluster: the labels of each hour
    dealt anew among its trajectories, for b from 1. Two ranks of the hour's rows, one by key and one by a mixed number,
    are put side by side: a relabelling without any randomness but the seed's."""
    by_key = Window.partitionBy("b", time).orderBy(key)
    by_draw = Window.partitionBy("b", time).orderBy("_draw", key)
    every = rows.select(time, key, label).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_draw", mixer(F.col(key) * 7919 + F.col(time) * 104_729 + F.col("b") * 15_485_863, seed))
    ranked = every.select("b", time, key, label, F.row_number().over(by_key).alias("_i"), F.row_number().over(by_draw).alias("_j"))
    given = ranked.select("b", time, F.col("_j").alias("_i"), F.col(label).alias("_new"))
    return ranked.drop(label).join(given, ["b", time, "_i"]).select("b", key, time, F.col("_new").alias(label))


def composition_statistic(at: DataFrame, poi_counts: DataFrame, baseline: DataFrame, by: list[str], min_hex: int = 1) -> DataFrame:
    """by + cluster, cat_name, l2, maxabs: over hours, 100 (share of the cluster's distinct cells - baseline), where the
    cluster has min_hex cells with places; `at` holds by, cluster, pt_idx, hex_id. A category the cluster's cells lack
    counts with a share of 0."""
    keys = [*by, "cluster", C.TIME]
    cells = at.select(*keys, "hex_id").distinct().join(poi_counts.select("hex_id").distinct(), "hex_id", "left_semi")
    valid = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") >= min_hex).drop("cells")
    n = cells.join(poi_counts, "hex_id").groupBy(*keys, C.CAT).agg(F.sum("cat_count").alias("n"))
    share = C.shares(n, keys).select(*keys, C.CAT, "share")
    full = valid.join(baseline.select(C.TIME, C.CAT, F.col("share").alias("base")), C.TIME).join(share, [*keys, C.CAT], "left")
    d = 100 * (F.coalesce("share", F.lit(0.0)) - F.col("base"))
    return full.withColumn("d", d).groupBy(*by, "cluster", C.CAT).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("l2"), F.max(F.abs("d")).alias("maxabs"))


def _deal(draw_of: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels in the order of keys, dealt anew: the row of the i-th key takes the label of the row of the i-th draw."""
    return label[np.argsort(draw_of, kind="stable")]


def mixed_numbers(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """`mixer` over arrays of bigints."""
    p = 2147483647
    return (x % p * 48271 + seed * 12345 + 1) % p * 16807 % p


def _permuted_sums(visits: DataFrame, labels: DataFrame, poi_counts: DataFrame, permutations: int, min_hex: int, seed: int, kind: str) -> DataFrame:
    """For the labels as they are (b = 0) and dealt anew within each hour: b, cluster (or a and b_cluster), cat_name, with the
    number of valid hours n, the sum of squared deviations s and the largest m, in points; deviations of a cluster's shares
    from the baseline (`baseline`), or of two clusters' from each other in hours valid for both (`pairs`), both over a
    trajectory's first cell of the hour and each cell once; or, over all visits, of a cluster's shares of the places its
    devices are at from the mean of the clusters' (`centred`, as parts and not points).

    An hour's rows and the places of its cells go to one task once, and all draws are made there: what is shuffled is an
    hour's rows, and one array of sums for each draw and cluster from each task, whatever the number of draws.
    """
    import pyarrow as pa

    from trackloom.arrow import grouped

    spark = visits.sparkSession
    first = visits.filter("pt_idx is not null and hex_id is not null").groupBy("traj_id", C.TIME).agg(F.min("hex_id").alias("hex_id"))
    pairs, centred = kind == "pairs", kind == "centred"
    taken = visits.filter("pt_idx is not null and hex_id is not null").select("traj_id", C.TIME, "hex_id") if centred else first
    kinds = dict(poi_counts.dtypes) | dict(labels.dtypes)
    cats = [r[0] for r in poi_counts.select(C.CAT).distinct().orderBy(C.CAT).collect()]  # a dimension of the model
    names = [r[0] for r in labels.filter("cluster is not null").select("cluster").distinct().orderBy("cluster").collect()]  # one row a cluster
    unit = "a {k}, b_cluster {k}".format(k=kinds["cluster"]) if pairs else f"cluster {kinds['cluster']}"
    schema = f"b int, {unit}, cat_name {kinds[C.CAT]}, n bigint, s double, m double"
    if not cats or not names:
        return spark.createDataFrame([], schema)
    code = lambda values, col: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)).cast("int") - 1
    rows = taken.join(labels.filter("cluster is not null"), "traj_id").select(C.TIME, F.col("traj_id").cast("bigint").alias("traj"), F.xxhash64("hex_id").alias("hex"), code(names, "cluster").alias("code"), F.lit(None).cast("double").alias("n"))
    every = visits.filter("pt_idx is not null and hex_id is not null").select(C.TIME, "hex_id").distinct()
    # places of the hour's cells: for the baseline all that are visited
    held = every.join(poi_counts, "hex_id").select(C.TIME, F.lit(None).cast("bigint").alias("traj"), F.xxhash64("hex_id").alias("hex"), code(cats, C.CAT).alias("code"), F.col("cat_count").cast("double").alias("n"))
    k, width = len(names), len(cats)
    one, two = np.triu_indices(k, 1) if pairs else (np.arange(k), None)
    chunk = max(1, 2_000_000 // max(1, len(one) * width))

    def draw(batches):
        hours = []
        for t in grouped(batches, [C.TIME]):
            hour = int(t[C.TIME][0].as_py())
            n = t["n"].to_numpy()
            is_place = ~np.isnan(n)
            traj, hex_, code_ = t["traj"].fill_null(0).to_numpy(), t["hex"].to_numpy(), t["code"].to_numpy()
            cells, at = np.unique(hex_, return_inverse=True)
            whole = np.bincount(code_[is_place], n[is_place], width)
            if not whole.sum():
                continue
            counts = np.zeros((len(cells), width))
            np.add.at(counts, (at[is_place], code_[is_place]), n[is_place])
            key, begin, who = np.unique(traj[~is_place], return_index=True, return_inverse=True)
            cell, label = at[~is_place], code_[~is_place][begin]
            known = counts.any(1)
            hours.append((hour, whole / whole.sum(), whole > 0, counts, known, cell, label, key, who))
        for begin in range(0, permutations + 1, chunk):
            some = range(begin, min(begin + chunk, permutations + 1))
            total, square, most = np.zeros((len(some), len(one), width), np.int64), np.zeros((len(some), len(one), width)), np.zeros((len(some), len(one), width))
            for hour, base, in_base, counts, known, cell, label, key, who in hours:
                for i, b in enumerate(some):
                    own = label if b == 0 else _deal(mixed_numbers(key * 7919 + hour * 104_729 + b * 15_485_863, seed), label)
                    there = np.bincount(own[who] * len(known) + cell, minlength=k * len(known)).reshape(k, len(known))
                    if not centred:
                        there = (there > 0) & known
                    n = there @ counts
                    valid = n.sum(1) > 0 if centred else there.sum(1) >= min_hex
                    share = n / np.maximum(n.sum(1, keepdims=True), 1e-300)
                    if centred:
                        d = share - share[valid].sum(0) / max(valid.sum(), 1)
                    else:
                        d = 100 * (share[one] - (base if two is None else share[two]))
                    ok = (valid if two is None else valid[one] & valid[two])[:, None] & (in_base if kind == "baseline" else np.ones(width, bool))
                    d = np.where(ok, d, 0)
                    total[i] += ok
                    square[i] += d * d
                    np.maximum(most[i], np.abs(d), out=most[i])
            i, u = np.nonzero(total.any(2))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, len(i) * width + 1, width, dtype=np.int32)), pa.array(x[i, u].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((i + begin).astype(np.int32)), pa.array(u.astype(np.int32)), lists(total), lists(square), lists(most)], ["b", "u", "n", "s", "m"])

    cols = [C.TIME, "traj", "hex", "code", "n"]
    part = rows.select(cols).unionByName(held.select(cols)).withColumn(C.TIME, F.col(C.TIME).cast("bigint")).repartition(C.TIME).sortWithinPartitions(C.TIME)
    sums = part.mapInArrow(draw, "b int, u int, n array<bigint>, s array<double>, m array<double>")
    flat = sums.select("b", "u", F.posexplode(F.arrays_zip("n", "s", "m")).alias("c", "x")).groupBy("b", "u", "c").agg(F.sum("x.n").alias("n"), F.sum("x.s").alias("s"), F.max("x.m").alias("m")).filter("n > 0")
    named = lambda values, col: F.get(F.array(*[F.lit(v) for v in values]), F.col(col))
    where = {"a": named([names[x] for x in one], "u"), "b_cluster": named([names[x] for x in two], "u")} if pairs else {"cluster": named(names, "u")}
    return flat.select("b", *[c.cast(kinds["cluster"]).alias(name) for name, c in where.items()], named(cats, "c").alias(C.CAT), "n", "s", "m")


def permutation_test(visits: DataFrame, labels: DataFrame, poi_counts: DataFrame, permutations: int, stat: str = "l2", min_hex: int = 1, seed: int = 1) -> DataFrame:
    """cluster, cat_name, observed, exceed, p: how often the statistic of permuted labels reaches the observed one, plus one
    over permutations plus one. A permutation in which a cluster has no valid hour counts as minus infinity."""
    t = (F.sqrt(F.col("s") / F.col("n")) if stat == "l2" else F.col("m")).alias("t")
    drawn = shared.stored(_permuted_sums(visits, labels, poi_counts, permutations, min_hex, seed, "baseline").select("b", "cluster", C.CAT, t), "drawn")
    observed = drawn.filter("b = 0").select("cluster", C.CAT, F.col("t").alias("observed"))
    ge = observed.join(drawn.filter("b > 0"), ["cluster", C.CAT], "left").groupBy("cluster", C.CAT).agg(F.first("observed").alias("observed"), F.sum((F.round("t", 9) >= F.round("observed", 9)).cast("int")).alias("exceed"))
    exceed = F.coalesce("exceed", F.lit(0))
    return ge.select("cluster", C.CAT, "observed", exceed.alias("exceed"), ((exceed + 1) / (permutations + 1)).alias("p"))


def centred_count_test(visits: DataFrame, labels: DataFrame, poi_counts: DataFrame, permutations: int, stat: str = "l2", seed: int = 1) -> DataFrame:
    """cluster, cat_name, observed, hours, p: the shares of the places at which a cluster's devices are (each visit counts),
    less the mean of the clusters' at that hour; the root of the sum of their squares over the hours, or the largest. Labels
    are dealt anew among the trajectories of an hour. Hours in which a cluster has no place count for nothing."""
    t = (F.sqrt("s") if stat == "l2" else F.col("m")).alias("t")
    drawn = shared.stored(_permuted_sums(visits, labels, poi_counts, permutations, 0, seed, "centred").select("b", "cluster", C.CAT, "n", t), "drawn")
    own = drawn.filter("b = 0").select("cluster", C.CAT, F.col("n").alias("hours"))
    return own.join(_p_values(drawn.drop("n"), ["cluster", C.CAT], permutations), ["cluster", C.CAT])


def benjamini_hochberg(df: DataFrame, p: str = "p", by: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """Adds q: the smallest p m / rank of this and all larger p, at most 1; null p have a null q and are not counted."""
    there = Window.partitionBy(*by, F.col(p).isNull())
    order = there.orderBy(p, *([tie] if tie else []))
    raw = F.col(p) * F.count(F.lit(1)).over(there) / F.row_number().over(order)
    d = df.withColumn("_raw", raw)
    q = F.least(F.lit(1.0), F.min("_raw").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return d.withColumn("q", F.when(F.col(p).isNotNull(), q)).drop("_raw")


def max_statistic(observed: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """Adds p_fwer: the part of permutations whose largest statistic over all tests reaches the observed one (no plus one).
    null(b, t) has a row for each permutation and test."""
    top = null.groupBy("b").agg(F.max("t").alias("top"))
    w = Window.partitionBy().orderBy(F.desc("v"), "kind")
    both = top.select(F.col("top").alias("v"), F.lit(0).alias("kind"), *[F.lit(None).cast(dict(observed.dtypes)[k]).alias(k) for k in keys]).unionByName(observed.select(F.col("observed").alias("v"), F.lit(1).alias("kind"), *keys))
    ranked = both.withColumn("above", F.sum((F.col("kind") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = F.broadcast(top.agg(F.count(F.lit(1)).alias("all")))
    return ranked.filter("kind = 1").join(total).select(*keys, F.col("v").alias("observed"), (F.col("above") / F.col("all")).alias("p_fwer"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p = successes / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def binary_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """accuracy, balanced, mcc, precision, recall, f1; a quotient by 0 is 0."""

    def over(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b).otherwise(0.0)

    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    recall, special, precision = over(tp, tp + fn), over(tn, tn + fp), over(tp, tp + fp)
    return {
        "accuracy": over(tp + tn, tp + fp + fn + tn),
        "balanced": (recall + special) / 2,
        "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "precision": precision,
        "recall": recall,
        "f1": over(2 * precision * recall, precision + recall),
    }


def clr(df: DataFrame, row: list[str], value: str, eps: float = 1e-9) -> DataFrame:
    """Adds clr: the centred log-ratio of each row's closed values."""
    w = Window.partitionBy(*row)
    closed = (F.col(value) + eps) / F.sum(F.col(value) + eps).over(w)
    d = df.withColumn("_ln", F.log(closed))
    return d.withColumn("clr", F.col("_ln") - F.avg("_ln").over(w)).drop("_ln")


def permanova(sums: DataFrame) -> DataFrame:
    """sums(b, n, groups, sst, ssw) to b, f, r2: the pseudo-F of distances whose squares sum to n sst and, within groups,
    to ssw (each group's sum over its size)."""
    f = ((F.col("sst") - F.col("ssw")) / (F.col("groups") - 1)) / (F.col("ssw") / (F.col("n") - F.col("groups")))
    return sums.select("b", f.alias("f"), ((F.col("sst") - F.col("ssw")) / F.col("sst")).alias("r2"))


def permanova_vectors(points: DataFrame, permutations: int = 0, seed: int = 1) -> DataFrame:
    """points(id, label, x array<double>) to b, f, r2 with b = 0 for the labels as they are.

    In Euclidean space the sum of squared pair distances of a set is its size times the sum of squares around its mean, so
    that no pair is ever formed: sums by label and dimension are enough. Labels are dealt anew by two ranks.
    """
    base = points.select("id", "label", "x")
    i, j = Window.partitionBy("b").orderBy("id"), Window.partitionBy("b").orderBy("_draw", "id")
    every = base.select("id", "label").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(permutations)))).withColumn("_draw", F.when(F.col("b") > 0, mixer(F.col("id") * 7919 + F.col("b") * 15_485_863, seed)).otherwise(F.lit(0)))
    ranked = every.select("b", "id", "label", F.row_number().over(i).alias("i"), F.row_number().over(j).alias("j"))
    dealt = ranked.select("b", "id", "i").join(ranked.select("b", F.col("j").alias("i"), "label"), ["b", "i"]).select("b", "id", "label")
    rows = dealt.join(base.select("id", F.posexplode("x").alias("k", "v")), "id")
    by = rows.groupBy("b", "label", "k").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("m"))
    within = by.groupBy("b").agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("m")).alias("ssw"), F.countDistinct("label").alias("groups"))
    whole = by.groupBy("b", "k").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").alias("m")).groupBy("b").agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("m")).alias("sst"), F.max("m").alias("n"))
    return permanova(within.join(whole, "b"))


def rbf_mmd2(x: np.ndarray, y: np.ndarray, gamma: float) -> float:
    """The unbiased squared maximum mean discrepancy."""
    square = lambda a, b: np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)
    kxx, kyy, kxy = (np.exp(-gamma * square(a, b)) for a, b in ((x, x), (y, y), (x, y)))
    n, m = len(x), len(y)
    return float((kxx.sum() - np.trace(kxx)) / (n * (n - 1)) + (kyy.sum() - np.trace(kyy)) / (m * (m - 1)) - 2 * kxy.mean())


def mmd2_features(points: DataFrame, gamma: float, features: int = 1_024, seed: int = 1) -> DataFrame:
    """points(label int, x array<double>) to a, b, mmd2: the unbiased estimate between each two labels over all rows, the
    kernel by random Fourier features (error about one over the root of their number), so that each row is mapped once and
    only one vector a label is summed; labels of fewer than two rows are left out."""
    import pyarrow as pa

    def add(batches):
        sums: dict = {}
        freq = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if freq is None:
                freq = np.random.default_rng(seed).normal(scale=math.sqrt(2 * gamma), size=(x.shape[1], features))
            z = x @ freq
            phi = np.hstack([np.cos(z), np.sin(z)]) / math.sqrt(features)
            label = b["label"].to_numpy(zero_copy_only=False)
            for k in np.unique(label):
                n, total = sums.get(int(k), (0, 0.0))
                sums[int(k)] = (n + int((label == k).sum()), total + phi[label == k].sum(0))
        for k, (n, total) in sums.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([k] * len(total), pa.int32()), "k": pa.array(range(len(total)), pa.int32()), "s": total, "n": pa.array([n] * len(total), pa.int64())})

    clean = points.filter("label is not null and x is not null").select(F.col("label").cast("int"), "x")
    s = clean.mapInArrow(add, "label int, k int, s double, n bigint").groupBy("label", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = s.groupBy("label").agg(((F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1))).alias("own"), F.max("n").alias("m")).filter("m > 1")
    a, b = s.withColumnsRenamed({"label": "a", "s": "sa", "n": "na"}), s.withColumnsRenamed({"label": "b", "s": "sb", "n": "nb"})
    cross = a.join(b, "k").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb") / F.col("na") / F.col("nb")).alias("c"))
    oa, ob = own.select(F.col("label").alias("a"), F.col("own").alias("oa")), own.select(F.col("label").alias("b"), F.col("own").alias("ob"))
    return cross.join(F.broadcast(oa), "a").join(F.broadcast(ob), "b").select("a", "b", (F.col("oa") + F.col("ob") - 2 * F.col("c")).alias("mmd2"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table."""
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    n, r, k = a + b + c + d, a + b, a + c
    log_p = lambda x: choose(r, x) + choose(n - r, k - x) - choose(n, k)
    own = log_p(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, k - (n - r)), min(r, k) + 1) if (p := log_p(x)) <= own + 1e-7))


def binomial_exact(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided, by the probabilities no larger than that of k."""
    lg = math.lgamma
    prob = [math.exp(lg(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(n + 1)]
    return min(1.0, sum(x for x in prob if x <= prob[k] * (1 + 1e-7)))


def mcnemar_exact(b: int, c: int) -> float:
    return binomial_exact(min(b, c), b + c) if b + c else 1.0


def chi_square(table: np.ndarray) -> tuple[float, int]:
    """The statistic without correction, and its degrees of freedom."""
    t = np.asarray(table, float)
    expected = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(expected > 0, (t - expected) ** 2 / expected, 0).sum()
    return float(x), (t.shape[0] - 1) * (t.shape[1] - 1)


def bootstrap(rows: DataFrame, draws: int, seed: int, *sums: Column) -> DataFrame:
    """b and the sums over a resample of the rows (a column `id` names them): each row weighs a Poisson(1) number that
    depends on the seed, the draw and the row, so that a draw is one pass without any table of indices."""
    u = (mixer(F.col("id") * 7919 + F.col("b") * 15_485_863, seed) + 0.5) / 2147483647.0
    weight, term, total = F.lit(0), math.exp(-1), math.exp(-1)
    for k in range(1, 9):
        weight = weight + (u > total).cast("int")
        term /= k
        total += term
    every = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    return every.groupBy("b").agg(*[F.sum(F.col("w") * s).alias(f"s{i}") for i, s in enumerate(sums)])


def _p_values(drawn: DataFrame, keys: list[str], permutations: int) -> DataFrame:
    """drawn(b, keys, t) to keys, observed, p."""
    own = drawn.filter("b = 0").select(*keys, F.col("t").alias("observed"))
    ge = F.sum((F.round("t", 9) >= F.round("observed", 9)).cast("int"))
    return own.join(drawn.filter("b > 0"), keys, "left").groupBy(*keys).agg(F.first("observed").alias("observed"), ((F.coalesce(ge, F.lit(0)) + 1) / (permutations + 1)).alias("p"))


def omnibus_test(visits: DataFrame, labels: DataFrame, poi_counts: DataFrame, permutations: int, min_hex: int = 1, seed: int = 1) -> DataFrame:
    """cluster, observed, p: one test a cluster, the root of the mean over hours and categories of the squared points by
    which its shares leave the baseline."""
    per = _permuted_sums(visits, labels, poi_counts, permutations, min_hex, seed, "baseline")
    pooled = shared.stored(per.groupBy("b", "cluster").agg(F.sqrt(F.avg(F.col("s") / F.col("n"))).alias("t")), "pooled")
    return _p_values(pooled, ["cluster"], permutations)


def pairwise_contrasts(visits: DataFrame, labels: DataFrame, poi_counts: DataFrame, permutations: int, per_category: bool = False, min_hex: int = 1, seed: int = 1) -> DataFrame:
    """a, b_cluster[, cat_name], observed, p, q: for each two clusters, the root of the mean over the hours valid for both
    (and categories) of the squared difference of their shares in points; q over all tests."""
    by = ["a", "b_cluster", *([C.CAT] if per_category else [])]
    per = _permuted_sums(visits, labels, poi_counts, permutations, min_hex, seed, "pairs")
    t = shared.stored(per.groupBy("b", *by).agg(F.sqrt(F.sum("s") / F.sum("n")).alias("t")), "contrasts")
    return benjamini_hochberg(_p_values(t, by, permutations).withColumn("_k", F.struct(*by)), tie="_k").drop("_k")
