"""People drawn by keys, not by order: homes by population, cohorts, weighted choice of the next place, day plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom import shared
from trackloom.arrow import grouped, ordinals
from trackloom.functions import geo
from trackloom.functions.columns import uniform
from trackloom.operators.nearest import in_space
from trackloom.operators.numbering import numbered

#: Metres over which the pull of a place falls, and how another county is weighed against one's own.
DECAY_M, SAME, OTHER = 20_000.0, 1.0, 3.0


def race(weight: Column, u: Column) -> Column:
    """The time of an exponential race: the smallest of a group is a draw in proportion to the weights."""
    return -F.log(u) / F.when(weight > 0, weight)


def homes(people: DataFrame, counties: DataFrame, places: DataFrame, seed: int = 42) -> DataFrame:
    """people(person_id), counties(county, population) and places(place, county) to person_id, county, place: a county in
    proportion to its population, then a home there by a number into the county's homes in order; where a county has none,
    into all homes. The counties' cumulative shares are a dimension and are broadcast."""
    w = Window.orderBy("county")
    share = counties.filter("population > 0").withColumn("hi", F.sum("population").over(w) / F.sum("population").over(Window.partitionBy()))
    cum = share.agg(F.array_sort(F.collect_list(F.struct("hi", "county"))).alias("all"))  # one entry a county
    p = people.join(F.broadcast(cum)).withColumn("_u", uniform(seed, F.col("person_id"), F.lit(1)))
    p = p.withColumn("county", F.get(F.filter("all", lambda x: x["hi"] >= F.col("_u")), 0)["county"]).drop("all", "_u")
    of_county = Window.partitionBy("county").orderBy("place")
    n = places.withColumns({"i": F.row_number().over(of_county) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("county"))})
    size = n.select("county", "n").distinct()
    whole = places.agg(F.count(F.lit(1)).alias("all_n"))
    every = numbered(places.select("place"), "place", name="i").select(F.lit(None).cast("string").alias("county"), F.col("i").cast("int").alias("i"), "place")
    drawn = p.join(F.broadcast(size), "county", "left").join(F.broadcast(whole)).withColumn("i", F.floor(uniform(seed, F.col("person_id"), F.lit(2)) * F.coalesce("n", "all_n")).cast("int"))
    table = n.select("county", "i", "place").unionByName(every).withColumnRenamed("county", "c")
    at = F.when(F.col("n").isNotNull(), F.col("county"))
    return drawn.withColumn("c", at).alias("x").join(table.alias("t"), F.col("x.c").eqNullSafe(F.col("t.c")) & (F.col("x.i") == F.col("t.i"))).select("person_id", "x.county", "place")


def cohorts(people: DataFrame, names: list[str], seed: int = 42) -> DataFrame:
    """person_id, cohort: as even as can be, the first names taking one more; who gets which by a mixed order."""
    k = len(names)
    drawn = numbered(people.select("person_id"), uniform(seed, F.col("person_id")), "person_id", name="r")
    n, r = F.col("n"), F.col("r")
    base, rest = F.floor(n / k), n % k
    i = F.when(r < (base + 1) * rest, F.floor(r / (base + 1))).otherwise(rest + F.floor((r - (base + 1) * rest) / F.when(base > 0, base).otherwise(1)))
    return drawn.join(F.broadcast(people.agg(F.count(F.lit(1)).alias("n")))).select("person_id", F.get(F.array(*[F.lit(x) for x in names]), i.cast("int")).alias("cohort"))


def pull(metres: Column, home_county: Column, county: Column, force_same: bool = False, force_other: bool = False) -> Column:
    """exp(-metres / DECAY_M) times SAME in the home county, OTHER elsewhere or where there is none; plus a trace, so that a
    mask that leaves nothing leaves an even draw."""
    same = F.coalesce(county == home_county, F.lit(False))
    w = F.exp(-metres / DECAY_M) * F.when(same, SAME).otherwise(OTHER)
    if force_same:
        w = F.when(same, w).otherwise(0.0)
    if force_other:
        w = F.when(same, 0.0).otherwise(w)
    return w + 1e-12


#: Factors of xxHash64, as Spark's xxhash64 has them.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: People of a task at most, places of a task at most; people and places met at a time.
PEOPLE, PLACES, SOME, BLOCK = 4_000, 200_000, 64, 1_024


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(seeds: np.ndarray, text: np.ndarray) -> np.ndarray:
    """xxhash64 of texts of one length (n x bytes) behind each seed (the hash of what comes before): seeds x n."""
    s, size = seeds[:, None], text.shape[1]
    word = lambda at: np.ascontiguousarray(text[:, at : at + 8]).view("<u8")[:, 0]
    at = 0
    with np.errstate(over="ignore"):
        if size >= 32:
            v = [s + P1 + P2, s + P2, s, s - P1]
            while at + 32 <= size:
                v = [_turned(x + word(at + 8 * i) * P2, 31) * P1 for i, x in enumerate(v)]
                at += 32
            h = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
            for x in v:
                h = (h ^ (_turned(x * P2, 31) * P1)) * P1 + P4
        else:
            h = np.broadcast_to(s + P5, (len(seeds), len(text)))
        h = h + np.uint64(size)
        while at + 8 <= size:
            h = _turned(h ^ (_turned(word(at) * P2, 31) * P1), 27) * P1 + P4
            at += 8
        if at + 4 <= size:
            h = _turned(h ^ (np.ascontiguousarray(text[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64) * P1), 23) * P2 + P3
            at += 4
        for i in range(at, size):
            h = _turned(h ^ (text[:, i].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def _races(people: pa.Table, places: pa.Table) -> pa.Table:
    """The winner among the places for each row of people. All draws are made; a pair's weight is worked out only where its
    draw could still win at the least distance of its block."""
    key = places["place"].combine_chunks()
    raw = [str(x).encode() if isinstance(x, str) else x.to_bytes(key.type.bit_width // 8, "little", signed=True) for x in key.to_pylist()]
    size, rank = np.array([len(x) for x in raw]), ordinals(key)
    lon, lat = places["lon"].to_numpy(), places["lat"].to_numpy()
    order = np.lexsort((lon, np.floor(lat * 10), size))
    q = in_space(lon, lat)
    codes = pa.concat_arrays([places["county"].combine_chunks(), people["home_county"].combine_chunks()]).dictionary_encode().indices.fill_null(-1).to_numpy().copy()
    county, home = codes[: len(q)], codes[len(q) :]
    home[home < 0] = -2
    blocks = []
    for steps in np.unique(size):
        own = order[size[order] == steps]
        for s in range(0, len(own), BLOCK):
            i = own[s : s + BLOCK]
            mid = q[i].mean(0)
            blocks.append((i, np.frombuffer(b"".join(raw[x] for x in i), np.uint8).reshape(len(i), -1), mid, np.sqrt(((q[i] - mid) ** 2).sum(1).max()) + 1e-9))
    mids, radius = np.stack([b[2] for b in blocks]), np.array([b[3] for b in blocks])
    plon, plat, seeds = people["lon"].to_numpy(), people["lat"].to_numpy(), people["draw"].to_numpy().view(np.uint64)
    p, best, won = in_space(plon, plat), np.full(len(people), np.inf), np.full(len(people), -1)
    near = np.lexsort((plon, np.floor(plat * 10)))
    for s in range(0, len(people), SOME):
        who = near[s : s + SOME]
        gap = np.maximum(np.sqrt(((p[who][:, None] - mids) ** 2).sum(2)) - radius, 0)
        most = OTHER * np.exp(-2 * geo.SPHERE * np.arcsin(np.minimum(gap / 2, 1.0)) / DECAY_M) * (1 + 1e-6) + 1.1e-12
        for k in np.argsort(gap.mean(0)):
            i, text, _, _ = blocks[k]
            x = hashed(seeds[who], text) & np.uint64((1 << 52) - 1)
            least = np.maximum(float(1 << 52) * np.exp(-best[who] * most[:, k]) * (1 - 1e-9) - 2, 0)
            r, c = np.nonzero(x >= least.astype(np.uint64)[:, None])
            if not len(r):
                continue
            w, j = who[r], i[c]
            a, b = np.radians(plat[w]), np.radians(lat[j])
            h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon[j] - plon[w]) / 2) ** 2
            metres = np.arcsin(np.sqrt(np.minimum(h, 1.0))) * (2 * geo.SPHERE)
            t = -np.log((x[r, c].astype(float) + 0.5) / float(1 << 52)) / (np.exp(-metres / DECAY_M) * np.where(county[j] == home[w], SAME, OTHER) + 1e-12)
            o = np.lexsort((rank[j], t, r))
            first = o[np.concatenate([[True], r[o][1:] != r[o][:-1]])]
            w, j, t = w[first], j[first], t[first]
            better = (t < best[w]) | ((t == best[w]) & (rank[j] < rank[won[w]]))
            best[w[better]], won[w[better]] = t[better], j[better]
    there = np.flatnonzero(won >= 0)
    got, asked = places.take(pa.array(won[there])), people.take(pa.array(there))
    return pa.table({"person_id": asked["person_id"], "step": asked["step"], "t": best[there], **{c: got[c] for c in ("place", "county", "lon", "lat")}})


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in grouped(batches, ["_c", "_s"]):
        for category in t["category"].unique():
            own = t.filter(pc.equal(t["category"], category))
            is_place = pc.is_valid(own["place"])
            people, places = own.filter(pc.invert(is_place)), own.filter(is_place)
            if len(people) and len(places):
                yield from _races(people, places).to_batches()


def next_places(asked: DataFrame, places: DataFrame, seed: int = 42) -> DataFrame:
    """asked(person_id, step, category, lon, lat, home_county) and places(place, category, county, lon, lat) to the place
    drawn for each: one race among the places of the category. People and places of a category are dealt to tasks of bounded
    size, each task runs its heats, and only the winners leave it."""
    here = F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
    position = [F.col(c).cast("double").alias(c) for c in ("lon", "lat")]
    a = asked.filter(here).select("person_id", "step", "category", "home_county", *position, F.xxhash64(F.lit(seed), "person_id", "step").alias("draw"))
    p = places.filter(here & F.col("place").isNotNull()).select("category", "place", "county", *position)
    count = lambda df, name, most: df.groupBy("category").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    parts = shared.stored(count(a, "_n", PEOPLE).join(count(p, "_m", PLACES), "category"), "parts")  # one row a category
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda df, key, own, other: df.join(F.broadcast(parts), "category").withColumn("_o", F.pmod(F.xxhash64(*key), F.col(own)).cast("int")).withColumn("_e", every(other))
    x = dealt(a, ["person_id", "step"], "_n", "_m").withColumn("_s", F.col("_o") * F.col("_m") + F.col("_e")).drop("_o", "_e", "_n", "_m")
    y = dealt(p, ["place"], "_m", "_n").withColumn("_s", F.col("_e") * F.col("_m") + F.col("_o")).drop("_o", "_e", "_n", "_m")
    tasks = parts.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 1
    kinds = dict(a.dtypes) | {"place": dict(p.dtypes)["place"], "county": dict(p.dtypes)["county"]}
    both = x.unionByName(y, allowMissingColumns=True).withColumn("_c", F.xxhash64("category")).repartition(max(tasks, a.sparkSession.sparkContext.defaultParallelism), "_c", "_s").sortWithinPartitions("_c", "_s")
    won = both.mapInArrow(_run, f"person_id {kinds['person_id']}, step {kinds['step']}, t double, place {kinds['place']}, county {kinds['county']}, lon double, lat double")
    run = won.groupBy("person_id", "step").agg(F.min_by(F.struct("place", "county", "lon", "lat"), F.struct("t", "place")).alias("w"))
    return run.select("person_id", "step", "w.place", "w.county", "w.lon", "w.lat")


def day_plans(people: DataFrame, places: DataFrame, plan: list[str], seed: int = 42) -> DataFrame:
    """people(person_id, lon, lat, home_county) walked through a plan of categories, one step of the plan a stage over all
    people; `home` returns. Gives person_id, step, place, county, lon, lat; where a category has no place one stays."""
    people, places = shared.stored(people, "people"), shared.stored(places, "places")
    now = people.select("person_id", "lon", "lat", "home_county", F.lit("home").alias("place"), F.col("home_county").alias("county"))
    out = now.withColumn("step", F.lit(0))
    for i, category in enumerate(plan, 1):
        if category == "home":
            now = people.select("person_id", "lon", "lat", "home_county", F.lit("home").alias("place"), F.col("home_county").alias("county"))
        else:
            asked = now.select("person_id", F.lit(i).alias("step"), F.lit(category).alias("category"), "lon", "lat", "home_county")
            got = next_places(asked, places, seed).select("person_id", F.struct("place", "county", "lon", "lat").alias("g"))
            j = now.join(got, "person_id", "left")
            pick = lambda c: F.coalesce(F.col(f"g.{c}"), F.col(c)).alias(c)
            now = shared.stored(j.select("person_id", pick("lon"), pick("lat"), "home_county", pick("place"), pick("county")), "step")
        out = out.unionByName(now.withColumn("step", F.lit(i)))
    return out.select("person_id", "step", "place", "county", "lon", "lat")
