"""Intervals of staying and moving made into hourly positions.

Intervals of a person lie on a clock of seconds from 0 (01:00 of day 1). A stay weighs its point by the time in the hour; a
move is sampled at the middles of equal parts of its overlap, no longer than a sampling step, each part weighing its time.
An hour without any interval repeats the last position; before the first, the home.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.columns import HOURS, uniform

#: The parameters of a move's speed, least and most; hours between which nobody leaves, days on which everybody may, the first stay, and what parts a move.
WARP = (0.8, 2.2)
CURFEW_END, CURFEW_START, FREE_DAYS, FIRST_STAY_H, SAMPLE_S = 5.0, 22.0, (2, 3), 4.0, 300
#: Dwell times in seconds by what a place is called, least and most; the first that fits holds.
DWELL = [
    (r"grocery|supermarket", 900.0, 2700.0),
    (r"restaurant|eating place|cafe|diner", 2700.0, 5400.0),
    (r"", 600.0, 3600.0),
]
HOME = r"home|residential|apartment|house"


def dwell_seconds(poi_text: Column, hour: Column, is_home: Column, u: Column) -> Column:
    """How long a stop lasts, for a number u in 0..1: at home 7-9 h at night and 0.5-1.5 h by day, else by DWELL."""
    text = F.lower(F.coalesce(poi_text, F.lit("")))
    home = F.coalesce(is_home, F.lit(False)) | text.rlike(HOME)
    between = lambda lo, hi: lo + (hi - lo) * u
    out = F.when(home & ((hour >= CURFEW_START) | (hour < CURFEW_END)), between(25200.0, 32400.0)).when(home, between(1800.0, 5400.0))
    for pattern, lo, hi in DWELL[:-1]:
        out = out.when(text.rlike(pattern), between(lo, hi))
    return out.otherwise(between(*DWELL[-1][1:]))


def travel_seconds(nominal: Column, u: Column) -> Column:
    return F.greatest(F.lit(60.0), nominal * (0.8 + 0.55 * u))


#: The coefficients of Lanczos' series for the gamma function (g = 7).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For arguments of at least a half."""
    z = x - 1
    series = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(series)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The regularised incomplete beta function over arrays (a and b of at least a half), by its continued fraction."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(t) + q * np.log1p(-t)) / p
    tiny = 1e-300
    c, d = np.ones_like(t), 1 / np.where(np.abs(1 - (p + q) * t / (p + 1)) < tiny, tiny, 1 - (p + q) * t / (p + 1))
    f = d.copy()
    for m in range(1, rounds):
        last = f
        for num in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if np.nanmax(np.abs(f - last), initial=0) < 1e-13:
            break
    out = np.where((t <= 0), 0.0, np.where(t >= 1, 1.0, np.nan_to_num(front * f)))
    return np.where(swap, 1 - out, out)


def warped(u: Column, a: Column, b: Column) -> Column:
    """The part of the way after a part u of the time, by the distribution function of Beta(a, b)."""

    @F.pandas_udf("double")
    def cdf(x: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(beta_cdf(x.to_numpy(float), p.to_numpy(float), q.to_numpy(float)))

    return cdf(u, a, b)


def intervals_with_curfew(legs: DataFrame, seed: int = 7, hours: int | None = None) -> DataFrame:
    """legs(person_id, step, travel_s, origin_poi, dest_poi, lon0, lat0, lon1, lat1) to the intervals of each person:
    person_id, i, kind (`stay` or `move`), start_s, end_s, lon0, lat0, lon1, lat1.

    A first stay at home (the first origin called a home, else the first origin); before each leg, on days that are not
    free, a stay at home until the next 05:00 if it is night; a dwell at the origin; the move, if it takes time; at last a
    dwell at the destination. The clock of a person is sequential: legs are dealt out by person and walked in order.

    With `hours`, for callers that read no later intervals: a leg takes ten minutes at least, so that those behind the
    (6 hours + 1)th begin beyond the hours asked and are left out before the shuffle: a person is bounded by the clock, not
    by their rows. The home is still sought among all legs.
    """
    u = lambda k: uniform(seed, F.col("person_id"), F.col("step"), F.lit(k))
    person = Window.partitionBy("person_id")
    at = F.struct(F.when(F.lower("origin_poi").rlike(HOME), 0).otherwise(1).alias("k"), "step")
    home = F.min_by(F.struct("lon0", "lat0"), at).over(person)  # not by a join, which would read the legs twice
    legs = legs.filter("person_id is not null").withColumn("_home", home)
    if hours is not None:
        place = F.row_number().over(person.orderBy("step"))
        legs = legs.withColumn("_place", place).filter(F.col("_place") <= 6 * hours + 1).drop("_place")
    rows = legs.withColumns({"home_lon": F.col("_home.lon0"), "home_lat": F.col("_home.lat0"), "u_dwell": u(1), "u_end": u(3), "travel": F.when(F.col("travel_s") > 0, travel_seconds(F.col("travel_s"), u(2)))}).drop("_home")
    kind = dict(legs.dtypes)["person_id"]

    def dwell(text: str | None, hour: float, x: float) -> float:
        t = (text or "").lower()
        if re.search(HOME, t):
            lo, hi = (25200.0, 32400.0) if hour >= CURFEW_START or hour < CURFEW_END else (1800.0, 5400.0)
        else:
            lo, hi = next((lo, hi) for p, lo, hi in DWELL if not p or re.search(p, t))
        return lo + (hi - lo) * x

    def walk(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict = {}
        out: list[tuple] = []

        def add(kind: str, seconds: float, p0: tuple, p1: tuple) -> None:
            out.append((now["id"], now["i"], kind, now["t"], now["t"] + seconds, *p0, *p1))
            now["t"] += seconds
            now["i"] += 1

        def close() -> None:
            if now:
                last = now["last"]
                add("stay", dwell(last.dest_poi, (1 + now["t"] / 3600) % 24, last.u_end), (last.lon1, last.lat1), (last.lon1, last.lat1))

        for part in rows:
            for r in part.itertuples(index=False):
                if not now or now["id"] != r.person_id:
                    close()
                    now = {"id": r.person_id, "i": 0, "t": 0.0, "home": (r.home_lon, r.home_lat), "last": r}
                    add("stay", FIRST_STAY_H * 3600, now["home"], now["home"])
                for _ in range(2):
                    day, hour = int(now["t"] // 86400) + 1, (1 + now["t"] / 3600) % 24
                    if day not in FREE_DAYS and (hour < CURFEW_END or hour >= CURFEW_START):
                        add("stay", ((CURFEW_END - hour) % 24) * 3600, now["home"], now["home"])
                here = (r.lon0, r.lat0)
                add("stay", dwell(r.origin_poi, (1 + now["t"] / 3600) % 24, r.u_dwell), here, here)
                if r.travel == r.travel and r.travel is not None:
                    add("move", r.travel, here, (r.lon1, r.lat1))
                now["last"] = r
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    names = ["person_id", "i", "kind", "start_s", "end_s", "lon0", "lat0", "lon1", "lat1"]
    ordered = rows.repartition("person_id").sortWithinPartitions("person_id", "step")
    return ordered.mapInPandas(walk, f"person_id {kind}, i int, kind string, start_s double, end_s double, lon0 double, lat0 double, lon1 double, lat1 double")


def hourly_positions(intervals: DataFrame, hours: int = HOURS, sample_s: int = SAMPLE_S, warp_seed: int | None = None) -> DataFrame:
    """intervals to person_id, hour (1..hours), lon, lat: the time-weighted mean position of each hour.

    Moves are taken along the straight line between their ends, at a speed that varies: the part of the way is the Beta
    distribution's of the part of the time, its parameters drawn for each move from WARP (no draw, an even speed, without a
    seed). Intervals of no length, and what lies beyond the hours, count
    for nothing; an hour without any has the position of the one before, the hours before the first that of the first
    interval (the home).
    """
    first = F.floor(F.col("start_s") / 3600) + 1
    w = intervals.filter("end_s > start_s and end_s > 0").withColumn("hour", F.explode(F.filter(F.sequence(first, F.greatest(F.ceil(F.col("end_s") / 3600), first)), lambda h: (h >= 1) & (h <= hours))))
    lo, hi = F.greatest("start_s", (F.col("hour") - 1) * 3600.0), F.least("end_s", F.col("hour") * 3600.0)
    w = w.withColumns({"lo": lo, "hi": hi}).filter("hi > lo")
    over = F.col("hi") - F.col("lo")
    n = F.when(F.col("kind") == "move", F.greatest(F.lit(3), F.floor(over / sample_s).cast("int"))).otherwise(F.lit(1))
    s = w.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    mid = F.col("lo") + over * (F.col("k") + 0.5) / F.col("n")
    part = F.when(F.col("kind") == "move", (mid - F.col("start_s")) / (F.col("end_s") - F.col("start_s"))).otherwise(0.0)
    weight = over / F.col("n")
    if warp_seed is not None:
        draw = lambda k: WARP[0] + (WARP[1] - WARP[0]) * uniform(warp_seed, F.col("person_id"), F.col("start_s").cast("bigint"), F.lit(k))
        s = s.withColumns({"_part": part, "_w": weight})
        part, weight = F.when(F.col("kind") == "move", warped(F.col("_part"), draw(1), draw(2))).otherwise(0.0), F.col("_w")
        s, part = s.withColumn("_warped", part), F.col("_warped")
    mean = lambda a, b: F.sum((F.col(a) + part * (F.col(b) - F.col(a))) * weight) / F.sum(weight)
    got = s.groupBy("person_id", "hour").agg(mean("lon0", "lon1").alias("lon"), mean("lat0", "lat1").alias("lat"))
    home = intervals.groupBy("person_id").agg(F.min_by(F.struct(F.col("lon0").alias("lon"), F.col("lat0").alias("lat")), F.struct("start_s", "end_s")).alias("home"))
    grid = home.withColumn("hour", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(hours).cast("bigint"))))
    order = Window.partitionBy("person_id").orderBy("hour")
    full = grid.join(got, ["person_id", "hour"], "left")
    carried = F.last(F.when(F.col("lon").isNotNull(), F.struct("lon", "lat")), ignorenulls=True).over(order)
    p = F.coalesce(carried, F.col("home"))
    return full.select("person_id", F.col("hour").cast("int").alias("hour"), p["lon"].alias("lon"), p["lat"].alias("lat"))


def wide(hourly: DataFrame, value: str, hours: int = HOURS) -> DataFrame:
    """person_id and h001..: one column an hour."""
    return hourly.withColumn("_h", F.format_string("h%03d", "hour")).groupBy("person_id").pivot("_h", [f"h{i:03d}" for i in range(1, hours + 1)]).agg(F.first(value))


def long(frame: DataFrame, value: str, key: str = "person_id") -> DataFrame:
    """Back to key, pt_idx, value; hours without a value go."""
    cols = [c for c in frame.columns if len(c) == 4 and c[0] == "h" and c[1:].isdigit()]
    return frame.unpivot(key, cols, "_h", value).filter(F.col(value).isNotNull()).select(key, F.substring("_h", 2, 3).cast("int").alias("pt_idx"), value)

