"""Series by key and integer step: gaps filled, smoothed, and their power by period.

Built-ins wherever a series can be told row by row; local regressions and spectra, which need a whole series at once, run
as Arrow functions grouped by the series' key (a series is as long as its hours, not as the data).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interpolated(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Nulls of value filled linearly between the neighbours that are there, beyond the ends with the nearest of them; a
    series without any value stays null. NaN counts as null."""
    w = Window.partitionBy(key).orderBy(step)
    v = F.when(~F.isnan(value), F.col(value))
    at = F.when(v.isNotNull(), F.struct(F.col(step).alias("s"), v.alias("v")))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumns({"_a": before, "_b": after})
    a, b = F.col("_a"), F.col("_b")
    part = (F.col(step) - a["s"]) / F.when(b["s"] != a["s"], b["s"] - a["s"])
    filled = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).when(b["s"] == a["s"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * part)
    return d.withColumn(value, filled).drop("_a", "_b")


def ema(values: Column, alpha: float) -> Column:
    """y0 = x0, y = (1 - alpha) y + alpha x over an array without nulls: an array of the same length."""
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("all"))

    def step(t: Column, x: Column) -> Column:
        y = F.coalesce(t["y"] * (1 - alpha) + x * alpha, x.cast("double"))
        return F.struct(y.alias("y"), F.concat(t["all"], F.array(y)).alias("all"))

    return F.aggregate(values, zero, step)["all"]


def ema_last(values: Column, alpha: float) -> Column:
    return F.aggregate(values, F.lit(None).cast("double"), lambda y, x: F.coalesce(y * (1 - alpha) + x * alpha, x.cast("double")))


def smoothed(df: DataFrame, key: str, step: str, value: str, span: int = 15) -> DataFrame:
    """key, step, value, smooth: the exponential mean with alpha 2 / (span + 1), not adjusted; null values are left out."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(step), F.col(value)))).alias("s"))
    got = rows.withColumn("y", ema(F.transform("s", lambda x: x[value]), 2 / (span + 1)))
    return got.select(key, F.explode(F.arrays_zip("s", "y")).alias("z")).select(key, f"z.s.{step}", f"z.s.{value}", F.col("z.y").alias("smooth"))


def savgol_weights(window: int, order: int, at: int) -> np.ndarray:
    """What gives the least-squares polynomial of a window at one of its places."""
    x = np.arange(window) - at
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def savgol(df: DataFrame, key: str, step: str, value: str, window: int = 11, order: int = 2) -> DataFrame:
    """Savitzky-Golay: fixed weights in the middle of a series, the first and last window's polynomial at its ends; series
    shorter than the window come out as they are. Values must be there at every step."""
    half = window // 2
    weights = [savgol_weights(window, order, i).tolist() for i in range(window)]
    w = Window.partitionBy(key).orderBy(step)
    whole = Window.partitionBy(key)
    n, r = F.count(F.lit(1)).over(whole), F.row_number().over(w) - 1
    d = df.withColumns({"_n": n, "_r": r})
    begin = F.greatest(F.lit(0), F.least(F.col("_r") - half, F.col("_n") - window))
    d = d.withColumn("_at", F.col("_r") - begin)
    near = F.collect_list(value).over(w.rowsBetween(-(window - 1), window - 1))  # 2 window - 1 values
    first = F.least(F.col("_r"), F.lit(window - 1))
    taken = F.slice(near, (first - F.col("_at") + 1).cast("int"), window)
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in weights])
    y = F.aggregate(F.zip_with(taken, F.get(table, F.col("_at").cast("int")), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return d.withColumn("_w", taken).withColumn("smooth", F.when(F.col("_n") >= window, y).otherwise(F.col(value))).drop("_n", "_r", "_at", "_w")


def loess_fit(x: np.ndarray, y: np.ndarray, frac: float) -> np.ndarray:
    """Local linear regression with tricube weights on the nearest part of the points, without robustness rounds."""
    n = len(x)
    k = min(n, max(2, int(math.ceil(frac * n))))
    out = np.empty(n)
    for i in range(n):
        d = np.abs(x - x[i])
        near = np.argsort(d, kind="stable")[:k]
        far = d[near].max()
        w = (1 - np.minimum(d[near] / far, 1) ** 3) ** 3 if far > 0 else np.ones(k)
        a, b = x[near] - x[i], y[near]
        s0, s1, s2 = w.sum(), (w * a).sum(), (w * a * a).sum()
        det = s0 * s2 - s1 * s1
        out[i] = ((w * b).sum() * s2 - (w * a * b).sum() * s1) / det if det > 1e-12 * max(s0 * s2, 1e-300) else (w * b).sum() / s0
    return out


def loess(df: DataFrame, key: str, step: str, value: str, frac: float = 0.12) -> DataFrame:
    """key, step, value, smooth by loess_fit, one series at a time; null values are left out."""
    schema = df.select(key, step, F.col(value).cast("double")).schema.add("smooth", "double")

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        s = series.sort_values(step)
        return s.assign(smooth=loess_fit(s[step].to_numpy(float), s[value].to_numpy(float), frac))

    return df.select(key, step, F.col(value).cast("double")).filter(F.col(value).isNotNull()).groupBy(key).applyInPandas(fit, schema)


def periodogram(y: np.ndarray, detrend: bool = True, whiten: bool = False, taper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Periods and power of the real Fourier transform without the constant; whiten takes first differences."""
    y = np.asarray(y, float)
    if whiten:
        y = np.diff(y)
    if detrend and len(y) > 1:
        x = np.arange(len(y))
        y = y - np.polyval(np.polyfit(x, y, 1), x)
    if taper:
        y = y * np.hanning(len(y))
    power = np.abs(np.fft.rfft(y)) ** 2 / max(len(y), 1)
    freq = np.fft.rfftfreq(len(y))
    return 1 / freq[1:], power[1:]


def welch(y: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean power of half-overlapping tapered segments, each without its mean."""
    y = np.asarray(y, float)
    segment = min(segment, len(y))
    taper = np.hanning(segment + 1)[:-1]
    parts = [y[i : i + segment] for i in range(0, len(y) - segment + 1, max(segment // 2, 1))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * taper)) ** 2 for p in parts], axis=0) / (taper**2).sum()
    power[1 : len(power) - (segment % 2 == 0)] *= 2
    return 1 / np.fft.rfftfreq(segment)[1:], power[1:]


def spectrum(df: DataFrame, key: str, step: str, value: str, method: str = "periodogram", **options) -> DataFrame:
    """key, period, power for each series, gaps interpolated first; series of fewer than 4 steps give no rows."""
    filled = interpolated(df.select(key, step, F.col(value).cast("double")), key, step, value)
    kind = dict(filled.dtypes)[key]

    def transform(series: pd.DataFrame) -> pd.DataFrame:
        y = series.sort_values(step)[value].to_numpy(float)
        if len(y) < 4 or np.isnan(y).any():
            return pd.DataFrame({key: [], "period": [], "power": []})
        period, power = welch(y, options.get("segment", 64)) if method == "welch" else periodogram(y, **options)
        return pd.DataFrame({key: series[key].iloc[0], "period": period, "power": power})

    return filled.groupBy(key).applyInPandas(transform, f"`{key}` {kind}, period double, power double")


def dft_power(df: DataFrame, key: str, step: str, value: str, periods: list[int]) -> DataFrame:
    """key, period, power at chosen whole periods by sums of sines and cosines alone: one aggregation."""
    p = F.explode(F.array(*[F.lit(float(x)) for x in periods])).alias("period")
    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(step).alias("_t"), F.col(value).alias("_v"), p)
    angle = F.col("_t") * (2 * math.pi) / F.col("period")
    g = rows.groupBy(key, "period").agg(F.sum(F.col("_v") * F.cos(angle)).alias("c"), F.sum(F.col("_v") * F.sin(angle)).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select(key, "period", ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")).alias("power"))


def most_dynamic(df: DataFrame, series: str, value: str, k: int) -> DataFrame:
    """The series of the largest sample variance, ties by name: series, variance."""
    return df.groupBy(series).agg(F.var_samp(value).alias("variance")).orderBy(F.desc(F.round("variance", 9)), series).limit(k)
