"""Column expressions for text, keys, labels, time of day and vectors. All are Catalyst expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a missing category, and what parts the levels of one.
NULL_LABEL, SEP = "<null_val>", "[sep]"
#: Fixed value: hours of a visit series, numbered from 1.
HOURS = 143


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str:
    """The first candidate that the frame has, whatever its case."""
    have = {c.lower(): c for c in reversed(df.columns)}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise KeyError(f"none of {list(candidates)} among {df.columns}")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} are missing")
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The frame, if no key occurs twice (the build side of a many-to-one join); null keys count as keys."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"keys {keys} are not unique")
    return df


def norm_token(c: Column) -> Column:
    """Without outer blanks; NULL_LABEL for a null or nothing."""
    t = F.trim(c.cast("string"))
    return F.when(c.isNull() | (t == ""), NULL_LABEL).otherwise(t)


def class_key(top: Column, sub: Column) -> Column:
    return F.concat(norm_token(top), F.lit(SEP), norm_token(sub))


def normalize_key(c: Column) -> Column:
    """A written key with both its parts normalised; one without a separator has NULL_LABEL as the second."""
    rest = F.when(F.instr(c, SEP) > 0, F.expr(f"substring({_name(c)}, instr({_name(c)}, '{SEP}') + {len(SEP)})")) if _name(c) else None
    second = rest if rest is not None else F.lit(None)
    return class_key(F.substring_index(c, SEP, 1), second)


def _name(c: Column) -> str:
    text = str(c)
    inner = text[text.find("'") + 1 : text.rfind("'")]
    return f"`{inner}`" if inner.replace("_", "").isalnum() else ""


def category(c: Column) -> Column:
    """What stands before the first separator, taken literally."""
    return F.substring_index(c, SEP, 1)


def joined_text(*columns: Column) -> Column:
    """Columns with SEP between, missing ones as NULL_LABEL."""
    return F.concat_ws(SEP, *[F.coalesce(c.cast("string"), F.lit(NULL_LABEL)) for c in columns])


def parse_vector(c: Column) -> Column:
    """`[1.0 2.0 ...]` as text to an array of floats; what is no number becomes null."""
    inner = F.trim(F.regexp_replace(c, r"[\[\]]", ""))
    return F.when(inner == "", F.array().cast("array<float>")).otherwise(F.transform(F.split(inner, r"\s+"), lambda x: x.try_cast("float")))


def first_integer(c: Column) -> Column:
    """The first signed integer in a text, null if there is none."""
    return F.regexp_extract(c.cast("string"), r"-?\d+", 0).try_cast("int")


def is_evacuation(c: Column) -> Column:
    return F.coalesce(F.lower(c).startswith("evac"), F.lit(False)).cast("int")


def hour_bucket(pt_idx: Column, width: int = 4) -> Column:
    return (F.floor(pt_idx / width) * width).cast("int")


def time_slot(pt_idx: Column, length: int = HOURS) -> Column:
    """Steps from 1 to slots from 0, clipped into the series."""
    return F.greatest(F.lit(0), F.least(F.lit(length - 1), pt_idx - 1)).cast("int")


def hour_from_start(i: Column, start_hour: int = 0) -> Column:
    return F.pmod(i + start_hour, F.lit(24)).cast("int")


def day_of_seconds(t: Column) -> Column:
    return (F.floor(t / 86400) + 1).cast("int")


def hour_of_seconds(t: Column) -> Column:
    """The clock starts at 01:00."""
    return F.pmod(F.floor(t / 3600) + 1, F.lit(24)).cast("int")


def cyclic(hour: Column, harmonics: int = 1) -> list[Column]:
    """sin and cos of the hour of the day, for each harmonic: columns sin1, cos1, ..."""
    out = []
    for m in range(1, harmonics + 1):
        angle = hour * (m * 2 * math.pi / 24)
        out += [F.sin(angle).alias(f"sin{m}"), F.cos(angle).alias(f"cos{m}")]
    return out


def sinusoidal(pos: Column, dim: Column, width: int) -> Column:
    """Absolute position features: sin at even dimensions, cos at odd ones."""
    angle = pos * F.exp((F.floor(dim / 2) * 2) * (-math.log(10000.0) / width))
    return F.when(dim % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-12) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + eps))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, x: t + x))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y))


def top_k(a: Column, k: int) -> Column:
    """The k largest of an array with their places, largest first, ties to the smaller place: array<struct<p, i>>."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("p"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["p"]).alias("p"), s["i"].alias("i")))


def compacted(a: Column) -> Column:
    """Without elements equal to the one before them."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def ordered_list(order: Column, value: Column) -> Column:
    """Aggregate: values in the order of a key that must be unique in the group."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def uniform(seed: int, *keys: Column) -> Column:
    """A number in 0..1 that depends on the seed and keys only."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def mixer(x: Column, seed: int = 1) -> Column:
    """A number in 0..2147483646 from a bigint by a multiplicative generator, the same in any engine."""
    p = 2147483647
    return F.pmod(F.pmod(x, F.lit(p)) * 48271 + seed * 12345 + 1, F.lit(p)) * 16807 % p


def colour(key: Column, colours: int = 10) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(colours)).cast("int")
