"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom import shared


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """df with a number from 0 in the given order, which must tell rows apart: rows are sorted by range, and only the sizes
    of the partitions come to the driver."""
    held = shared.stored(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_mid", 33).cast("int")
    sizes = {r["p"]: r["count"] for r in held.groupBy(part.alias("p")).count().collect()}
    rows, at = [], 0
    for p in sorted(sizes):
        rows.append((p, at))
        at += sizes[p]
    begins = df.sparkSession.createDataFrame(rows, "_part int, _begin bigint")
    joined = held.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return joined.withColumn(name, F.col("_begin") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_begin")
