"""How often every distinct term occurs over a whole collection, and in how many records.

A global dictionary numbers the distinct terms; records are taken in blocks, each encoded and counted into arrays (of
occurrences, and of records that hold the term), of which only the part that is not zero travels; the arrays are summed by
range of identifiers. A term that a third of all records hold is one number per block when the shuffle begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom import shared

NULL_TERM = "<null_val>"
#: Identifiers summed by one array.
RANGE = 65_536


def compared(c: Column) -> Column:
    """In lower case, every run of blanks, tabs and no-break spaces one blank and none at the ends; NULL_TERM for a null
    or where nothing is left."""
    t = F.btrim(F.regexp_replace(F.lower(c), "[ \\t\\u00A0]+", " "))
    return F.when(t != "", t).otherwise(NULL_TERM)


def dictionary(terms: DataFrame) -> DataFrame:
    """terms(field, term) to a stored table field, term, id: ids from 0 without holes, each partition of the distinct terms
    holding one run of them. Only one number per partition comes to the driver."""
    mid = F.monotonically_increasing_id()
    held = shared.stored(terms.select("field", "term").filter("field is not null and term is not null").distinct().withColumn("mid", mid), "terms")
    part = F.shiftright("mid", 33).cast("int")
    sizes = {r["part"]: r["count"] for r in held.groupBy(part.alias("part")).count().collect()}
    rows, at = [], 0
    for p in sorted(sizes):
        rows.append((p, at))
        at += sizes[p]
    begins = held.sparkSession.createDataFrame(rows, "part int, begin bigint")
    numbered = held.withColumn("part", part).join(F.broadcast(begins), "part")
    return numbered.select("field", "term", (F.col("begin") + F.col("mid").bitwiseAND((1 << 33) - 1)).alias("id"))


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, terms) to (field, term, occurrences, records) of each block."""
    for b in batches:
        for field in pc.unique(b["field"]).to_pylist():
            if field is None:
                continue
            lists = b.filter(pc.equal(b["field"], field))["terms"]
            flat = lists.flatten()
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            there = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            coded = flat.filter(pa.array(there)).dictionary_encode()
            code, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row[there].astype(np.int64)
            n = len(coded.dictionary)
            occurrences = np.bincount(code, minlength=n)
            pairs = np.unique(row * max(n, 1) + code)
            records = np.bincount(pairs % max(n, 1), minlength=n)
            yield pa.RecordBatch.from_pydict({"field": pa.array([field] * n, pa.string()), "term": coded.dictionary, "occurrences": occurrences.astype(np.int64), "records": records.astype(np.int64)})


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, occurrences, records), whole ranges of identifiers in a partition, to their sums."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        ids = b["id"].to_numpy()
        for r in np.unique(ids // RANGE):
            own = ids // RANGE == r
            total = sums.setdefault(int(r), np.zeros((2, RANGE), np.int64))
            for k, c in enumerate(("occurrences", "records")):
                np.add.at(total[k], ids[own] - r * RANGE, b[c].to_numpy()[own])
    for r, total in sums.items():
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_pydict({"id": at + r * RANGE, "occurrences": total[0][at], "records": total[1][at]})


def term_frequencies(records: DataFrame, least: int = 3, most_share: float = 0.05) -> DataFrame:
    """records(field string, terms array<string>), one row per record and field, to field, term, id, occurrences, records,
    mark: `rare` in fewer than `least` records of the field, else `common` in more than `most_share` of them, else null.

    Null terms count for nothing, but a record with a null or empty list still counts as a record. Rows repeated count
    again. An empty input gives no rows.
    """
    counts = shared.stored(records.select("field", "terms").mapInArrow(_count_block, "field string, term string, occurrences bigint, records bigint"), "blocks")
    named = dictionary(counts)
    # combined before the join, so that a term of every block is one row of it
    blocks = counts.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    encoded = blocks.join(named, ["field", "term"]).select("id", "occurrences", "records")
    summed = encoded.repartition(F.floor(F.col("id") / RANGE)).mapInArrow(_sum_ranges, "id bigint, occurrences bigint, records bigint")
    totals = records.groupBy("field").agg(F.count(F.lit(1)).alias("all_records"))
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") > F.col("all_records") * most_share, "common")
    return named.join(summed, "id").join(F.broadcast(totals), "field").select("field", "term", "id", "occurrences", "records", mark.alias("mark"))
