"""Comma-separated records, one a row: the valid ones as columns, the others apart with the reason.

Records are cut by the places of their quote marks, without a character-wise parser and without backtracking: of the
pieces between quote marks every second one stands outside quotes. A record is well quoted if their number is odd and each
piece outside is, between two quoted ones, either nothing (two quote marks: one that is meant) or begins and ends with a
comma; the first ends and the last begins with one. Commas in those pieces part the fields. The cells are exploded to
(row, column, value), joined to a table of rules, tested, the errors gathered by row, and the clean rows found by an
anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of each source file.
LAYOUTS = {
    "Hull_FL_poi_vec_subset": ["PLACEKEY", "LOCATION_NAME", "label_pair", "hex_id", "geometry"],
    "US_POI": ["PLACEKEY", "LOCATION_NAME", "TOP_CATEGORY", "SUB_CATEGORY", "LONGITUDE", "LATITUDE", "REGION"],
}
#: Reasons in the order in which they apply.
REASONS = ["quoting", "column_count", "geometry", "location_name"]
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: A WKT point; blanks are free between its parts.
POINT = rf"^\s*(?i:POINT)\s*\(\s*({NUMBER})\s+({NUMBER})\s*\)\s*$"
#: Characters that no name may hold: controls but tab, line feed and carriage return, U+007F and U+FFFD.
UNREADABLE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFFFD]"
#: White space of Unicode.
WHITE = r"^[\s\x1C-\x1F\x85\u00A0\u1680\u2028\u2029\u202F\u205F\u3000\u2000-\u200A]*$"
_MARK = "\x02"


def _pieces(record: Column) -> Column:
    return F.split(record, '"', -1)


def well_quoted(pieces: Column) -> Column:
    n = F.size(pieces)

    def right(p: Column, i: Column) -> Column:
        inside, first, last = i % 2 == 1, i == 0, i == n - 1
        edge = F.when(first & last, True).when(first, (p == "") | p.endswith(",")).when(last, (p == "") | p.startswith(","))
        return F.when(inside, True).when(first | last, edge).otherwise((p == "") | (p.startswith(",") & p.endswith(",")))

    return (n % 2 == 1) & F.forall(F.transform(pieces, right), lambda x: x)


def fields(pieces: Column) -> Column:
    """The fields of a well quoted record."""
    n = F.size(pieces)

    def part(p: Column, i: Column) -> Column:
        kept = F.replace(p, F.lit(_MARK), F.lit(_MARK + "a"))
        outside = F.when((p == "") & (i > 0) & (i < n - 1), F.lit('"')).otherwise(F.replace(kept, F.lit(","), F.lit(_MARK + "b")))
        return F.when(i % 2 == 1, kept).otherwise(outside)

    joined = F.concat_ws("", F.transform(pieces, part))
    return F.transform(F.split(joined, _MARK + "b", -1), lambda x: F.replace(x, F.lit(_MARK + "a"), F.lit(_MARK)))


def point_ok(value: Column) -> Column:
    """True for a WKT point of two decimal numbers from -180 to 180 and from -90 to 90."""
    lon = F.regexp_extract(value, POINT, 1).try_cast("double")
    lat = F.regexp_extract(value, POINT, 2).try_cast("double")
    return F.coalesce((F.abs(lon) <= 180) & (F.abs(lat) <= 90), F.lit(False))


def name_ok(value: Column) -> Column:
    return ~value.rlike(WHITE) & ~value.rlike(UNREADABLE)


def rules(spark) -> DataFrame:
    """source_file, pos (of a column from 0; -1: of the whole record), rule."""
    rows = [(s, -1, rule) for s in LAYOUTS for rule in ("quoting", "column_count")]
    rows += [(s, c.index("geometry"), "geometry") for s, c in LAYOUTS.items() if "geometry" in c]
    rows += [(s, c.index("LOCATION_NAME"), "location_name") for s, c in LAYOUTS.items()]
    return spark.createDataFrame(rows, "source_file string, pos int, rule string")


def parsed(raw: DataFrame) -> DataFrame:
    """raw_id, source_file, quoted_ok, cells. A null record counts as an empty one; a source_file without a layout is one
    of no known number of columns."""
    p = raw.select("raw_id", "source_file", _pieces(F.coalesce("record", F.lit(""))).alias("pieces"))
    p = p.withColumn("quoted_ok", well_quoted(F.col("pieces")))
    return p.select("raw_id", "source_file", "quoted_ok", F.when(F.col("quoted_ok"), fields(F.col("pieces"))).alias("cells"))


def _widths(source: Column) -> Column:
    c = F.lit(-1)
    for name, cols in LAYOUTS.items():
        c = F.when(source == name, len(cols)).otherwise(c)
    return c


def failures(raw: DataFrame) -> DataFrame:
    """raw_id, reason: each faulty record of raw(raw_id, source_file, record) with the first reason that applies."""
    p = parsed(raw)
    whole = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("value"))
    single = F.transform(F.col("cells"), lambda v, i: F.struct(i.alias("pos"), v.alias("value")))
    width = F.size("cells") == _widths(F.col("source_file"))
    cells = p.select("raw_id", "source_file", "quoted_ok", F.coalesce(width, F.lit(False)).alias("width_ok"), F.explode(F.when(width, F.concat(F.array(whole), single)).otherwise(F.array(whole))).alias("cell"))
    table = rules(raw.sparkSession)
    known = F.coalesce(F.col("source_file").isin(list(LAYOUTS)), F.lit(False))
    tested = cells.withColumns({"pos": F.col("cell.pos"), "source_file": F.when(known, F.col("source_file")).otherwise(next(iter(LAYOUTS)))}).join(F.broadcast(table), ["source_file", "pos"])
    v = F.col("cell.value")
    fails = (
        F.when(F.col("rule") == "quoting", ~F.col("quoted_ok"))
        .when(F.col("rule") == "column_count", F.col("quoted_ok") & ~F.col("width_ok"))
        .when(F.col("rule") == "geometry", ~point_ok(v))
        .when(F.col("rule") == "location_name", ~name_ok(v))
    )
    rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("rule"))
    return tested.filter(fails).groupBy("raw_id").agg(F.min_by("rule", rank).alias("reason"))


def valid_rows(raw: DataFrame, source_file: str) -> DataFrame:
    """The valid records of one source file as raw_id and its columns, all strings."""
    good = parsed(raw.filter(F.col("source_file") == source_file)).join(failures(raw), "raw_id", "left_anti")
    return good.select("raw_id", *[F.col("cells")[i].alias(c) for i, c in enumerate(LAYOUTS[source_file])])
