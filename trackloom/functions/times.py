"""Times of trips as text, read by Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: yyyy-mm-dd, a blank or T, hh:mm:ss, an optional fraction of zeros, Z or an offset.
WRITTEN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.0+)?(Z|[+-]\d{2}:\d{2})$"
#: Characters counted as blanks around a key.
BLANKS = " \t\r\n\u00a0"


def trim_blanks(c: Column) -> Column:
    """Without outer blanks; null where nothing is left."""
    t = F.btrim(c, F.lit(BLANKS))
    return F.when(F.length(t) > 0, t)


def written_seconds(c: Column) -> Column:
    """Seconds since 1970-01-01 UTC of a written date, null for any other text, impossible dates and clock times included."""
    number = lambda at: F.substring(c, at, 2).try_cast("int")
    hour, minute, second = number(12), number(15), number(18)
    zulu = c.endswith("Z")
    off_h, off_m = F.substring(c, -5, 2).try_cast("int"), F.substring(c, -2, 2).try_cast("int")
    sign = F.when(F.substring(c, -6, 1) == "-", -1).otherwise(1)
    offset = F.when(zulu, 0).when((off_h < 24) & (off_m < 60), sign * (off_h * 3600 + off_m * 60))
    day = F.unix_date(F.substring(c, 1, 10).try_cast("date"))
    there = c.rlike(WRITTEN) & (F.substring(c, 1, 4) != "0000") & (hour < 24) & (minute < 60) & (second < 60)
    return F.when(there, day.cast("bigint") * 86400 + hour * 3600 + minute * 60 + second - offset)


def usable_trips(trips: DataFrame, *extra: str) -> DataFrame:
    """participantId without outer blanks, start_s and end_s of the usable trips (and extra columns as they stand).

    Not usable: a participant that is null or blank, a date that is null, of another form, impossible on the calendar or
    clock, an end before its start. Ends equal to starts are usable.
    """
    t = trips.select(
        trim_blanks(F.col("participantId")).alias("participantId"),
        written_seconds(F.col("tripStartDate")).alias("start_s"),
        written_seconds(F.col("tripEndDate")).alias("end_s"),
        *extra,
    )
    return t.filter("participantId is not null and start_s is not null and end_s >= start_s")
