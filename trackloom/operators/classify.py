"""Features of a person's path, and the rules that label it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo

#: The categories that the rules look for.
TRAVELER, HOSPITAL = "Traveler Accommodation", "Hospitals"


def steps_of_trips(trips: DataFrame) -> DataFrame:
    """Trips as steps of a path: person_id, step_order from 1, poi (the end, to about 100 m), category, county (a degree
    cell; null north of 26.5), lon, lat."""
    w = Window.partitionBy("person_id").orderBy("start_s", "end_s", "trip_id")
    poi = F.concat_ws(":", F.round("lon1", 3), F.round("lat1", 3))
    kind = F.pmod(F.xxhash64("trip_id"), F.lit(50))
    category = F.when(kind == 0, TRAVELER).when(kind == 1, HOSPITAL).otherwise("Other")
    county = F.when(F.col("lat1") < 26.5, F.floor("lon1").cast("string"))
    return trips.select("person_id", F.row_number().over(w).alias("step_order"), poi.alias("poi"), category.alias("category"), county.alias("county"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat"))


def person_features(steps: DataFrame) -> DataFrame:
    """One aggregation over each person's steps; the home is the first step's place and county."""
    order = F.col("step_order")
    first = lambda c: F.min_by(c, order)
    home = steps.groupBy("person_id").agg(first("lon").alias("home_lon"), first("lat").alias("home_lat"), first("county").alias("home_county"), first("poi").alias("home_poi"))
    far = geo.great_circle(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon")) / 1000
    left = F.coalesce(F.col("county") != F.col("home_county"), F.col("county").isNotNull() & F.col("home_county").isNull())
    return steps.join(home, "person_id").groupBy("person_id").agg(
        (F.count(F.lit(1)) - 1).alias("n_moves"),
        F.countDistinct("poi").alias("n_unique_pois"),
        F.bool_or(F.coalesce(F.col("category") == TRAVELER, F.lit(False))).alias("visited_traveler"),
        F.bool_or(F.coalesce(F.col("category") == HOSPITAL, F.lit(False))).alias("visited_hospital"),
        F.bool_or(left).alias("left_home_county"),
        F.bool_or(F.col("county").isNull()).alias("touched_outside_zone"),
        (F.max_by("poi", order) == F.first("home_poi")).alias("returned_home_end"),
        F.max(far).alias("max_dist_km"),
    )


def trajectory_label() -> Column:
    """The label of a row of person features: the first rule that holds."""
    hotel, hospital, outside = F.col("visited_traveler"), F.col("visited_hospital"), F.col("touched_outside_zone")
    return (
        F.when((F.col("n_moves") == 0) | (F.col("n_unique_pois") <= 1), "sip_home_grocery")
        .when(hotel & outside, "evac_out_of_zone")
        .when(hotel, "evac_short_in_zone")
        .when(hospital, "sip_hospital")
        .otherwise("sip_home_grocery")
    )
