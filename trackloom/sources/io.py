"""Readers and writers of the entities: Parquet, CSV, GeoJSON, WKB and WKT geometry, saved test runs, text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom import shared
from trackloom.functions import geo
from trackloom.functions.columns import joined_text, resolve_column
from trackloom.operators.numbering import numbered

TRIPS = T.StructType([T.StructField(n, T.StringType() if n in ("participantId", "tripStartDate", "tripEndDate") else T.DoubleType()) for n in ("participantId", "tripStartDate", "tripEndDate", "tripStartLongitude", "tripStartLatitude", "tripEndLongitude", "tripEndLatitude")])
PLACES = T.StructType([T.StructField(n, T.DoubleType() if n in ("LONGITUDE", "LATITUDE") else T.StringType()) for n in ("PLACEKEY", "LOCATION_NAME", "TOP_CATEGORY", "SUB_CATEGORY", "LONGITUDE", "LATITUDE", "REGION")])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """With point, struct<lon, lat>, where the geometry is a WKB point; others keep their bytes only."""
    return spark.read.parquet(path).withColumn("point", geo.wkb_point(F.col(geometry)))


def read_hexes(spark: SparkSession, path: str, key: str = "GEOID") -> DataFrame:
    """Cells with hex_id, a number from 0 in the order of a key that tells them apart."""
    return numbered(spark.read.parquet(path).drop("hex_id"), key, name="hex_id")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """With a header; quote marks inside quotes doubled. Multi-line files are not split, so keep them moderate in size."""
    return spark.read.schema(schema).options(header=True, sep=sep, quote='"', escape='"', multiLine=multi_line).csv(path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """The places of a quoted CSV that may break lines; with `point` from WKT if it has a geometry column."""
    return read_csv(spark, path, PLACES, multi_line=True)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Simulated steps in the order of persons and steps, poi_name from label_pair where it is missing."""
    df = spark.read.options(header=True, inferSchema=True).csv(path)
    names = [c for c in ("poi_name", "label_pair") if c in df.columns]
    df = df.withColumn("poi_name", F.coalesce(*[F.col(c) for c in names])) if names else df
    return df.orderBy(*[c for c in ("person_id", "step") if c in df.columns] or df.columns[:1])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The features of collections: properties (as a map of text), kind, and coordinates as JSON."""
    raw = spark.read.text(path, wholetext=True)
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    f = raw.select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    return f.select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet through pandas, where its optional reader is installed; a sheet has about a million rows at most."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def read_network(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    n = spark.read.parquet(nodes)
    return n.withColumns({resolve_column(n, [c]): F.col(resolve_column(n, [c])).cast("double") for c in ("x", "y")}), spark.read.parquet(edges)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_routes(df: DataFrame, path: str) -> bool:
    """False, and nothing written, for an empty table."""
    if df.isEmpty():
        return False
    write_parquet(df, path)
    return True


def geojson_features(df: DataFrame, line: str, *properties: str) -> DataFrame:
    """One feature a row, as text: a point for one position, else a line (array<struct<lon, lat>>)."""
    xy = F.transform(line, lambda p: F.array(p["lon"], p["lat"]))
    props = F.struct(*properties) if properties else F.create_map()
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.get(xy, 0).alias("coordinates")).alias("geometry"), props.alias("properties")))
    path = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates")).alias("geometry"), props.alias("properties")))
    return df.filter(F.size(line) > 0).select(F.when(F.size(line) == 1, point).otherwise(path).alias("value"))


def write_geojson_lines(df: DataFrame, path: str, line: str, *properties: str) -> None:
    geojson_features(df, line, *properties).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, line: str, *properties: str) -> None:
    """As FeatureCollections, one in each file written."""

    def collection(parts):
        import pyarrow as pa

        begun = False
        for b in parts:
            if b.num_rows:
                head = "," if begun else '{"type":"FeatureCollection","features":['
                begun = True
                yield pa.RecordBatch.from_pydict({"value": pa.array([head + ",\n".join(b["value"].to_pylist())], pa.string())})
        if begun:
            yield pa.RecordBatch.from_pydict({"value": pa.array(["]}"], pa.string())})

    geojson_features(df, line, *properties).mapInArrow(collection, "value string").write.mode("overwrite").text(path)


def save_model(model, path: str) -> None:
    """A fitted model (anything of MLlib that can be written)."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """What save_model wrote, as the class it was."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, spark)


def popup_html(*columns: str):
    """A table row for each column, as an HTML popup."""
    cells = [F.concat(F.lit(f"<tr><th>{c}</th><td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td></tr>")) for c in columns]
    return F.concat(F.lit("<table>"), *cells, F.lit("</table>"))


def save_run(spark: SparkSession, folder: str, pvalues: DataFrame, observed: DataFrame, null: DataFrame | None, **meta) -> None:
    """A permutation run: three tables and what it was made with. The null is kept by draw (`b`)."""
    write_parquet(pvalues, f"{folder}/pvals")
    write_parquet(observed, f"{folder}/observed")
    if null is not None:
        write_parquet(null, f"{folder}/null")
    shared.write_text(spark, f"{folder}/meta.json", json.dumps(meta | {"null": null is not None}, sort_keys=True))


def load_run(spark: SparkSession, folder: str) -> dict:
    meta = json.loads(shared.read_text(spark, f"{folder}/meta.json") or "{}")
    out = {"meta": meta, "pvals": spark.read.parquet(f"{folder}/pvals"), "observed": spark.read.parquet(f"{folder}/observed")}
    if meta.get("null"):
        out["null"] = spark.read.parquet(f"{folder}/null")
    if out["pvals"].count() != out["observed"].count():
        raise ValueError("p-values and statistics differ in number")
    return out


def write_report(text: str, path: str) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


def place_text(places: DataFrame) -> DataFrame:
    """PLACEKEY, concatenated: both categories and the name as one text."""
    return places.select("PLACEKEY", joined_text(F.col("TOP_CATEGORY"), F.col("SUB_CATEGORY"), F.col("LOCATION_NAME")).alias("concatenated"))
