"""Readers of formats that cannot be split: shapefiles, GeoPackage layers, GraphML, arrays and vectors of words. A file is read
whole by one task; many files are many tasks."""

from __future__ import annotations

import io
import re
import sqlite3
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "file string, fid bigint, kind string, geometry binary, properties map<string, string>"
#: Bytes of a GeoPackage geometry's envelope by its code.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _wkb_lines(code: int, parts: list[np.ndarray]) -> bytes:
    """A polygon (3) of rings, or a multi-line (5) of lines."""
    body = b"".join((b"" if code == 3 else struct.pack("<BI", 1, 2)) + struct.pack("<I", len(p)) + p.astype("<f8").tobytes() for p in parts)
    return struct.pack("<BII", 1, code, len(parts)) + body


def shapes(raw: bytes) -> Iterator[tuple[str, bytes | None]]:
    """Kind and WKB of each record of a shapefile: points, lines and polygons (a polygon's rings in one, told apart by parity)."""
    at = 100
    while at + 8 <= len(raw):
        size = struct.unpack(">i", raw[at + 4 : at + 8])[0] * 2
        body = raw[at + 8 : at + 8 + size]
        at += 8 + size
        code = struct.unpack("<i", body[:4])[0] % 10 if len(body) >= 4 else 0
        if code == 1:
            yield "point", struct.pack("<BI", 1, 1) + body[4:20]
        elif code in (3, 5):
            n, m = struct.unpack("<ii", body[36:44])
            begins = [*np.frombuffer(body, "<i4", n, 44).tolist(), m]
            xy = np.frombuffer(body, "<f8", 2 * m, 44 + 4 * n).reshape(m, 2)
            parts = [xy[a:b] for a, b in zip(begins, begins[1:], strict=False)]
            yield ("line", _wkb_lines(5, parts)) if code == 3 else ("polygon", _wkb_lines(3, parts))
        else:
            yield "none", None


def records(raw: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """The rows of a dBASE table as text, deleted ones included (they keep their place)."""
    n, head, width = struct.unpack("<IHH", raw[4:12])
    fields = [(raw[i : i + 11].split(b"\0")[0].decode(encoding, "replace"), raw[i + 16]) for i in range(32, head - 1, 32)]
    for r in range(n):
        at, row = head + r * width + 1, {}
        for name, size in fields:
            row[name] = raw[at : at + size].decode(encoding, "replace").strip()
            at += size
        yield row


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """path of .shp files (a pattern may be given), with the .dbf beside each where there is one: file, fid, kind, geometry (WKB)
    and properties."""
    tables = re.sub(r"[.]shp$", ".dbf", path)
    both = _files(spark, [path, tables] if _exists(spark, tables) else path)
    base = F.regexp_replace("path", r"\.[^.]*$", "")

    def read(g: pd.DataFrame) -> pd.DataFrame:
        raw = {p.rpartition(".")[2].lower(): bytes(c) for p, c in zip(g["path"], g["content"], strict=True)}
        rows = list(records(raw["dbf"])) if "dbf" in raw else []
        out = [(g["base"].iloc[0], i, kind, wkb, rows[i] if i < len(rows) else {}) for i, (kind, wkb) in enumerate(shapes(raw.get("shp", b"")))]
        return pd.DataFrame(out, columns=["file", "fid", "kind", "geometry", "properties"])

    return both.withColumn("base", base).groupBy("base").applyInPandas(read, _FEATURE)  # the two files of one shapefile


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_geopackage(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """file, fid, kind, geometry (WKB) and properties of a layer of GeoPackage files."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                found = db.execute("select column_name, geometry_type_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
                column, kind = found if found else (None, "none")
                cursor = db.execute('select rowid, * from "' + layer.replace('"', '""') + '"')
                names = [d[0] for d in cursor.description][1:]
                out = []
                for row in cursor:
                    values = dict(zip(names, row[1:], strict=True))
                    blob = values.pop(column, None) if column else None
                    wkb = bytes(blob[8 + ENVELOPE.get((blob[3] >> 1) & 7, 0) :]) if blob and blob[:2] == b"GP" else None
                    out.append((name, row[0], kind.lower(), wkb, {k: str(v) for k, v in values.items() if v is not None}))
                yield pd.DataFrame(out, columns=["file", "fid", "kind", "geometry", "properties"])

    return _files(spark, path).mapInPandas(read, _FEATURE)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Of GraphML files: nodes(id, x, y, attributes) and edges(u, v, attributes), attributes as text; x and y are numbers."""

    def parse(what: str):
        def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for content in part["content"]:
                    root = ET.fromstring(bytes(content))
                    space = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
                    names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{space}key")}
                    rows = []
                    for e in root.iter(space + what):
                        data = {names.get(d.get("key"), d.get("key")): d.text for d in e.findall(f"{space}data") if d.text is not None}
                        rows.append((e.get("id"), data.get("x"), data.get("y"), data) if what == "node" else (e.get("source"), e.get("target"), data))
                    yield pd.DataFrame(rows, columns=["id", "x", "y", "attributes"] if what == "node" else ["u", "v", "attributes"])

        return read

    files = _files(spark, path)
    nodes = files.mapInPandas(parse("node"), "id string, x string, y string, attributes map<string, string>")
    return nodes.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("x", "y")}), files.mapInPandas(parse("edge"), "u string, v string, attributes map<string, string>")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The rows of .npy and .npz files: file, name (of the array in an .npz), row, x. Nothing pickled is read."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                got = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                for key, a in ({"": got} if isinstance(got, np.ndarray) else dict(got)).items():
                    flat = np.asarray(a, float).reshape(len(a), -1) if np.ndim(a) else np.asarray(a, float).reshape(1, 1)
                    for s in range(0, len(flat), 10_000):
                        some = flat[s : s + 10_000]
                        yield pd.DataFrame({"file": name, "name": key, "row": np.arange(s, s + len(some)), "x": list(some)})

    return _files(spark, path).mapInPandas(read, "file string, name string, row bigint, x array<double>")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, x of vectors in text, a word and its numbers a line; a first line of two numbers (how many, how wide) is left out."""
    parts = F.split(F.btrim("value"), " +")
    return spark.read.text(path).filter(F.size(parts) > 2).select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, 2, 1_000_000), lambda v: v.cast("double")).alias("x"))
