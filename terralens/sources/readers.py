"""Sources: files as tables of text, optional files, GeoJSON, documents, vectors."""

from __future__ import annotations

import io
import logging
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.functions.conform import missing_columns, number
from terralens.operators.retrieval import post_json
from terralens.schema import BBOX, HOTSPOT
from terralens.sources import tiff, workbook

log = logging.getLogger(__name__)


def text_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, every cell a string: codes keep their zeros. Columns are
    matched by name; a column of the schema that the file lacks is null."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    want = spark.createDataFrame([], schema).columns
    have = set(found.columns)
    return found.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in want])


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with an explicit typed schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``text_csv``; a missing file is an empty table."""
    return text_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def hotspots(spark: SparkSession, paths: dict[str, str], box: tuple = BBOX) -> DataFrame:
    """Hot-spot products by sensor name, one table. A missing product is passed
    over; rows without usable coordinates or outside the box are dropped."""
    out = None
    for sensor, path in paths.items():
        if not exists(spark, path):
            continue
        t = text_csv(spark, path, HOTSPOT)
        t = t.select(
            F.lit(sensor).alias("sensor"), number("latitude").alias("lat"), number("longitude").alias("lon"),
            F.col("acq_date").try_cast("date").alias("acq_date"), number("frp", 0.0).alias("frp"), "confidence", "daynight",
        )
        t = t.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
        out = t if out is None else out.unionByName(t)
    return out if out is not None else spark.createDataFrame([], "sensor string, lat double, lon double, acq_date date, frp double, confidence string, daynight string")


def geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(cod, mpio, dpto, ring, ord) of a FeatureCollection: the exterior ring of each polygon."""
    schema = "features array<struct<properties:struct<cod:bigint,mpio:string,dpto:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("ord", "f"))
    ring = F.transform(F.element_at("f.geometry.coordinates", 1), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return f.filter(F.col("f.geometry.type") == "Polygon").select("f.properties.cod", "f.properties.mpio", "f.properties.dpto", ring.alias("ring"), "ord")


def json_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with their metadata in one Parquet table."""
    return spark.read.parquet(path)


def least_cloudy(catalogue: DataFrame, box: tuple, first: str, last: str, max_cloud: float, group: str) -> DataFrame:
    """The scene with the fewest clouds per group, of those in the box, the dates
    and under the limit. ``catalogue`` has item, date, cloud and its bounds."""
    lon0, lat0, lon1, lat1 = box
    near = (F.col("lon_max") >= lon0) & (F.col("lon_min") <= lon1) & (F.col("lat_max") >= lat0) & (F.col("lat_min") <= lat1)
    ok = catalogue.filter(near & F.col("date").between(first, last) & (F.col("cloud") < max_cloud))
    return ok.groupBy(group).agg(F.min(F.struct("cloud", "item", "date")).alias("s")).select(group, "s.item", "s.date", "s.cloud")


def fetched_hotspots(spark: SparkSession, urls: dict[str, str], folder: str, box: tuple = BBOX, get=None) -> DataFrame:
    """Download hot-spot products by sensor name to a folder and read them. A product
    that can't be had is passed over; the others count."""
    jvm, paths = spark.sparkContext._jvm, {}
    for sensor, url in urls.items():
        try:
            data = (get or download)(url)
        except OSError as e:
            log.warning("hot-spot product %s passed over: %s", sensor, e)
            continue
        paths[sensor] = f"{folder.rstrip('/')}/{sensor}.csv"
        p = jvm.org.apache.hadoop.fs.Path(paths[sensor])
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
    return hotspots(spark, paths, box)


def download(url: str, timeout: int = 90) -> bytes:
    with urlopen(Request(url, headers={"User-Agent": "terralens"}), timeout=timeout) as r:  # noqa: S310
        return r.read()


def scenes(spark: SparkSession, url: str, collection: str, box: tuple, first: str, last: str, max_cloud: float, post=None) -> DataFrame:
    """(item, date, cloud, lon_min, lat_min, lon_max, lat_max, assets) of a scene search
    by box, dates and clouds, for ``least_cloudy``. Pages are followed to the end."""
    body = {"collections": [collection], "bbox": list(box), "datetime": f"{first}/{last}", "query": {"eo:cloud_cover": {"lt": max_cloud}}, "limit": 100}
    rows = []
    while body:
        got = (post or post_json)(url, body, "", 60)
        for f in got.get("features", []):
            at = f["properties"]
            assets = {k: v.get("href") for k, v in f.get("assets", {}).items()}
            rows.append((f["id"], at["datetime"][:10], float(at.get("eo:cloud_cover", 0)), *map(float, f["bbox"]), assets))
        following = [x for x in got.get("links", []) if x.get("rel") == "next" and x.get("body")]
        body = {**body, **following[0]["body"]} if following else None
    return spark.createDataFrame(rows, "item string, date string, cloud double, lon_min double, lat_min double, lon_max double, lat_max double, assets map<string,string>")


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, row, cells) of the workbooks at a path: every sheet's rows from 1, cells
    as text. Workbooks are read whole, one a task."""
    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for sheet, rows in workbook.read(content):
                    yield pd.DataFrame({"path": name.rsplit("/", 1)[-1], "sheet": sheet, "row": range(1, len(rows) + 1), "cells": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def xlsx_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet as a table of text, its first row the names."""
    rows = xlsx(spark, path).filter(F.col("sheet") == sheet)
    head = rows.filter("row = 1").first()
    if head is None:
        raise ValueError(f"no sheet {sheet} in {path}")
    return rows.filter("row > 1").select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(head["cells"])])


def vector_archive(spark: SparkSession, path: str, name: str = "vectors") -> DataFrame:
    """(path, row, vector) of a matrix in .npz archives, one a task."""
    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(content))[name].astype("float32")
                yield pd.DataFrame({"path": file.rsplit("/", 1)[-1], "row": range(len(m)), "vector": list(m)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row int, vector array<float>")


def aligned(vectors: DataFrame, meta: DataFrame, row: str = "row") -> DataFrame:
    """Vectors beside the metadata of the same row number."""
    return meta.join(vectors.select(row, "vector"), row)


def raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, band, row, col, value) pixels of TIFF files; ``window`` is (first row,
    first column, rows, columns) and only its strips or tiles are unpacked."""
    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                image = tiff.Image(content)
                top, left, height, width = window or (0, 0, image.height, image.width)
                for r0 in range(top, min(top + height, image.height), 256):  # in runs of rows, so that memory stays bounded
                    part = image.read(r0, left, min(256, top + height - r0), width)
                    b, r, c = np.indices(part.shape)
                    yield pd.DataFrame({"path": file.rsplit("/", 1)[-1], "band": b.reshape(-1), "row": r.reshape(-1) + r0, "col": c.reshape(-1) + left, "value": part.reshape(-1).astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, band int, row int, col int, value double")


#: (id, dimension, portal, status, columns that must be there, what it holds, limit)
CATALOGUE = (
    ("territory", "spine", "open data portal", "verified", ("cod_mpio", "nom_mpio", "dpto", "latitud", "longitud"), "territories with their centroids", "decimal commas in coordinates"),
    ("mining_registry", "mining", "open data portal", "verified", ("codigo_dane", "mineral"), "mining titles", "formal activity only"),
    ("mining_volume", "mining", "open data portal", "verified", ("codigo_dane", "volumenes_de_explotacion", "regalias_pagadas"), "produced volume and royalties", "formal activity only"),
    ("pdet", "sensitivity", "open data portal", "verified", ("cod_muni",), "peace-programme territories", "a list without dates"),
    ("forest_loss", "forest", "open data portal", "needs vetting", ("MPIO_CNMBR", "Defores"), "yearly forest loss", "joined by name, since it has no code"),
    ("water_quality", "water", "feature service", "geospatial", ("lat", "lon", "ica5"), "water quality samples", "few territories have a station"),
    ("protected_areas", "sensitivity", "feature service", "geospatial", ("centroid_x", "centroid_y", "hectareas_"), "protected areas", "assigned by centroid"),
    ("hotspots", "fire", "satellite service", "verified", ("latitude", "longitude", "acq_date", "frp"), "thermal hot spots of the last days", "three products of unlike resolution"),
)
CATALOGUE_DDL = "source string, dimension string, portal string, status string, expected array<string>, description string, limitation string"


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r[:4], list(r[4]), *r[5:]) for r in CATALOGUE], CATALOGUE_DDL)


def catalogue_status(spark: SparkSession, found: dict[str, DataFrame]) -> DataFrame:
    """The catalogue with what was found: rows, and the expected columns that a table lacks."""
    rows = []
    for source, *_, expected, _, _ in CATALOGUE:
        t = found.get(source)
        rows.append((source, t is not None, t.count() if t is not None else None, missing_columns(t, expected) if t is not None else list(expected)))
    return catalogue(spark).join(spark.createDataFrame(rows, "source string, present boolean, n long, lacking array<string>"), "source")
