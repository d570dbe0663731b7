"""Every source and sink over files that are written from the driver's tables: what is
read back has to be the table again."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.functions import conform as C
from terralens.operators import boosting, raster, retrieval, spatial
from terralens.plans import frames as T
from terralens.session import scratch_path
from terralens.sources import readers, rest, sinks


def paged_file(url: str):
    """Stands in for a service: answers a page's URL from a file of all its rows."""
    from pyarrow import fs

    where, query = url.split("?", 1)
    q = {k: v[0] for k, v in parse_qs(query).items()}
    is_features = where.endswith("/query")
    where = where.removesuffix("/query")
    if urlsplit(where).scheme in ("", "file"):
        fsys, path = fs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/")
    else:
        fsys, path = fs.FileSystem.from_uri(where)
    with fsys.open_input_file(path) as f:
        rows = json.loads(f.read())
    if not is_features:
        at = int(q["$offset"])
        return rows[at : at + int(q["$limit"])]
    at = int(q["resultOffset"])
    part = rows[at : at + min(7, int(q["resultRecordCount"]))]  # a service with a lower limit of its own
    return {"features": [{"attributes": r} for r in part], "exceededTransferLimit": at + len(part) < len(rows)}


class FilePages(rest.OffsetPages):
    fetch = staticmethod(paged_file)


class FileFeatures(rest.FeaturePages):
    fetch = staticmethod(paged_file)


def nations(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "nation").select(C.code("n_nationkey").alias("cod"), F.col("n_name").alias("mpio"), F.col("n_regionkey").cast("string").alias("dpto"))


def csv_text(s, d):
    """CSV with a header, every cell a string: codes keep their zeros, quotes and commas
    stay, and a column that the file lacks is null."""
    path = scratch_path(s, "csv")
    x = T.table(s, d, "customer").select(C.code("c_custkey").alias("cod"), F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"')).alias("name"))
    sinks.csv(x, path, ["name", "cod"])
    return readers.text_csv(s, path, "cod string, name string, other string")


def csv_typed(s, d):
    path = scratch_path(s, "csv")
    sinks.csv(T.table(s, d, "supplier").select("s_suppkey", "s_acctbal"), path)
    return readers.typed_csv(s, path, "s_suppkey long, s_acctbal double")


def csv_optional(s, d):
    """A left join with a source whose file is missing: its signal is zero."""
    none = readers.optional_csv(s, scratch_path(s, "missing"), "cod string, focos string")
    return nations(s, d).join(none, "cod", "left").select("cod", C.number("focos", 0).alias("focos"))


def _as_json(s, df, name):
    path = scratch_path(s, name) + ".json"
    rows = [r.asDict() for r in df.orderBy(*df.columns).collect()]  # a nation a row
    sinks.put(s, path, json.dumps(rows).encode())
    return path


def paged_rows(s, d):
    s.dataSource.register(FilePages)
    path = _as_json(s, nations(s, d), "rows")
    return s.read.format("offset_pages").schema("cod string, mpio string, dpto string").option("url", path).option("page", 4).option("pause", 0).load()


def paged_features(s, d):
    s.dataSource.register(FileFeatures)
    path = _as_json(s, nations(s, d), "features")
    return s.read.format("feature_pages").schema("cod string, mpio string, dpto string").option("url", path).option("page", 10).option("total", 25).option("pause", 0).load()


def hotspot_products(s, d):
    """Three products of which one can't be had; the others are read and cut to a box."""
    e = T.hotspots(s, d)
    urls = {}
    for sensor in ("click", "view"):
        urls[sensor] = scratch_path(s, sensor)
        rows = e.filter(F.col("sensor") == sensor).select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "acq_date", "frp", F.lit("n").alias("confidence"), F.lit("D").alias("daynight"))
        sinks.csv(rows.coalesce(1), urls[sensor])
    urls["purchase"] = scratch_path(s, "purchase")

    def get(url):
        if not readers.exists(s, url):
            raise FileNotFoundError(url)
        return b"".join(bytes(r["content"]) for r in s.read.format("binaryFile").load(url).select("content").collect())  # one file

    found = readers.fetched_hotspots(s, urls, scratch_path(s, "products"), (-78.0, -3.0, -68.0, 12.0), get)
    return found.groupBy("sensor", "acq_date").agg(F.count(F.lit(1)).alias("focos"), C.decimal_sum("frp").alias("frp_total"))


def geojson_polygons(s, d):
    """A FeatureCollection written from polygons and read back, met with points."""
    p = T.polygons(s, d).join(T.table(s, d, "nation").select(F.col("n_nationkey").alias("cod"), "n_name"), "cod")
    features = [
        {"type": "Feature", "properties": {"cod": r["cod"], "mpio": r["n_name"], "dpto": ""}, "geometry": {"type": "Polygon", "coordinates": [[[v["lon"], v["lat"]] for v in r["ring"]]]}}
        for r in p.orderBy("cod").collect()  # a nation a row
    ]
    path = scratch_path(s, "shapes") + ".geojson"
    sinks.put(s, path, json.dumps({"type": "FeatureCollection", "features": features}).encode())
    shapes = readers.geojson_polygons(s, path)
    at = spatial.assign_polygons(T.hotspots(s, d), shapes, "event_id", outer=False)
    return at.join(shapes.select("cod", "mpio"), "cod").groupBy("cod", "mpio").agg(F.count(F.lit(1)).alias("focos"))


def scene_search(s, d):
    """The least cloudy scene of each region, from a search that answers in two pages."""
    k = F.col("cod")
    x = T.centroids(s, d).join(T.table(s, d, "nation").select(F.col("n_nationkey").alias("cod"), "n_regionkey"), "cod")
    rows = x.select(k, "n_regionkey", "lat", "lon", (k * 7 % 40).alias("cloud"), F.date_add(F.lit("2024-01-01").cast("date"), (k * 11 % 60).cast("int")).cast("string").alias("day")).orderBy("cod").collect()
    features = [
        {"id": f"scene-{r['cod']:02d}-{r['n_regionkey']}", "bbox": [r["lon"] - 0.5, r["lat"] - 0.5, r["lon"] + 0.5, r["lat"] + 0.5], "properties": {"datetime": r["day"] + "T00:00:00Z", "eo:cloud_cover": r["cloud"]}, "assets": {"red": {"href": f"red-{r['cod']}"}}}
        for r in rows
    ]

    def post(url, body, token, timeout):
        at = body.get("page", 0)
        return {"features": features[at : at + 15], "links": [{"rel": "next", "body": {"page": at + 15}}] if at + 15 < len(features) else []}

    found = readers.scenes(s, "stand-in", "scenes", (-79.0, -4.0, -67.0, 13.0), "2024-01-01", "2024-02-15", 30, post)
    found = found.withColumn("region", F.substring("item", 10, 1))
    return readers.least_cloudy(found, (-78.0, -3.0, -68.0, 12.0), "2024-01-01", "2024-02-15", 30, "region")


def raster_window(s, d):
    """A window of an image that is written in tiles and read back with its place."""
    pixels = T.table(s, d, "lineitem").select((F.col("l_orderkey") % 90).alias("row"), (F.col("l_partkey") % 70).alias("col"), (F.col("l_suppkey") % 200).alias("v"))
    pixels = pixels.groupBy("row", "col").agg(F.max("v").alias("value"))
    path = scratch_path(s, "image")
    sinks.image(s, pixels, path, 90, 70, transform=(10.0, 0.0, 500.0, 0.0, -10.0, 900.0), tile=100)
    return readers.raster(s, path, (20, 30, 40, 25)).select("row", "col", F.col("value").cast("long").alias("value"))


def json_table(s, d):
    path = scratch_path(s, "json")
    sinks.json_lines(nations(s, d), path)
    return s.read.schema("cod string, mpio string, dpto string").json(path)


def json_summary(s, d):
    """A one-row summary as a document, read back."""
    path = scratch_path(s, "summary")
    sinks.summary(T.table(s, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most")), path)
    return readers.json_table(s, path, "n long, most double")


def text_documents(s, d):
    """Headed documents written as files, read whole and split at the headings."""
    folder = scratch_path(s, "texts")
    for r in T.table(s, d, "region").orderBy("r_regionkey").collect():  # five
        sinks.put(s, f"{folder}/doc{r['r_regionkey']}.md", f"# {r['r_name']}\n\nintro {r['r_regionkey']}\n## First\n\none\n\n## Second\ntwo".encode())
    docs = readers.documents(s, folder).withColumn("stem", F.regexp_replace("path", r"\.md$", ""))
    return retrieval.chunk(docs, "stem", "text")


def vector_index(s, d):
    """Vectors as an archive beside their metadata, put together by row."""
    e = T.table(s, d, "embeddings")
    path = scratch_path(s, "vectors") + ".npz"
    sinks.vector_archive(s, e, "embedding", "vec_id", path)
    # the archive's order is that of the ids, which are whole numbers from the least on
    least = e.agg(F.min("vec_id")).scalar()
    meta = e.select("vec_id", "label", (F.col("vec_id") - least).cast("int").alias("row"))
    both = readers.aligned(readers.vector_archive(s, path), meta)
    return both.select("vec_id", "label", C.half_up(retrieval.norm(F.col("vector")), 4).alias("length"))


def workbook(s, d):
    """A workbook of two sheets, one of which is read back."""
    path = scratch_path(s, "book") + ".xlsx"
    sinks.xlsx(s, {"regions": T.table(s, d, "region"), "nations & codes": nations(s, d).orderBy("cod")}, path)
    return readers.xlsx_sheet(s, path, "nations & codes")


def saved_model(s, d):
    """A model written and read again says what it said."""
    x = T.table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") > 25).cast("int").alias("y"))
    m = boosting.train(x, "p_partkey", ("p_size", "p_retailprice"), classes=2, rounds=10, columns=1.0)
    path = scratch_path(s, "model")
    sinks.model(s, m, path)
    again = boosting.predict(sinks.load_model(s, path), x, ("small", "large"))
    return again.select("p_partkey", F.col("riesgo_pred").alias("said"))


def console_report(s, d):
    text = sinks.console(T.table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions")
    return s.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


def html_report(s, d):
    """A report of text and a table, as the file's lines."""
    path = scratch_path(s, "report") + ".html"
    sinks.report(s, "Regions", [("Note", "a < b & c"), ("Table", T.table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))], path)
    lines = sinks.get(s, path).decode().split("\n")
    return s.createDataFrame(list(enumerate(lines)), "line int, text string")


def missing_outputs(s, d):
    """Of outputs that should be there, those that are not."""
    there = scratch_path(s, "there")
    sinks.parquet(T.table(s, d, "region"), there)
    gone = sinks.absent(s, [there, scratch_path(s, "gone")])
    return s.createDataFrame([(p.rsplit("/", 1)[-1].split("-")[0],) for p in gone], "name string")


def missing_columns(s, d):
    lacking = C.missing_columns(T.table(s, d, "nation"), ["n_nationkey", "n_code", "n_name", "n_area"])
    return s.createDataFrame([(c,) for c in lacking], "name string")


def source_status(s, d):
    """The catalogue beside what was found of it."""
    k = nations(s, d)
    found = {"territory": k.select(F.col("cod").alias("cod_mpio"), F.col("mpio").alias("nom_mpio"), F.col("dpto")), "pdet": k.select(F.col("cod").alias("cod_muni"))}
    x = readers.catalogue_status(s, found)
    return x.select("source", "status", "present", "n", F.array_join("lacking", ",").alias("lacking"))


def segmented_tiles(s, d):
    """Masks of tiles by a stand-in for a network: the share of the brightest."""
    x = T.table(s, d, "lineitem").select((F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"), (F.col("l_suppkey") % 97).alias("v"))
    x = x.groupBy("row", "col").agg(F.max("v").cast("float").alias("v"))
    band = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "v"))), lambda p: p["v"])
    tiles = x.groupBy(F.floor(F.col("row") / 16).cast("int").alias("i"), F.floor(F.col("col") / 16).cast("int").alias("j")).agg(band.alias("bands"))
    got = raster.segmented(tiles, lambda a: a / 97.0)
    return got.select("i", "j", F.size("bands").alias("pixels"), F.aggregate("mask", F.lit(0), lambda a, v: a + v).alias("lit"))


QUERIES = {
    "csv_text": csv_text,
    "csv_typed": csv_typed,
    "csv_optional": csv_optional,
    "paged_rows": paged_rows,
    "paged_features": paged_features,
    "hotspot_products": hotspot_products,
    "geojson_polygons": geojson_polygons,
    "scene_search": scene_search,
    "raster_window": raster_window,
    "json_table": json_table,
    "json_summary": json_summary,
    "text_documents": text_documents,
    "vector_index": vector_index,
    "workbook": workbook,
    "saved_model": saved_model,
    "console_report": console_report,
    "html_report": html_report,
    "missing_outputs": missing_outputs,
    "missing_columns": missing_columns,
    "source_status": source_status,
    "segmented_tiles": segmented_tiles,
}
