import datetime
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terralens.operators import anomaly, raster, retrieval
from terralens import session
from terralens.schema import HOTSPOT, PDET
from terralens.sources import readers, rest, sinks, tiff, workbook
from terralens.streaming import hotspots


def test_csv_keeps_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('cod_muni,nom_muni,extra\n05001,"A, B",1\n,,\n', encoding="utf-8")
    rows = readers.text_csv(spark, str(p), PDET).collect()
    assert rows[0].cod_muni == "05001" and rows[0].nom_muni == "A, B" and rows[0].nom_subreg is None and rows[1].cod_muni is None
    assert readers.optional_csv(spark, str(tmp_path / "no.csv"), PDET).count() == 0


def test_hotspot_products(spark, tmp_path):
    (tmp_path / "m.csv").write_text("latitude,longitude,acq_date,frp,confidence,daynight\n4.5,-74.0,2026-07-15,12.5,n,D\nx,-74,2026-07-15,1,n,D\n40,-74,2026-07-15,1,n,D\n5,-73,2026-07-16,nan,n,D\n")
    got = readers.hotspots(spark, {"modis": str(tmp_path / "m.csv"), "viirs": str(tmp_path / "absent.csv")}).orderBy("acq_date").collect()
    assert [(r.sensor, r.lat, r.frp) for r in got] == [("modis", 4.5, 12.5), ("modis", 5.0, 0.0)]
    assert readers.hotspots(spark, {}).count() == 0 and "latitude" in HOTSPOT


def test_geojson_and_text(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"cod": 5001, "mpio": "M", "dpto": "D"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"cod": 2, "mpio": "N", "dpto": "D"}, "geometry": {"type": "Polygon", "coordinates": square}},
    ]}
    (tmp_path / "g.geojson").write_text(json.dumps(doc))
    got = readers.geojson_polygons(spark, str(tmp_path / "g.geojson")).orderBy("ord").collect()
    assert [r.cod for r in got] == [5001, 2] and len(got[0].ring) == 5 and got[0].ring[1].lon == 2.0
    (tmp_path / "d.md").write_text("# T\nintro\n## One\nx\n## \n## Two\n" + "y" * 2000)
    docs = readers.documents(spark, str(tmp_path / "d.md"))
    parts = retrieval.chunk(docs, "path", "text").orderBy("id").collect()
    assert [r.id for r in parts] == ["d.md-0", "d.md-1", "d.md-3", "d.md-3.1"] and max(len(r.texto) for r in parts) == 1200
    assert parts[2].texto + parts[3].texto == "Two\n" + "y" * 2000


def test_scene_choice(spark):
    rows = [("a", "2023-01-05", 20.0, 0.0, 0.0, 1.0, 1.0), ("b", "2023-01-09", 5.0, 0.0, 0.0, 1.0, 1.0), ("c", "2023-01-10", 1.0, 50.0, 50.0, 51.0, 51.0), ("d", "2024-01-10", 1.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "item string, date string, cloud double, lon_min double, lat_min double, lon_max double, lat_max double").withColumn("year", F.substring("date", 1, 4))
    assert [r.item for r in readers.least_cloudy(df, (0.2, 0.2, 0.8, 0.8), "2023-01-01", "2023-12-31", 30, "year").collect()] == ["b"]
    assert readers.catalogue(spark).count() == len(readers.CATALOGUE)


def test_paging():
    asked = []

    def get(url):
        asked.append(url)
        page = len(asked)
        return [{"a": i} for i in range(3)] if page == 1 else [{"a": 9}, {}]

    assert [r["a"] for r in rest.offset_pages(get, "http://x", 3, 0)] == [0, 1, 2, 9] and len(asked) == 2
    pages = [{"features": [{"attributes": {"n": 1}}], "exceededTransferLimit": True}, {"features": [{"attributes": {"n": 2}}]}]
    assert [r["n"] for r in rest.feature_pages(lambda u: pages.pop(0), "http://x", pause=0)] == [1, 2]


def test_feature_pages_above_the_limit_of_the_service(spark):
    class Limited(rest.FeaturePages):
        @staticmethod
        def fetch(url):  # 10 rows, 2 at most in an answer
            q = dict(x.split("=") for x in url.split("?")[1].split("&"))
            at, n = int(q["resultOffset"]), min(2, int(q["resultRecordCount"]))
            return {"features": [{"attributes": {"n": i}} for i in range(at, min(10, at + n))], "exceededTransferLimit": at + n < 10}

        @classmethod
        def name(cls):
            return "limited_pages"

    spark.dataSource.register(Limited)
    read = spark.read.format("limited_pages").schema("n string").option("url", "http://x").option("pause", "0").option("page", "5")
    for df in (read.load(), read.option("total", "10").load()):
        assert sorted(int(r.n) for r in df.collect()) == list(range(10))


def test_data_source_rows(spark):
    class Local(rest.OffsetPages):
        fetch = staticmethod(lambda url: [{"a": "x", "n": 5}, {}])

        @classmethod
        def name(cls):
            return "local_pages"

    spark.dataSource.register(Local)
    df = spark.read.format("local_pages").schema("a string, n string, z string").option("url", "http://x").option("pause", "0").load()
    assert [tuple(r) for r in df.collect()] == [("x", "5", None)]
    paged = spark.read.format("local_pages").schema("a string").option("url", "http://x").option("page", "2").option("total", "5").load()
    assert paged.count() == 3 and paged.rdd.getNumPartitions() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "á"), (2, None)], "n int, t string")
    sinks.csv(df, str(tmp_path / "c"), ["t", "n"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["t", "n"]
    sinks.parquet(df, str(tmp_path / "p"), "n")
    sinks.summary(df.agg(F.sum("n").alias("s")), str(tmp_path / "j"))
    assert readers.json_table(spark, str(tmp_path / "j")).first().s == 3
    assert sinks.absent(spark, [str(tmp_path / "p"), str(tmp_path / "q")]) == [str(tmp_path / "q")]


def test_isolation_forest_finds_the_odd_one(spark):
    df = spark.range(400).select("id", F.when(F.col("id") == 7, 50.0).otherwise(F.randn(3)).alias("a"), F.when(F.col("id") == 7, -50.0).otherwise(F.randn(4)).alias("b"))
    rows = anomaly.isolation_forest(df, ("a", "b"), "id", trees=30).collect()
    assert max(rows, key=lambda r: r.score_anomalia).id == 7 and next(r for r in rows if r.id == 7).es_anomalia == 1


def test_isolation_forest_on_a_large_table_draws_from_a_pool(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "POOL", 5000)
    df = spark.range(40_000).select("id", F.when(F.col("id") == 7, 50.0).otherwise(F.randn(3)).alias("a"), F.when(F.col("id") == 7, -50.0).otherwise(F.randn(4)).alias("b"))
    rows = anomaly.isolation_forest(df, ("a", "b"), "id", trees=20, contamination=0.01)
    assert rows.filter("id = 7").first().es_anomalia == 1 and 0 < rows.agg(F.sum("es_anomalia")).first()[0] <= 400


def test_raster(spark):
    px = [(0, 0, 8000.0, 1000.0, 2000.0, 1900.0, 1), (0, 1, 8000.0, 1000.0, 8000.0, 1000.0, 1), (1, 0, 1000.0, 1000.0, 0.0, 0.0, 2)]
    df = spark.createDataFrame(px, "row int, col int, n0 double, r0 double, n1 double, r1 double, zone int")
    df = df.withColumns({"v0": raster.ndvi(F.col("n0"), F.col("r0")), "v1": raster.ndvi(F.col("n1"), F.col("r1"))})
    lost = df.withColumn("lost", raster.loss(F.col("v0"), F.col("v1")))
    assert [tuple(r) for r in raster.zonal(lost, "zone", "lost").collect()] == [(1, 0.01)]
    assert raster.tiles(df.withColumn("ok", F.col("row") == 0), 2, "ok").first().valid_share == 2 / 3
    i = raster.iou(df, F.col("v0"), F.col("v1")).first()
    assert (i.intersection, i.union_) == (1, 2) and df.select(raster.scaled(F.lit(12000.0))).first()[0] == 1.0
    assert df.select(raster.is_forest(F.lit(10))).first()[0] == 1


def test_retrieval(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 3.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in retrieval.retrieve(df, [1.0, 0.0], 9).collect()] == [1, 2, 3, 4]
    assert df.select(retrieval.l2_normalised(F.col("embedding")).alias("v")).collect()[2].v == [0.0, 0.0]
    out = retrieval.embedded(df.withColumn("t", F.lit("ab")), "t", lambda xs: [[float(len(x))] for x in xs]).collect()
    assert {r.vector[0] for r in out} == {2.0}


def test_streaming_windows(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 05:00", "2024-01-02 06:00", "2024-02-01 00:00"]), "k": ["a", "a", "a"], "v": [1.0, 2.0, 9.0]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    live = hotspots.stream(spark, str(tmp_path / "in"), "ts timestamp, k string, v double")
    seen = []
    q = hotspots.refresh(hotspots.windowed(live, "ts", "k", "v"), lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    done = {str(r.start): (r.focos, r.frp_total) for r in seen if r.start.month < 2 or r.focos == 2}
    assert done["2024-01-01 00:00:00"] == (2, 3.0)


def test_updates_replace_rows_of_earlier_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double").coalesce(1).write.mode("append").parquet(folder)

    def table():
        e = hotspots.stream(spark, folder, "ts timestamp_ntz, k string, v double").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
        t = e.groupBy("k", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
        return {(r.k, r.day.isoformat()): (r.n, r.v) for r in hotspots.refreshed_table(spark, t.select("k", F.to_date("w.start").alias("day"), "n", "v"), ["k", "day"], out).collect()}

    day = datetime.datetime(2024, 3, 1)
    arrive([(day, "a", 1.0), (day, "b", 2.0)])
    assert table() == {("a", "2024-03-01"): (1, 1.0), ("b", "2024-03-01"): (1, 2.0)}
    arrive([(day, "a", 5.0), (day + datetime.timedelta(days=9), "a", 3.0)])
    assert table() == {("a", "2024-03-01"): (2, 6.0), ("b", "2024-03-01"): (1, 2.0), ("a", "2024-03-10"): (1, 3.0)}
    arrive([(day, "b", 7.0)])  # behind the watermark by now
    assert table()[("b", "2024-03-01")] == (1, 2.0)


def test_products_that_cannot_be_had_are_passed_over(spark, tmp_path):
    def get(url):
        if url == "down":
            raise OSError("no route")
        return b"latitude,longitude,acq_date,frp,confidence,daynight\n4.5,-74.0,2026-07-15,12.5,n,D\n"

    got = readers.fetched_hotspots(spark, {"a": "up", "b": "down"}, str(tmp_path / "f"), get=get).collect()
    assert [(r.sensor, r.frp) for r in got] == [("a", 12.5)]


def test_workbooks(spark, tmp_path):
    rows = [["a", "b & <c>", None], [1, 2.5, "  x\ny "], [None, True, "é\x07"], []]
    data = workbook.write({"S & 1": rows, "empty": []})
    got = dict(workbook.read(data))
    assert got == {"S & 1": [["a", "b & <c>", None], ["1", "2.5", "  x\ny "], [None, "1", "é"], [None, None, None]], "empty": []}
    assert [workbook.column_number(workbook.column_name(i)) for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702] and workbook.column_name(702) == "AAA"
    df = spark.createDataFrame([(1, "á", None), (2, None, 0.5)], "n int, t string, v double")
    sinks.xlsx(spark, {"one": df, "two": df.select("n")}, str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in readers.xlsx_sheet(spark, str(tmp_path / "b.xlsx"), "one").collect()] == [("1", "á", None), ("2", None, "0.5")]
    try:
        sinks._bounded(spark.range(12), 10)
        raise AssertionError
    except ValueError as e:
        assert "more than 10 rows" in str(e)


def test_images(spark, tmp_path):
    r = np.random.default_rng(1)
    for kind in ("uint8", "int16", "uint16", "float32", "float64"):
        bands = (r.random((3, 150, 41)) * 200).astype(kind)
        at = (10.0, 0.0, 300.0, 0.0, -10.0, 900.0)
        image = tiff.Image(tiff.write(bands, at))
        assert (image.bands, image.height, image.width, image.transform) == (3, 150, 41, at)
        assert (image.read(0, 0, 150, 41) == bands).all() and (image.read(60, 7, 30, 20) == bands[:, 60:90, 7:27]).all()
        assert image.read(140, 30, 50, 50).shape == (3, 10, 11) and image.read(200, 0, 5, 5).size == 0
    one = tiff.Image(tiff.write(bands[0]))
    assert one.transform is None and (one.read(0, 0, 150, 41)[0] == bands[0]).all()
    px = spark.createDataFrame([(i, j, i * 7 + j) for i in range(30) for j in range(25)], "row int, col int, value int")
    sinks.image(spark, px, f"file://{tmp_path}/m", 28, 25, kind="int32", transform=(2.0, 0.0, 0.0, 0.0, -2.0, 0.0), tile=16)
    got = {}
    for f in (tmp_path / "m").iterdir():
        top, left = map(int, f.stem.split("-"))
        part = tiff.Image(f.read_bytes())
        assert part.transform == (2.0, 0.0, 2.0 * left, 0.0, -2.0, -2.0 * top)
        got |= {(top + i, left + j): int(v) for (i, j), v in np.ndenumerate(part.read(0, 0, 99, 99)[0])}
    assert got == {(i, j): i * 7 + j for i in range(28) for j in range(25)}


def tiled(m, tile, predictor):
    """A tiled image, plane by plane, put together by hand."""
    bands, height, width = m.shape
    across, down = -(-width // tile), -(-height // tile)
    tiles = []
    for b in range(bands):
        for i in range(down):
            for j in range(across):
                t = np.zeros((tile, tile), "<u2")
                part = m[b, i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
                t[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    t[:, 1:] = np.diff(t, axis=1)
                tiles.append(zlib.compress(t.tobytes()))
    head, at, offsets = 8, 8, []
    for t in tiles:
        offsets.append(at)
        at += len(t)
    at += at % 2
    tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [16] * bands), 259: (3, [8]), 277: (3, [bands]), 284: (3, [2]), 317: (3, [predictor]), 322: (3, [tile]), 323: (3, [tile]), 324: (4, offsets), 325: (4, [len(t) for t in tiles]), 33550: (12, [10.0, 10.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 500.0, 800.0, 0.0])}
    after, body, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
        body += struct.pack("<HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(extra)))
        extra += raw if len(raw) > 4 else b""
    data = b"".join(tiles)
    return (struct.pack("<2sHI", b"II", 42, at) + data).ljust(at, b"\0") + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + extra


def test_windows_of_tiled_images(spark, tmp_path):
    m = np.random.default_rng(2).integers(0, 60_000, (2, 70, 50)).astype(np.uint16)
    for predictor in (1, 2):
        data = tiled(m, 16, predictor)
        image = tiff.Image(data)
        assert image.transform == (10.0, 0.0, 500.0, 0.0, -10.0, 800.0)
        assert (image.read(0, 0, 70, 50) == m).all() and (image.read(20, 10, 33, 37) == m[:, 20:53, 10:47]).all()
    (tmp_path / "t.tif").write_bytes(data)
    got = {(x.band, x.row, x.col): int(x.value) for x in readers.raster(spark, str(tmp_path / "t.tif"), (60, 40, 30, 30)).collect()}
    assert got == {(b, i, j): int(m[b, i, j]) for b in range(2) for i in range(60, 70) for j in range(40, 50)}


def test_scene_pages():
    from pyspark.sql import SparkSession

    spark, asked = SparkSession.getActiveSession(), []
    feature = lambda i: {"id": f"s{i}", "bbox": [0, 0, 1, 1], "properties": {"datetime": "2024-01-02T03:04:05Z", "eo:cloud_cover": i}, "assets": {"red": {"href": "r"}}}

    def post(url, body, token, timeout):
        asked.append(body)
        at = body.get("next", 0)
        return {"features": [feature(at)], "links": [{"rel": "next", "body": {"next": at + 1}}] if at < 2 else [{"rel": "self"}]}

    got = readers.scenes(spark, "u", "c", (0, 0, 1, 1), "2024-01-01", "2024-02-01", 20, post).collect()
    assert [(r.item, r.cloud, r.date, r.assets["red"]) for r in got] == [("s0", 0.0, "2024-01-02", "r"), ("s1", 1.0, "2024-01-02", "r"), ("s2", 2.0, "2024-01-02", "r")]
    assert all(b["query"] == {"eo:cloud_cover": {"lt": 20}} for b in asked)


def test_assistant(spark):
    corpus = spark.createDataFrame([("a", "alpha", [1.0, 0.0]), ("b", "beta", [0.0, 1.0]), ("c", "gamma", [0.9, 0.1])], "id string, texto string, vector array<float>")
    asked = []

    def post(url, body, token, timeout):
        asked.append((url, body))
        return {"data": [{"embedding": [1.0, 0.0]} for _ in body["input"]]} if "input" in body else {"choices": [{"message": {"content": "see [a]"}}]}

    got = retrieval.ask("which?", corpus, retrieval.embedding_service("e", "m", post=post), retrieval.chat_service("c", "m", post=post), 2)
    assert got["answer"] == "see [a]" and [i for i, _ in got["sources"]] == ["a", "c"]
    assert "[a] alpha\n[c] gamma" in asked[1][1]["messages"][1]["content"] and "which?" in asked[1][1]["messages"][1]["content"]
    assert len(retrieval.KNOWLEDGE) == 22


def test_raster_grids(spark):
    px = spark.createDataFrame([(i, j, (i * 5 + j) % 3) for i in range(6) for j in range(5)], "row int, col int, v int")
    fine = spark.createDataFrame([(i, j) for i in range(14) for j in range(11)], "row int, col int")
    to, of = (10.0, 0.0, 100.0, 0.0, -10.0, 200.0), (20.0, 0.0, 100.0, 0.0, -20.0, 200.0)
    got = {(r.row, r.col): r.v for r in raster.resampled(fine, px, to, of, "v").collect()}
    assert got == {(i, j): (i // 2 * 5 + j // 2) % 3 if i < 12 and j < 10 else None for i in range(14) for j in range(11)}
    assert raster.pixel_hectares(to) == 0.01
    ok = px.withColumn("ok", F.col("v") > 0)
    for size, stride in ((2, 2), (3, 1), (2, 3), (5, 2), (7, 1)):
        want = {}
        for i in range(0, 6 - size + 1, stride):
            for j in range(0, 5 - size + 1, stride):
                share = sum((a * 5 + b) % 3 > 0 for a in range(i, i + size) for b in range(j, j + size)) / size**2
                if share >= 0.6:
                    want[(i, j)] = share
        rows = raster.patches(ok, size, stride, 6, 5, "ok").collect()
        assert {(r.top, r.left): r.valid_share for r in rows} == want
    square = [(7, 0, [{"lon": x, "lat": y} for x, y in ((100.0, 200.0), (130.0, 200.0), (130.0, 170.0), (100.0, 170.0))])]
    polys = spark.createDataFrame(square, "cod int, ord int, ring array<struct<lon:double,lat:double>>")
    all_on = fine.withColumn("lost", F.lit(1))
    assert [tuple(r) for r in raster.zonal_polygons(all_on, polys, to, "lost", raster.pixel_hectares(to)).collect()] == [(7, 0.09)]


def test_a_written_table_follows_its_sources(spark, tmp_path):
    src, built = str(tmp_path / "s"), []

    def build():
        built.append(1)
        return spark.read.parquet(src)

    spark.range(3).write.parquet(src)
    for _ in range(2):
        assert session.materialised(spark, "t", [src], build).count() == 3
    spark.range(2).write.mode("append").parquet(src)
    assert session.materialised(spark, "t", [src], build).count() == 5 and len(built) == 2
