"""Every operator over the driver's tables; keys as in ``oracles.SQL``."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.functions import conform as C
from terralens.operators import anomaly, boosting, conformal, index, metrics, model, raster, report, retrieval, spatial, territory
from terralens.plans import frames as T
from terralens.plans import roundtrips as R
from terralens.plans.frames import polygons
from terralens.schema import INDICES, LEVELS
from terralens.session import materialised, scratch_path
from terralens.sources import readers
from terralens.streaming import hotspots as live

HIGH = ("Alto", "Crítico")

def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: C.half_up(c, digits) for c in cols})


def code_conformance(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("9"), F.lpad(k.cast("string"), 6, "0"))).when(k % 4 == 2, "").otherwise(k.cast("string"))
    txt = F.when(k % 5 == 0, F.concat((k % 97).cast("string"), F.lit(",5"))).when(k % 5 == 1, "1,234.5").when(k % 5 == 2, "nan").when(k % 5 == 3, "x")
    return T.table(s, d, "customer").select(k, C.code(raw).alias("cod"), C.number(txt).alias("num"), C.number(txt, 0).alias("num0"))


def name_normalise_join(s, d):
    n = T.table(s, d, "nation")
    names = n.select(C.name_key("n_name").alias("k"), F.col("n_nationkey").alias("cod"), F.col("n_nationkey").alias("ord"))
    c = T.table(s, d, "customer").select("c_custkey", "c_nationkey")
    # summed up per customer before names are joined
    o = T.table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.max("v").alias("v")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    messy = rows.select(C.name_key(F.concat(F.lit("  "), F.lower("n_name"), F.lit("  "))).alias("k"), "v")
    return territory.worst(territory.by_name(messy, names, "k"), "cod", "v", "worst")


def points(df, key):
    return df.select(key, T.lat(F.col(key)).alias("lat"), T.lon(F.col(key)).alias("lon"))


def nearest_centroid(s, d):
    return rounded(spatial.nearest(points(T.table(s, d, "supplier"), "s_suppkey"), T.centroids(s, d), 300.0, "s_suppkey"), 4, "km")


def nearest_radius_sum(s, d):
    p = T.table(s, d, "part")
    hit = spatial.nearest(points(p, "p_partkey"), T.centroids(s, d), 60.0, "p_partkey")
    return hit.join(p.select("p_partkey", "p_retailprice"), "p_partkey").groupBy("cod").agg(F.count(F.lit(1)).alias("areas"), C.decimal_sum("p_retailprice").alias("hectareas"))


def hotspot_aggregate(s, d):
    return index.fire_index(T.fire(s, d), "frp_total").select("cod_mpio", "focos_7d", "frp_total", "ultima_fecha", "idx_fuego")


def level_monotonicity(s, d):
    return report.level_ranges(T.labelled(s, d), "riesgo_nivel", "riesgo_score", T.level_ordinal())


def signal_coverage(s, d):
    return report.coverage(T.labelled(s, d), {"mineria_titulos": "mining", "deforestacion_ha": "forest", "agua_estaciones": "water", "runap_areas": "protected", "es_pdet": "pdet"})


def signals_per_territory(s, d):
    n = report.signals_present(["mineria_titulos", "deforestacion_ha", "agua_estaciones", "runap_areas"])
    return T.labelled(s, d).groupBy(n.alias("signals")).agg(F.count(F.lit(1)).alias("n"))


def department_rollup(s, d):
    return report.rollup_groups(T.labelled(s, d), "departamento", F.col("riesgo_nivel").isin(*HIGH), "riesgo_score", "cod_mpio", 6, "focos_7d")


def priority_cross(s, d):
    high, fire = F.col("riesgo_nivel").isin(*HIGH), F.col("focos_7d") > 0
    return T.labelled(s, d).agg(F.sum("focos_7d").alias("focos"), F.count_if(fire).alias("con_fuego"), F.count_if(fire & high).alias("maxima_prioridad"), F.count_if((F.col("frp_total") > 200) & ~high).alias("actividad_nueva"))


def codes(df, condition):
    return df.filter(condition).select("cod_mpio")


def fire_high_intersect(s, d):
    x = T.labelled(s, d)
    return codes(x, F.col("focos_7d") > 0).intersect(codes(x, F.col("riesgo_nivel").isin(*HIGH)))


def fire_high_difference(s, d):
    x = T.labelled(s, d)
    return codes(x, F.col("frp_total") > 200).join(codes(x, F.col("riesgo_nivel").isin(*HIGH)), "cod_mpio", "left_anti").distinct()


def choropleth_values(s, d):
    n = T.table(s, d, "nation").select(F.col("n_nationkey").alias("cod"), F.col("n_name").alias("mpio"))
    c = T.hotspots(s, d).groupBy((F.col("event_id") % 31).cast("int").alias("cod")).agg(F.count(F.lit(1)).alias("focos"))
    return n.join(c, "cod", "left").fillna(0, subset=["focos"])


def dominant_factor(s, d):
    return report.frequency(T.labelled(s, d).withColumn("dominante", C.dominant(INDICES)), "dominante")


def four(c):
    return F.format_string("%.4f", F.col(c))


def territory_card(s, d):
    fields = {"municipio": F.col("municipio"), "nivel": F.col("riesgo_nivel"), "score": four("riesgo_score"), "focos": F.col("focos_7d"), "dominante": C.dominant(INDICES)}
    return report.card(T.labelled(s, d), F.col("cod_mpio") == "00042", fields | {c: four(c) for c in INDICES})


def territory_card_model(s, d):
    """What the model says of one territory: prediction, confidence, certainty and the
    columns that weigh most."""
    one = F.col("cod_mpio") == "00042"
    x = model_sets(s, d).filter(one)
    fields = {c: F.col(c) for c in ("riesgo_pred", "confianza", "conjunto_conformal", "certeza_calibrada")}
    why = boosting.attributions(fitted(s, d), split_table(s, d).filter(one), "cod_mpio")
    why = why.select(F.concat(F.lit("factor_"), "place").alias("field"), F.format_string("%s %.5f", "feature", "phi").alias("value"))
    return report.card(x, one, fields).unionByName(why)


def view_filter(s, d):
    x = T.labelled(s, d).filter(F.col("departamento").isin(1, 2, 3) & F.col("riesgo_nivel").isin("Medio", "Alto"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.max("riesgo_score").alias("top"))


def display_clip(s, d):
    return rounded(report.clipped(T.labelled(s, d), "frp_total", "frp_clip"), 4, "frp_clip").select("cod_mpio", "frp_clip")


def name_override(s, d):
    x = T.table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    m = T.table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("name"))
    return territory.overwrite_names(x, m, "s_suppkey", ("name",)).select("s_suppkey", "name")


def sensor_union(s, d):
    e = T.table(s, d, "events")
    feeds = [e.filter(F.col("event_type") == t).select(F.lit(t).alias("sensor"), "event_id", F.col("value").alias("frp")) for t in ("click", "view", "purchase")]
    return feeds[0].unionByName(feeds[1]).unionByName(feeds[2])


def predictions(s, d):
    x = T.table(s, d, "labels").join(T.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 400).cast("int").alias("yhat"))


def class_metrics(s, d):
    return rounded(metrics.per_class(predictions(s, d), "y", "yhat"), 6, "precision", "recall", "f1")


def coordinates_present(s, d):
    k = F.col("c_custkey")
    place = T.table(s, d, "customer").select(k, F.when(k % 5 != 0, T.lat(k)).alias("lat"), F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(T.lon(k)).alias("lon"))
    return place.filter(C.present("lat", "lon")).select("c_custkey")


def majority_baseline(s, d):
    return rounded(metrics.summary(predictions(s, d), "y", "yhat"), 6, "accuracy", "baseline").select("accuracy", "baseline", "majority", "n")


def probabilities(s, d):
    k = F.col("doc_id")
    parts = [1 + (k * 7) % 11, 1 + (k * 5) % 13, 1 + (k * 3) % 7, 1 + k % 5]
    total = (parts[0] + parts[1] + parts[2] + parts[3]).cast("double")
    return T.table(s, d, "labels").select("doc_id", ((k * 31) % 4).cast("int").alias("y"), F.array(*[p.cast("double") / total for p in parts]).alias("p"))


def conformal_qhat(s, d):
    x = probabilities(s, d).withColumn("s", conformal.nonconformity("p", "y"))
    return rounded(conformal.qhat(x, "s"), 6, "qhat")


def conformal_sets(s, d):
    x = probabilities(s, d)
    q = conformal.qhat(x.withColumn("s", conformal.nonconformity("p", "y")), "s").first()
    return conformal.sets(x, "p", F.lit(q["qhat"] if q else None), LEVELS).select("doc_id", "conjunto_conformal", "tamano_conjunto", "certeza_calibrada")


def conformal_coverage(s, d):
    order = F.expr("(doc_id * 7919 + rep * 104729) * (2 * rep + 1) % 1000003 * 1099511627776 + doc_id")
    return rounded(conformal.coverage(probabilities(s, d), "p", "y", order, 100), 6, "coverage", "set_size")


def linear_shapley(s, d):
    phi = [f"phi_{c}" for c in INDICES]
    return rounded(index.linear_attribution(T.labelled(s, d)), 5, *phi).select("cod_mpio", *phi)


def shapley_importance(s, d):
    x = index.linear_attribution(T.labelled(s, d))
    return rounded(index.mean_absolute(x, {f"phi_{c}": c for c in INDICES}), 5, "importance")


def stratified_split(s, d):
    x = T.table(s, d, "labels").select("doc_id", "quality")
    return model.stratified_split(x, "quality", F.expr("doc_id * 7919 % 10007 * 1099511627776 + doc_id"))


def split_table(s, d):
    x = T.labelled(s, d).withColumn("y", T.level_ordinal())
    return model.stratified_split(x, "y", model.hashed_order("cod_mpio"))


def fitted(s, d):
    """The model of the training rows, fitted by the first query that needs it."""
    def build():
        m = boosting.train(split_table(s, d).filter("is_test = 0"), "cod_mpio")
        return s.createDataFrame([(bytearray(pickle.dumps(m)),)], "model binary")

    return pickle.loads(materialised(s, "model", T.paths(d), build).first()["model"])  # noqa: S301


def predicted(s, d):
    """Probabilities of every territory, written by the first query that needs them."""
    return materialised(s, "predictions", T.paths(d), lambda: boosting.predict(fitted(s, d), split_table(s, d)))


def model_train_predict(s, d):
    p = predicted(s, d)
    return rounded(p, 6, "confianza").select("cod_mpio", "riesgo_nivel", "riesgo_pred", "confianza", "is_test")


def model_evaluation(s, d):
    """Test rows: a row per level with its precision, recall, F1 and confusion counts,
    beside accuracy, baseline and macro F1 of all."""
    p = predicted(s, d).filter("is_test = 1").select("y", C.ordinal_of("riesgo_pred", LEVELS).alias("yhat"))
    each = metrics.per_class(p, "y", "yhat").join(metrics.confusion(p, "y", "yhat", [0, 1, 2, 3]).withColumnRenamed("y", "label"), "label", "left")
    total = metrics.summary(p, "y", "yhat").first()
    out = each.withColumns({c: F.lit(total[c] if total else None) for c in ("accuracy", "baseline", "macro_f1", "n")})
    return rounded(out, 6, "precision", "recall", "f1", "accuracy", "baseline", "macro_f1")


def model_importances(s, d):
    return rounded(boosting.importances(fitted(s, d), T.labelled(s, d)), 5, "importance")


def model_attributions(s, d):
    return rounded(boosting.attributions(fitted(s, d), T.labelled(s, d), "cod_mpio"), 5, "phi")


def model_sets(s, d):
    """Conformal sets of every territory, calibrated on all test rows."""
    p = predicted(s, d)
    test = p.filter("is_test = 1").withColumn("s", conformal.nonconformity("p", "y"))
    q = conformal.qhat(test, "s").first()
    return conformal.sets(p, "p", F.lit(q["qhat"] if q else None), LEVELS).select("cod_mpio", "riesgo_pred", F.round("confianza", 6).alias("confianza"), "conjunto_conformal", "tamano_conjunto", "certeza_calibrada")


def model_coverage(s, d):
    """Coverage of the model's sets over a hundred halves of the test rows."""
    p = predicted(s, d).filter("is_test = 1")
    return rounded(conformal.coverage(p, "p", "y", F.xxhash64("cod_mpio", "rep"), 100), 6, "coverage", "set_size")


def flagged(s, d):
    return anomaly.isolation_forest(T.labelled(s, d), INDICES, "cod_mpio")


def isolation_forest(s, d):
    return flagged(s, d).select("cod_mpio", "riesgo_nivel", "score_anomalia", "es_anomalia")


def score_flags(s, d):
    """The anomaly flag, ranking and cross table on the composite score, which SQL repeats."""
    return anomaly.flag(T.labelled(s, d), "riesgo_score")


def top_importances(s, d):
    return shapley_importance(s, d).orderBy(F.desc("importance"), "feature").limit(4)


def traits(texts):
    """Stands in for an embedding service: three counts of a text."""
    return [[float(len(t)), float(t.count("a")), float(t.count(" "))] for t in texts]


def embedded_batches(s, d):
    x = retrieval.embedded(T.table(s, d, "benchmark"), "text", traits, 64)
    unit = retrieval.l2_normalised(F.col("vector"))
    return x.select("item_id", *[C.half_up(unit[i], 6).alias(n) for i, n in enumerate(("x", "y", "z"))])


def assistant_answer(s, d):
    """A question put to the six nearest chunks; the stand-in service answers with what it was asked."""
    e = T.table(s, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()
    known = e.join(T.table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("texto")), "vec_id").select(F.col("vec_id").alias("id"), "texto", F.col("embedding").alias("vector"))
    got = retrieval.ask("Which come first?", known, lambda _: [q[0] if q else []], lambda messages: messages[1]["content"])
    return s.createDataFrame([(got["answer"], len(got["sources"]))], "answer string, sources int")


def cosine_topk(s, d):
    e = T.table(s, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()  # the question's vector
    return retrieval.retrieve(e, q[0] if q else [], 6).select("vec_id", "label", "score")


def vector_norms(s, d):
    return T.table(s, d, "embeddings").select("vec_id", C.half_up(retrieval.norm(F.col("embedding")), 4).alias("length"))


def fact_chunks(s, d):
    text = F.format_string(
        "%s, department %d: level %s, score %.4f. Indices: mining %.4f, forest %.4f, fire %.4f, water %.4f, sensitivity %.4f. %d titles, %d hot spots in seven days, %d protected areas.",
        "municipio", "departamento", "riesgo_nivel", "riesgo_score", *INDICES, "mineria_titulos", "focos_7d", "runap_areas",
    )
    return T.labelled(s, d).select(F.concat(F.lit("mun-"), "cod_mpio").alias("id"), F.lit("municipio").alias("tipo"), "municipio", text.alias("texto"))


def distribution_chunk(s, d):
    counts = [F.count_if(F.col("riesgo_nivel") == v) for v in reversed(LEVELS)]
    text = F.format_string(f"Levels of %d territories: {LEVELS[3]} %d, {LEVELS[2]} %d, {LEVELS[1]} %d, {LEVELS[0]} %d. Territories with active hot spots: %d.", F.count(F.lit(1)), *counts, F.count_if(F.col("focos_7d") > 0))
    return T.labelled(s, d).agg(text.alias("texto")).select(F.lit("resumen-distribucion").alias("id"), F.lit("resumen").alias("tipo"), F.lit("").alias("municipio"), "texto")


def summary_chunks(s, d):
    x = T.labelled(s, d)
    by = lambda ident, title, col, fmt: retrieval.ranking_chunk(x, ident, title, col, "cod_mpio", "municipio", "departamento", fmt)
    parts = [
        by("resumen-nacional-focos", "Most active hot spots in seven days", "focos_7d", "%d"),
        by("resumen-nacional-score", "Highest priority score", "riesgo_score", "%.4f"),
        distribution_chunk(s, d),
        retrieval.group_chunks(x, "departamento", "cod_mpio", "municipio", F.col("riesgo_nivel").isin(*HIGH), "riesgo_score", "focos_7d"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def document_chunks(s, d):
    return retrieval.chunk(T.table(s, d, "documents"), "doc_id", "text", "\n")


def fact_corpus(s, d):
    """Every kind of chunk in one table: facts, summaries, knowledge, documents."""
    docs = document_chunks(s, d).select("id", F.lit("doc").alias("tipo"), F.lit("").alias("municipio"), "texto")
    return fact_chunks(s, d).unionByName(summary_chunks(s, d)).unionByName(retrieval.knowledge(s)).unionByName(docs)


def prompt_context(s, d):
    """The whole texts of the six documents nearest to a question's vector, in order."""
    e = T.table(s, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()  # the question's vector
    known = e.join(T.table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    near = retrieval.retrieve(known, q[0] if q else [], 6).withColumn("place", F.struct((-F.col("score")).alias("s"), "vec_id"))
    return retrieval.context(near, "vec_id", "text", "place")


def pixels(s, d):
    o, p, u = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    x = T.table(s, d, "lineitem").select(
        (o % 64).alias("row"), (p % 64).alias("col"), (u % 25).alias("zone"),
        ((o * 13 + p * 7) % 9000).cast("double").alias("nir0"), ((o * 5 + u * 11) % 4000).cast("double").alias("red0"),
        ((o * 17 + p * 3) % 9000).cast("double").alias("nir1"), ((o * 19 + u * 23) % 6000).cast("double").alias("red1"),
    )
    return x.withColumns({"v0": raster.ndvi(F.col("nir0"), F.col("red0")), "v1": raster.ndvi(F.col("nir1"), F.col("red1"))})


def ndvi_loss_zonal(s, d):
    return raster.zonal(pixels(s, d).withColumn("lost", raster.loss(F.col("v0"), F.col("v1"))), "zone", "lost")


def raster_crop(s, d):
    x = pixels(s, d)
    a = x.filter("row < 40").groupBy("row", "col").agg(F.max("v0").alias("v"))
    b = x.filter("col < 48").groupBy("row", "col").agg(F.max("v1").alias("v"))
    return raster.cropped(a, b, "v", ("v0", "v1")).agg(F.count(F.lit(1)).alias("pixels"), F.sum(raster.loss(F.col("v0"), F.col("v1"))).alias("lost"))


def raster_tiles(s, d):
    return rounded(raster.tiles(pixels(s, d).withColumn("ok", F.col("nir0") > 3600), 16, "ok"), 6, "valid_share")


def mask_iou(s, d):
    return rounded(raster.iou(pixels(s, d), F.col("v0"), F.col("v1")), 6, "iou")


GRID = (0.2, 0.0, -79.0, 0.0, -0.25, 13.0)


def grid(s, d):
    """One value per pixel of a 64 x 64 raster over the territories."""
    lost = raster.loss(F.col("v0"), F.col("v1"))
    return pixels(s, d).groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.max(lost).alias("lost"), F.max("nir0").alias("nir"))


def zonal_polygons(s, d):
    return raster.zonal_polygons(grid(s, d), polygons(s, d), GRID, "lost")


def raster_patches(s, d):
    return rounded(raster.patches(grid(s, d).withColumn("ok", F.col("nir") > 3600), 16, 8, 64, 64, "ok"), 6, "valid_share")


def land_cover_resampled(s, d):
    """Tree cover of a coarse land-cover raster on the pixels of a finer one."""
    cover = grid(s, d).select("row", "col", (F.col("nir").cast("long") % 3 * 10).alias("cover"))
    fine = (0.1, 0.0, -79.03, 0.0, -0.1, 13.04)
    target = s.range(100).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(129))).alias("col"))
    got = raster.resampled(target, cover, fine, GRID, "cover")
    return got.select("row", "col", F.when(F.col("cover").isNotNull(), raster.is_forest(F.col("cover"))).alias("forest"))


def reflectance(s, d):
    return pixels(s, d).groupBy("zone").agg(F.max(C.half_up(raster.scaled(F.col("nir0") * 2), 4)).alias("most"), F.min(C.half_up(raster.scaled(F.col("nir0") * 2), 4)).alias("least"))


def mask_difference(s, d):
    m = raster.mask_loss((F.col("v0") > 0.5).cast("int"), (F.col("v1") > 0.5).cast("int"))
    return pixels(s, d).groupBy("zone").agg(F.sum(m).alias("lost"))


def quality_violations(s, d):
    unit = F.lit(True)
    for c in (*INDICES, "riesgo_score"):
        unit = unit & F.col(c).between(0, 1)
    x = T.labelled(s, d)
    bad = report.violations(x, {
        "outside": F.col("lat").between(-4.5, 13.5) & F.col("lon").between(-82, -66), "out_of_range": unit,
        "water_without_sample": (F.col("agua_estaciones") > 0) | (F.col("idx_hidrico") == 0), "unknown_level": F.col("riesgo_nivel").isin(*LEVELS),
    })
    keys = x.agg((F.count(F.lit(1)) - F.count_distinct("cod_mpio")).alias("k"), F.count_distinct("riesgo_nivel").alias("l")).first()
    return bad.withColumns({"repeated_keys": F.lit(keys["k"]), "levels": F.lit(keys["l"])})


def hotspot_windows(s, d):
    days = F.explode(F.sequence(F.lit(0), F.lit(6)))
    x = T.hotspots(s, d).groupBy("sensor", "acq_date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("frp").cast("decimal(18,4)")).alias("v")).withColumn("k", days)
    return x.groupBy("sensor", F.date_sub("acq_date", F.col("k")).alias("first_day")).agg(F.sum("n").alias("focos"), F.sum("v").cast("double").alias("frp_total"))


def hotspot_stream(s, d):
    """Daily totals kept up to date by a stream of the event files."""
    schema = T.table(s, d, "events").schema
    e = live.stream(s, d, schema, names="events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    totals = e.groupBy(F.col("event_type").alias("sensor"), F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("focos"), C.decimal_sum("value").alias("frp_total"))
    totals = totals.select("sensor", F.to_date("w.start").alias("day"), "focos", "frp_total")
    return live.refreshed_table(s, totals, ["sensor", "day"], scratch_path(s, "hotspots"))


def hotspot_windows_stream(s, d):
    """Sliding windows of seven days over the same stream."""
    e = live.stream(s, d, T.table(s, d, "events").schema, names="events.parquet")
    w = live.windowed(e.withColumnRenamed("event_type", "sensor"), "ts", "sensor", "value")
    w = w.select("sensor", F.to_date("start").alias("first_day"), "focos", "frp_total")
    return live.refreshed_table(s, w, ["sensor", "first_day"], scratch_path(s, "windows"))


def trace_tables(s, d):
    """(kind, name, value): indicators of the whole table, coverage, and assertions that
    hold (1) or do not (0)."""
    x = T.labelled(s, d)
    signals = {"mineria_titulos": "mining", "deforestacion_ha": "forest", "agua_estaciones": "water", "runap_areas": "protected", "es_pdet": "pdet"}
    one = lambda c: F.sum(c.cast("decimal(20,4)")).cast("double")
    facts = {"territories": F.count(F.lit(1)).cast("double"), "hot_spots": one(F.col("focos_7d")), "with_fire": one((F.col("focos_7d") > 0).cast("int")), "high": one(F.col("riesgo_nivel").isin(*HIGH).cast("int")), "top_score": F.max("riesgo_score")}
    checks = {"keys_unique": F.count(F.lit(1)) == F.count_distinct("cod_mpio"), "scores_in_range": F.min(F.col("riesgo_score").between(0, 1)), "no_water_without_sample": F.min((F.col("agua_estaciones") > 0) | (F.col("idx_hidrico") == 0)), "four_levels": F.count_distinct("riesgo_nivel") <= 4}
    row = x.agg(*[c.alias(f"f_{n}") for n, c in facts.items()], *[c.cast("double").alias(f"a_{n}") for n, c in checks.items()])
    parts = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("name"), F.col(f"{p}_{n}").alias("value")) for kind, p, names in (("indicator", "f", facts), ("assertion", "a", checks)) for n in names]
    listed = row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    cover = report.coverage(x, signals).select(F.lit("coverage").alias("kind"), F.col("signal").alias("name"), F.col("percent").alias("value"))
    return listed.unionByName(cover)


QUERIES = {
    "territory_master": T.master,
    "code_conformance": code_conformance,
    "name_normalise_join": name_normalise_join,
    "nearest_centroid": nearest_centroid,
    "nearest_radius_sum": nearest_radius_sum,
    "bbox_filter": lambda s, d: spatial.inside(T.hotspots(s, d), (-75.0, 0.0, -70.5, 5.25)).select("event_id", "lat", "lon"),
    "point_in_polygon": lambda s, d: spatial.assign_polygons(T.hotspots(s, d), polygons(s, d), "event_id"),
    "area_of_interest": lambda s, d: spatial.area_of_interest(polygons(s, d), [1, 3, 5]),
    "hotspot_aggregate": hotspot_aggregate,
    "hotspot_windows": hotspot_windows,
    "hotspot_stream": hotspot_stream,
    "source_registry": lambda s, d: readers.catalogue(s),
    "index_logminmax": lambda s, d: T.labelled(s, d).select("cod_mpio", *INDICES),
    "risk_score_level": T.labelled,
    "master_by_code": lambda s, d: T.labelled(s, d).orderBy("cod_mpio").select("cod_mpio", "municipio", "riesgo_nivel"),
    "score_minmax": lambda s, d: index.minmax(T.labelled(s, d), "riesgo_score", "relative").select("cod_mpio", "relative"),
    "coordinates_present": coordinates_present,
    "hotspot_windows_stream": hotspot_windows_stream,
    "trace_tables": trace_tables,
    "top6_per_department_focos": lambda s, d: report.top_per_group(T.labelled(s, d).filter("focos_7d > 0"), 6, "departamento", "focos_7d", "cod_mpio").select("departamento", "cod_mpio", "focos_7d", "place"),
    "level_distribution": lambda s, d: report.frequency(T.labelled(s, d), "riesgo_nivel"),
    "level_monotonicity": level_monotonicity,
    "signal_coverage": signal_coverage,
    "signals_per_territory": signals_per_territory,
    "top10_score": lambda s, d: report.top(T.labelled(s, d), 10, "riesgo_score", "cod_mpio").select("cod_mpio", "municipio", "riesgo_score", "riesgo_nivel"),
    "top15_score": lambda s, d: report.top(T.labelled(s, d), 15, "riesgo_score", "cod_mpio").select("cod_mpio", "municipio", "riesgo_score"),
    "top_frp": lambda s, d: report.top(T.fire(s, d), 10, "frp_total", "cod_mpio").select("cod_mpio", "focos_7d", "frp_total"),
    "top6_max_priority": lambda s, d: report.top(T.labelled(s, d).filter(F.col("riesgo_nivel").isin(*HIGH) & (F.col("focos_7d") > 0)), 6, "frp_total", "cod_mpio").select("cod_mpio", "frp_total"),
    "top6_per_department": lambda s, d: report.top_per_group(T.labelled(s, d), 6, "departamento", "riesgo_score", "cod_mpio").select("departamento", "cod_mpio", "riesgo_score", "place"),
    "department_rollup": department_rollup,
    "priority_cross": priority_cross,
    "fire_high_intersect": fire_high_intersect,
    "fire_high_difference": fire_high_difference,
    "choropleth_values": choropleth_values,
    "dominant_factor": dominant_factor,
    "territory_card": territory_card,
    "territory_card_model": territory_card_model,
    "view_filter": view_filter,
    "display_clip": display_clip,
    "name_override": name_override,
    "sensor_union": sensor_union,
    "duplicate_keys": lambda s, d: territory.duplicate_keys(T.table(s, d, "orders"), "o_custkey"),
    "confusion_matrix": lambda s, d: metrics.confusion(predictions(s, d), "y", "yhat", [0, 1]),
    "class_metrics": class_metrics,
    "majority_baseline": majority_baseline,
    "conformal_qhat": conformal_qhat,
    "conformal_sets": conformal_sets,
    "conformal_coverage": conformal_coverage,
    "linear_shapley": linear_shapley,
    "shapley_importance": shapley_importance,
    "stratified_split": stratified_split,
    "model_train_predict": model_train_predict,
    "model_evaluation": model_evaluation,
    "model_importances": model_importances,
    "model_attributions": model_attributions,
    "model_sets": model_sets,
    "model_coverage": model_coverage,
    "isolation_forest": isolation_forest,
    "anomaly_top10": lambda s, d: anomaly.ranked(flagged(s, d), "cod_mpio").select("cod_mpio", "riesgo_nivel", "score_anomalia", *INDICES),
    "anomaly_cross": lambda s, d: anomaly.crossed(flagged(s, d)),
    "score_flags": lambda s, d: score_flags(s, d).select("cod_mpio", "score_anomalia", "es_anomalia"),
    "score_flags_cross": lambda s, d: anomaly.crossed(score_flags(s, d)),
    "score_flags_top10": lambda s, d: anomaly.ranked(score_flags(s, d), "cod_mpio").select("cod_mpio", "score_anomalia"),
    "top_importances": top_importances,
    "embedded_batches": embedded_batches,
    "assistant_answer": assistant_answer,
    "cosine_topk": cosine_topk,
    "vector_norms": vector_norms,
    "document_chunks": document_chunks,
    "summary_chunks": summary_chunks,
    "fact_corpus": fact_corpus,
    "knowledge_base": lambda s, d: retrieval.knowledge(s),
    "prompt_context": prompt_context,
    "ndvi_loss_zonal": ndvi_loss_zonal,
    "raster_crop": raster_crop,
    "raster_tiles": raster_tiles,
    "mask_iou": mask_iou,
    "mask_difference": mask_difference,
    "zonal_polygons": zonal_polygons,
    "raster_patches": raster_patches,
    "land_cover_resampled": land_cover_resampled,
    "reflectance": reflectance,
    "quality_violations": quality_violations,
    **R.QUERIES,
}
