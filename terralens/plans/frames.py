"""The driver's tables read as territories, events and pixels.

Coordinates and the like are integer arithmetic on keys, so any engine repeats
them. Territory = customer, mining titles = its orders, hot spots = events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.functions.conform import code, decimal_sum, half_up
from terralens.operators import index, territory
from terralens.schema import LEVELS
from terralens.session import materialised, written


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lat(k: Column) -> Column:
    return ((k.cast("long") * 7919) % 1700).cast("double") / 100 - 4


def lon(k: Column) -> Column:
    return ((k.cast("long") * 104729) % 1200).cast("double") / 100 - 79


def spine(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(code(k).alias("cod"), F.col("c_name").alias("municipio"), F.col("c_nationkey").alias("departamento"), lat(k).alias("lat"), lon(k).alias("lon"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(code("o_custkey").alias("cod"), "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select("event_id", F.col("event_type").alias("sensor"), F.col("value").alias("frp"), F.to_date("ts").alias("acq_date"), lat(k).alias("lat"), lon(k).alias("lon"), code("user_id").alias("cod"))


def last_days(df: DataFrame, date: str, days: int = 7) -> DataFrame:
    """Rows of the last days before the newest date of the table."""
    newest = df.agg(F.max(date)).scalar()
    return df.filter(F.col(date) > F.date_sub(newest, days))


def master(spark: SparkSession, d: str) -> DataFrame:
    """One row per territory, 15 columns."""
    s, t = spine(spark, d), titles(spark, d)
    known = territory.known_only(t, s)
    forest = F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_totalprice") / 100))
    ica = ((F.col("o_orderkey") * 37) % 140).cast("double") / 100 - 0.2
    sample = (F.col("o_orderkey") % 7 == 0) & ica.between(0, 1)
    area = F.col("o_orderstatus") == "F"
    # lines are summed per order before they meet the orders, and all that is keyed by
    # code is then one aggregate over one pass
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,4)")).alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("p"))
    with_lines = known.join(lines, known.o_orderkey == lines.l_orderkey, "left")
    per_code = territory.by_code(
        with_lines, "cod",
        F.count(F.lit(1)).cast("int").alias("mineria_titulos"),
        F.count_distinct(F.nullif(F.trim("o_orderpriority"), F.lit(""))).cast("int").alias("mineria_minerales"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("es_pdet"),
        F.max(forest).cast("double").alias("deforestacion_ha"),
        F.sum(F.when(sample, (F.col("o_orderkey") * 37) % 140 - 20)).alias("ica_sum"),
        F.count_if(sample).cast("int").alias("agua_estaciones"),
        F.count_if(area).cast("int").alias("runap_areas"),
        decimal_sum(F.when(area, F.col("o_totalprice"))).alias("runap_hectareas"),
        F.sum("q").cast("double").alias("mineria_volumen"),
        F.sum("p").cast("double").alias("mineria_regalias"),
    )
    zeros = ("mineria_titulos", "mineria_minerales", "mineria_volumen", "mineria_regalias", "es_pdet", "deforestacion_ha", "agua_estaciones", "runap_areas", "runap_hectareas")
    out = territory.assemble(s, [per_code], "cod", zeros)
    return out.select(
        F.col("cod").alias("cod_mpio"), "municipio", "departamento", "lat", "lon", "mineria_titulos", "mineria_minerales",
        half_up("mineria_volumen", 2).alias("mineria_volumen"), half_up("mineria_regalias", 2).alias("mineria_regalias"), "es_pdet", "deforestacion_ha",
        half_up(F.try_divide(F.col("ica_sum").cast("double"), F.col("agua_estaciones").cast("double") * 100), 4).alias("agua_ica_medio"), "agua_estaciones", "runap_areas", half_up("runap_hectareas", 2).alias("runap_hectareas"),
    )


def fire(spark: SparkSession, d: str) -> DataFrame:
    """(cod_mpio, focos_7d, frp_total, ultima_fecha) of the last seven days."""
    e = last_days(hotspots(spark, d), "acq_date")
    return e.groupBy(F.col("cod").alias("cod_mpio")).agg(F.count(F.lit(1)).cast("int").alias("focos_7d"), decimal_sum("frp").alias("frp_total"), F.max("acq_date").alias("ultima_fecha"))


SOURCES = ("customer", "orders", "lineitem", "events")


def paths(d: str, names: tuple[str, ...] = SOURCES) -> list[str]:
    return [f"{d}/{t}.parquet" for t in names]


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The master table with its indices, score and level: a row per territory, small
    beside the sources it sums up, and what most queries start from. So it is written
    by the first that needs it."""
    return materialised(spark, "labelled", paths(d), lambda: build_labelled(spark, d))


def build_labelled(spark: SparkSession, d: str) -> DataFrame:
    m = master(spark, d).join(fire(spark, d).drop("ultima_fecha"), "cod_mpio", "left").fillna(0, subset=["focos_7d", "frp_total"])
    m = m.withColumn("_raw", F.col("mineria_titulos") + F.col("mineria_volumen") / 1000)
    m = written(m, "territories")  # read for its bounds, its quantiles and the result
    m = index.log_minmax(m, {"_raw": "idx_minero", "deforestacion_ha": "idx_deforestacion", "runap_hectareas": "_sens"})
    m = index.fire_index(m, "frp_total")
    m = m.withColumns({"idx_hidrico": index.water_index("agua_ica_medio"), "idx_sensibilidad": index.raised("_sens", "es_pdet"), "hidrico_sin_dato": F.col("agua_ica_medio").isNull().cast("int")})
    m = m.withColumn("riesgo_score", index.score()).drop("_raw", "_sens")
    return index.with_level(m)


QUAD = ((-2.0, -0.5), (0.5, -2.0), (2.0, 0.5), (-0.5, 2.0))


def centroids(s, d):
    n = table(s, d, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("cod"), k.alias("ord"), lat(k).alias("lat"), lon(k).alias("lon"))


def polygons(s, d):
    corner = [F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in QUAD]
    return centroids(s, d).select("cod", "ord", F.array(*corner).alias("ring"))


def level_ordinal(c: str = "riesgo_nivel") -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), F.col(c)).cast("int") - 1
