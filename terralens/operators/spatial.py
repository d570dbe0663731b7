"""Spatial joins as equi-joins on grid cells.

Neither side is broadcast and no pair is formed outside neighbouring cells, so the
same plan serves thousands of centroids or millions. A cell that holds very many
points is one key of a sort-merge join, which adaptive execution splits on the points'
side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.functions.geo import EARTH_KM, haversine, in_bbox, in_ring, ring_box

_MARGIN = 1.0001


def _on_sphere(lat: Column, lon: Column, width: float) -> list[Column]:
    """Cell numbers of a place on the unit sphere, in a cubic grid."""
    a, o = F.radians(lat), F.radians(lon)
    return [F.floor(c / width) for c in (F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a))]


def nearest(points: DataFrame, centroids: DataFrame, radius_km: float, point_key: str, code: str = "cod", order: str = "ord") -> DataFrame:
    """(point_key, code, km): the nearest centroid of each point, if nearer than the
    radius; of equally near ones the first by ``order``. Both sides have lat and lon.

    Places are points of the unit sphere in a cubic grid whose cells are as wide as the
    radius' chord: what lies within the radius is in the same or a neighbouring cell,
    at the poles and across the date line too. A nearest centroid within the radius is
    the nearest of those within it, so only these are compared. Points without one are
    left out.
    """
    width = 2 * math.sin(min(math.pi, radius_km / EARTH_KM) / 2) * _MARGIN
    cells = ["cx", "cy", "cz"]
    lat, lon = F.col("lat"), F.col("lon")
    p = points.select(point_key, lat.alias("plat"), lon.alias("plon"), *[c.alias(n) for c, n in zip(_on_sphere(lat, lon, width), cells, strict=True)])
    c = centroids.select(code, order, lat.alias("clat"), lon.alias("clon"), *[c.alias(n) for c, n in zip(_on_sphere(lat, lon, width), cells, strict=True)])
    for n in cells:
        c = c.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    pairs = p.join(c, cells).withColumn("km", haversine(F.col("plat"), F.col("plon"), F.col("clat"), F.col("clon")))
    best = pairs.filter(F.col("km") < radius_km).groupBy(point_key).agg(F.min(F.struct("km", order, code)).alias("best"))
    return best.select(point_key, F.col(f"best.{code}").alias(code), F.col("best.km").alias("km"))


#: Finest cell in degrees, and how often it can be doubled (up to the whole globe).
FINEST, DOUBLINGS = 1 / 64, 15


def assign_polygons(points: DataFrame, polygons: DataFrame, point_key: str, code: str = "cod", order: str = "ord", outer: bool = True) -> DataFrame:
    """(point_key, code): the first polygon by ``order`` that holds the point; null
    where none does (left out unless ``outer``). ``polygons`` has a ring.

    A polygon is listed in a grid of cells at least as wide as its own box, so in four
    cells at most, however large it is. A point looks in one cell of each of the few
    grids that are in use, then at the box, then at the ring.
    """
    width = lambda level: F.lit(FINEST) * F.pow(F.lit(2.0), level)
    grid = lambda x, level: F.floor(x / width(level))
    q = polygons.select(code, order, "ring", *ring_box(F.col("ring")))
    span = F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"), F.lit(FINEST))
    q = q.withColumn("level", F.least(F.lit(DOUBLINGS), F.ceil(F.log2(span / F.lit(FINEST)))).cast("int"))
    levels = sorted(r[0] for r in q.select("level").filter("level IS NOT NULL").distinct().collect())  # DOUBLINGS + 1 at most
    for axis, name in (("lon", "gx"), ("lat", "gy")):
        q = q.withColumn(name, F.explode(F.sequence(grid(F.col(f"{axis}_min"), F.col("level")), grid(F.col(f"{axis}_max"), F.col("level")))))
    lon, lat = F.col("lon"), F.col("lat")
    p = points.select(point_key, "lat", "lon", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    p = p.withColumns({"gx": grid(lon, F.col("level")), "gy": grid(lat, F.col("level"))})
    box = lon.between(F.col("lon_min"), F.col("lon_max")) & lat.between(F.col("lat_min"), F.col("lat_max"))
    hits = p.join(q, ["level", "gx", "gy"]).filter(box & in_ring(lon, lat, F.col("ring")))
    first = hits.groupBy(point_key).agg(F.min(F.struct(order, code)).alias("first")).select(point_key, F.col(f"first.{code}").alias(code))
    return points.select(point_key).join(first, point_key, "left") if outer else first


def area_of_interest(polygons: DataFrame, codes: list) -> DataFrame:
    """Bounding box over the polygons of the given codes, one row."""
    boxes = polygons.filter(F.col("cod").isin(codes)).select(*ring_box(F.col("ring")))
    return boxes.agg(F.min("lon_min").alias("lon_min"), F.min("lat_min").alias("lat_min"), F.max("lon_max").alias("lon_max"), F.max("lat_max").alias("lat_max"))


def inside(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return df.filter(in_bbox(F.col("lon"), F.col("lat"), box))
