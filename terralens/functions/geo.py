"""Spherical distance and the point-in-ring test, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Containment, edges included; box is lon_min, lat_min, lon_max, lat_max."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring (array of struct<lon, lat>): the number
    of edges that a ray to the east crosses is odd. An edge holds its lower end only,
    so shared vertices count once."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nxt, lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))

    def crossed(e):
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        rise = e["y2"] - e["y1"]
        at = F.try_divide((e["x2"] - e["x1"]) * (lat - e["y1"]), rise) + e["x1"]
        return spans & (lon < at)

    return F.size(F.filter(edges, crossed)) % 2 == 1


def ring_box(ring: Column) -> list[Column]:
    """lon_min, lat_min, lon_max, lat_max of a ring."""
    xs, ys = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return [F.array_min(xs).alias("lon_min"), F.array_min(ys).alias("lat_min"), F.array_max(xs).alias("lon_max"), F.array_max(ys).alias("lat_max")]
