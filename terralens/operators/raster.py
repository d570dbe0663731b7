"""Raster operators on pixels in long form (scene, row, col, bands)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.operators.spatial import assign_polygons

HECTARES_PER_PIXEL = 0.01


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / (nir + red + F.lit(1e-6))


def scaled(band: Column) -> Column:
    """Reflectance from digital numbers, within [0, 1]."""
    return F.least(F.greatest(band / F.lit(10000.0), F.lit(0.0)), F.lit(1.0))


def cropped(a: DataFrame, b: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
    """Two dates on their common pixels."""
    return a.select("row", "col", F.col(value).alias(names[0])).join(b.select("row", "col", F.col(value).alias(names[1])), ["row", "col"])


def loss(before: Column, after: Column, threshold: float = 0.15, forest: float = 0.6) -> Column:
    """1 where forest before has dropped by more than the threshold."""
    return ((before > forest) & (before - after > threshold)).cast("int")


def mask_loss(before: Column, after: Column) -> Column:
    """1 where a mask was set and no longer is."""
    return ((before == 1) & (after == 0)).cast("int")


def centre(transform: tuple[float, ...], row: Column, col: Column) -> tuple[Column, Column]:
    """(x, y) of a pixel's centre; ``transform`` is (a, b, c, d, e, f) with
    x = a col + b row + c and y = d col + e row + f at the pixel's corner."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in transform)
    col, row = col + F.lit(0.5), row + F.lit(0.5)
    return a * col + b * row + c, d * col + e * row + f


def pixel_hectares(transform: tuple[float, ...]) -> float:
    """Area of a pixel from the transform, whose unit is a metre."""
    a, b, _, d, e, _ = transform
    return abs(a * e - b * d) / 10_000


def zonal(df: DataFrame, zone: str, flag: str, pixel_ha: float = HECTARES_PER_PIXEL) -> DataFrame:
    """(zone, ha_perdida) of the zones with any loss, two decimals, largest first."""
    n = df.groupBy(zone).agg(F.sum(flag).alias("n")).filter("n > 0")
    return n.select(zone, (F.floor(F.col("n") * pixel_ha * 100 + 0.5) / 100).alias("ha_perdida")).orderBy(F.desc("ha_perdida"), zone)


def zonal_polygons(pixels: DataFrame, polygons: DataFrame, transform: tuple[float, ...], flag: str, pixel_ha: float = HECTARES_PER_PIXEL, code: str = "cod") -> DataFrame:
    """(code, ha_perdida): flagged pixels whose centre lies in a polygon, largest first.
    Pixels are met with polygons by grid cell; those without the flag don't travel."""
    x, y = centre(transform, F.col("row"), F.col("col"))
    hit = pixels.filter(F.col(flag) == 1).select(F.struct("row", "col").alias("pixel"), y.alias("lat"), x.alias("lon"))
    return zonal(assign_polygons(hit, polygons, "pixel", code, outer=False).withColumn("_one", F.lit(1)), code, "_one", pixel_ha)


def resampled(target: DataFrame, source: DataFrame, to: tuple[float, ...], of: tuple[float, ...], value: str) -> DataFrame:
    """``target`` pixels with the value of the nearest ``source`` pixel, null outside.
    Both are (row, col, ...) in one coordinate system; ``to`` and ``of`` are their
    transforms. The centre of a target pixel lies in the source pixel nearest to it."""
    a, b, c, d, e, f = of
    det = a * e - b * d
    x, y = centre(to, F.col("row"), F.col("col"))
    dx, dy = x - F.lit(float(c)), y - F.lit(float(f))
    at = target.withColumns({"_col": F.floor((dx * e - dy * b) / det), "_row": F.floor((dy * a - dx * d) / det)})
    known = source.select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), value)
    return at.join(known, ["_row", "_col"], "left").drop("_row", "_col")


def tiles(df: DataFrame, size: int, valid: str, least: float = 0.6) -> DataFrame:
    """(tile_row, tile_col, pixels, valid_share) of tiles with enough valid pixels."""
    t = df.groupBy(F.floor(F.col("row") / size).cast("int").alias("tile_row"), F.floor(F.col("col") / size).cast("int").alias("tile_col"))
    t = t.agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col(valid).cast("int")).alias("ok"))
    return t.filter(F.col("ok") >= least * F.col("pixels")).select("tile_row", "tile_col", "pixels", (F.col("ok") / F.col("pixels")).alias("valid_share"))


def patches(df: DataFrame, size: int, stride: int, height: int, width: int, valid: str, least: float = 0.6) -> DataFrame:
    """(top, left, valid_share) of the square tiles that lie within height x width, every
    ``stride`` pixels, and whose valid share, of all their pixels, is large enough. A
    pixel belongs to as many tiles as overlap it; pixels that are missing are not valid.
    """
    def starts(at: str, end: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - F.lit(size - 1)) / stride)).cast("int")
        last = F.least(F.floor(F.col(at) / stride), F.lit((end - size) // stride)).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    if size > min(height, width):
        return df.sparkSession.createDataFrame([], "top int, left int, valid_share double")
    t = df.filter(F.col(valid)).select(F.explode(starts("row", height)).alias("i"), "col").select("i", F.explode(starts("col", width)).alias("j"))
    t = t.groupBy((F.col("i") * stride).alias("top"), (F.col("j") * stride).alias("left")).agg((F.count(F.lit(1)) / float(size * size)).alias("valid_share"))
    return t.filter(F.col("valid_share") >= least)


def segmented(tiles_df: DataFrame, predict, bands: str = "bands", name: str = "mask", threshold: float = 0.5) -> DataFrame:
    """With a mask per tile, by a network of the caller's: ``predict`` takes an array
    (tiles, ...) of float32 and returns probabilities; it is loaded once a task."""
    def run(batches):
        for pdf in batches:
            tiles = [np.asarray(list(v), np.float32) for v in pdf[bands]]
            alike = len({t.shape for t in tiles}) == 1
            got = predict(np.stack(tiles)) if alike else [predict(t[None])[0] for t in tiles]
            yield pdf.assign(**{name: [(np.asarray(p).reshape(-1) > threshold).astype(int).tolist() for p in got]})

    return tiles_df.mapInPandas(run, tiles_df.schema.simpleString()[7:-1] + f",{name}:array<int>")


def is_forest(land_cover: Column, tree_class: int = 10) -> Column:
    return (land_cover == tree_class).cast("int")


def iou(df: DataFrame, p: Column, truth: Column, threshold: float = 0.5) -> DataFrame:
    """One row: intersection, union and their ratio."""
    a, b = p > threshold, truth > threshold
    r = df.agg(F.count_if(a & b).alias("intersection"), F.count_if(a | b).alias("union_"))
    return r.select("intersection", "union_", F.coalesce(F.try_divide(F.col("intersection").cast("double"), F.col("union_").cast("double")), F.lit(0.0)).alias("iou"))
