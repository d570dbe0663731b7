"""Assembling one row per territory from sources of many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_only(df: DataFrame, spine: DataFrame, key: str = "cod") -> DataFrame:
    """Rows whose code is in the spine."""
    return df.join(spine.select(key).distinct(), key, "left_semi")


def by_code(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates per code, before any join; partial sums run in the map tasks."""
    return df.groupBy(key).agg(*aggregates)


def membership(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct codes with a flag 1, for a left join whose misses become 0."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(1))


def assemble(spine: DataFrame, sources: list[DataFrame], key: str = "cod", zeros: tuple[str, ...] = ()) -> DataFrame:
    """The spine with every aggregated source at its side. All are keyed by the
    code, so the joins share one partitioning; small sides are broadcast where
    their size allows it. Misses of the columns in ``zeros`` become 0."""
    out = reduce(lambda a, b: a.join(b, key, "left"), sources, spine)
    return out.fillna(0, subset=list(zeros)) if zeros else out


def by_name(df: DataFrame, names: DataFrame, name_col: str, key: str = "cod", order: str = "ord") -> DataFrame:
    """Rows joined to codes by normalised name. Where a name stands for several
    codes, the one listed last counts. ``names`` has (name_col, key, order)."""
    last = names.groupBy(name_col).agg(F.max_by(key, order).alias(key))
    return df.join(last, name_col)


def worst(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Largest positive value per code over all years."""
    return df.filter(F.col(value) > 0).groupBy(key).agg(F.max(value).alias(name))


def overwrite_names(df: DataFrame, names: DataFrame, key: str, cols: tuple[str, ...]) -> DataFrame:
    """Names from a master table where it knows the code, else the row's own."""
    m = names.select(key, *[F.col(c).alias(f"_m_{c}") for c in cols])
    out = df.join(m, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_m_{c}"), F.col(c)) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key).count().filter("count > 1")
