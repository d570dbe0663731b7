"""Frequencies, coverage, rankings, rollups and cards for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.operators.stats import percentile


def frequency(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def coverage(df: DataFrame, signals: dict[str, str], digits: int = 2) -> DataFrame:
    """(signal, n, percent): rows in which each column is positive. One pass."""
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c) > 0).alias(c) for c in signals])
    k = 10**digits
    parts = [F.struct(F.lit(label).alias("signal"), F.col(c).alias("n"), (F.floor(F.col(c) * 100 * k / F.greatest(F.col("total"), F.lit(1)) + 0.5) / k).alias("percent")) for c, label in signals.items()]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def signals_present(cols: list[str]) -> Column:
    """Number of positive columns of a row."""
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))
    return out


def top(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """The n rows with the largest value, ties by key."""
    return df.orderBy(F.col(by).desc(), F.col(key)).limit(n)


def top_per_group(df: DataFrame, n: int, group: str, by: str, key: str) -> DataFrame:
    """n rows per group with their place; groups are cut before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(key))
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def level_ranges(df: DataFrame, level: str, value: str, order: Column) -> DataFrame:
    """(level, lo, hi, previous_hi, overlaps) of the levels in order."""
    rows = df.groupBy(level).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    before = F.lag("hi").over(Window.orderBy(order))  # one row per level
    return rows.withColumn("previous_hi", before).withColumn("overlaps", F.coalesce((F.col("previous_hi") >= F.col("lo")).cast("int"), F.lit(0)))


def rollup_groups(df: DataFrame, group: str, high: Column, value: str, key: str, n: int = 6, events: str | None = None) -> DataFrame:
    """(group, total, high, events, leaders): the groups that have a high row or an
    event; leaders are the n highest rows' keys, joined. Ranks are cut to n per
    group before anything is collected."""
    ev = F.col(events) if events else F.lit(0)
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.sum(high.cast("int")).alias("high"), F.sum(ev).alias("events"))
    leaders = top_per_group(df.filter(high), n, group, value, key).groupBy(group)
    listed = leaders.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", key))), lambda r: r[key].cast("string")), ", ").alias("leaders"))
    return base.filter((F.col("high") > 0) | (F.col("events") > 0)).join(listed, group, "left").withColumn("leaders", F.coalesce("leaders", F.lit("")))


def card(df: DataFrame, condition: Column, fields: dict[str, Column]) -> DataFrame:
    """(field, value) rows of one entity."""
    parts = [F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()]
    return df.filter(condition).select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def clipped(df: DataFrame, value: str, name: str, p: float = 0.97) -> DataFrame:
    """Value cut at a percentile of the positive ones, for display."""
    cut = percentile(df.filter(F.col(value) > 0), value, p).agg(F.max("p")).scalar()
    return df.withColumn(name, F.least(F.col(value), cut))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: for every named condition the number of rows that break it."""
    return df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
