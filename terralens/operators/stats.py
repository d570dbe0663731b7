"""Exact order statistics of large columns, without sorting them or gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets a range of values is cut into.
BUCKETS = 4096


def at_ranks(df: DataFrame, value: str, groups: list[str], ranks: list[Column]) -> DataFrame:
    """(groups..., n, v0, v1, ...): the values at the given places, counted from 0, of
    each group's sorted column. A place is an expression of ``n``, the group's count of
    values; nulls don't count. Groups must be few (classes, repeats), not keys.

    The range of values is cut into buckets whose counts tell in which one a place
    falls; that one is cut again, and what is left, a sixteen-millionth of an even
    range, is counted by value. A task holds the counts of one group's buckets.
    ``df`` is read four times.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.lit(0).alias("_one"), F.col(value).alias("_v"))
    keys = ["_one", *(f"_g{i}" for i in range(len(groups)))]
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)])).alias("p")
    sought = bounds.select(*keys, "n", "lo", "hi", places).select(*keys, "n", "lo", "hi", "p.k", "p.rank", F.lit(0).cast("long").alias("before"))
    each = [*keys, "k"]
    upto = Window.partitionBy(*each)
    for last in (False, False, True):
        # a row per group and place
        near = rows.join(F.broadcast(sought), keys).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
        share = F.coalesce(F.try_divide(F.col("_v").cast("double") - lo, hi - lo), F.lit(0.0))
        bucket = F.col("_v") if last else F.floor(share * (BUCKETS - 1))
        counts = near.groupBy(*each, "n", "rank", "before", bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        counts = counts.withColumn("upto", F.col("before") + F.sum("c").over(upto.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).filter("upto > rank")
        first = F.min(F.struct("b", "lo", "hi", (F.col("upto") - F.col("c")).alias("before"))).alias("m")
        sought = counts.groupBy(*each, "n", "rank").agg(first).select(*each, "n", "rank", "m.lo", "m.hi", "m.before")
    found = sought.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("k") == i, F.col("lo"))).alias(f"v{i}") for i in range(len(ranks))])
    return found.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)], "n", *[f"v{i}" for i in range(len(ranks))])


def percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row (or none, without values): the p-quantile, interpolated between the two
    values around it."""
    at = F.lit(p) * (F.col("n") - 1)
    two = at_ranks(df, value, [], [F.floor(at), F.ceil(at)])
    share = at - F.floor(at)
    return two.select((F.col("v0") + (F.col("v1") - F.col("v0")) * share).alias("p"))
