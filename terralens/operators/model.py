"""Splits of a labelled table into training and test rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.operators.stats import at_ranks


def stratified_split(df: DataFrame, label: str, order: Column, share: float = 0.25, name: str = "is_test") -> DataFrame:
    """Flag the first ``share`` of each class, in the given order, as test rows: the
    class's count times the share, rounded half up. ``order`` is a whole number, unlike
    for any two rows. Classes are few; their cut is sought by counts, not by sorting."""
    rows = df.withColumn("_order", order)
    wanted = F.floor(F.col("n") * F.lit(share) + 0.5)
    cut = at_ranks(rows, "_order", [label], [wanted - 1]).select(F.col(label).alias("_label"), F.when(wanted > 0, F.col("v0")).alias("_cut"))
    out = rows.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("_label")), "left")
    return out.withColumn(name, F.coalesce((F.col("_order") <= F.col("_cut")).cast("int"), F.lit(0))).drop("_order", "_label", "_cut")


def hashed_order(key: str, seed: int = 42) -> Column:
    """An order for ``stratified_split`` that any table has."""
    return F.xxhash64(key, F.lit(seed))
