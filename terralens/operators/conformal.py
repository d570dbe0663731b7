"""Conformal prediction sets over class probabilities (array column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.functions.conform import argmax, label_of
from terralens.operators.stats import at_ranks


def nonconformity(p: str, y: str) -> Column:
    """1 - probability of the true class."""
    return 1 - F.element_at(p, F.col(y).cast("int") + 1)


def _quantile(df: DataFrame, score: str, groups: list[str], alpha: float) -> DataFrame:
    """Per group the ``higher`` quantile at min(1, ceil((n + 1)(1 - alpha)) / n)."""
    keep = F.lit(1 - alpha).cast("decimal(10,6)")
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * keep) / F.col("n"))
    found = at_ranks(df, score, groups, [F.ceil(level * (F.col("n") - 1) - F.lit(1e-9))])
    return found.select(*groups, F.col("v0").alias("qhat"), F.col("n").alias("n_cal"))


def qhat(df: DataFrame, score: str, alpha: float = 0.1) -> DataFrame:
    """One row: qhat, n_cal; none for an empty table."""
    return _quantile(df, score, [], alpha)


def members(p: Column, q: Column) -> Column:
    """Classes with probability of at least 1 - qhat."""
    at = F.transform(p, lambda v, i: F.when(v >= 1 - q, i))
    return F.filter(at, lambda i: i.isNotNull())


def sets(df: DataFrame, p: str, q: Column, names: tuple[str, ...]) -> DataFrame:
    """With the set (labels joined), its size and certainty; an empty set gets the
    likeliest class."""
    m = members(F.col(p), q)
    m = F.when(F.size(m) == 0, F.array(argmax(p))).otherwise(m)
    out = df.withColumn("_m", m)
    joined = F.array_join(F.transform("_m", lambda i: label_of(i, names)), " / ")
    size = F.size("_m")
    certainty = F.when(size == 1, "Alta").when(size == 2, "Media").otherwise("Baja")
    return out.withColumns({"conjunto_conformal": joined, "tamano_conjunto": size, "certeza_calibrada": certainty}).drop("_m")


def coverage(df: DataFrame, p: str, y: str, order: Column, repeats: int = 100, alpha: float = 0.1) -> DataFrame:
    """(repeats, coverage, set_size): means over repeated halves, drawn class by class.
    ``order`` is a whole number in terms of column ``rep``, unlike for any two rows: of
    every class the half with the least ones calibrates (of an odd number the smaller
    half); the other rows are judged, with empty sets left empty."""
    rows = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumns({"_o": order, "_s": nonconformity(p, y), "_y": F.col(y)})
    middle = at_ranks(rows, "_o", ["rep", "_y"], [F.floor(F.col("n") / 2)]).select("rep", "_y", F.col("v0").alias("_cut"))
    rows = rows.join(F.broadcast(middle), ["rep", "_y"])  # a row per repeat and class
    q = _quantile(rows.filter("_o < _cut"), "_s", ["rep"], alpha)
    judged = rows.filter("_o >= _cut").join(F.broadcast(q), "rep").withColumn("_m", members(F.col(p), F.col("qhat")))
    each = judged.groupBy("rep").agg(F.avg(F.array_contains("_m", F.col(y).cast("int")).cast("double")).alias("c"), F.avg(F.size("_m").cast("double")).alias("z"))
    return each.agg(F.count(F.lit(1)).alias("repeats"), F.avg("c").alias("coverage"), F.avg("z").alias("set_size"))
