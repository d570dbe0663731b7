"""Indices from 0 to 1, the weighted score and the quantile levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.functions.conform import half_up
from terralens.schema import LEVELS, WEIGHTS


def log_minmax(df: DataFrame, cols: dict[str, str], digits: int = 4) -> DataFrame:
    """``{value: index}``: (log1p v - lo) / (hi - lo) over the table, 0 where hi = lo.

    All bounds are one aggregate row, which becomes literals of the plan: no join
    and no window over the whole table.
    """
    bounds = df.agg(*[f(F.log1p(c)).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c, name in cols.items():
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        flat = lo is None or hi <= lo
        out[name] = F.lit(0.0) if flat else half_up((F.log1p(c) - F.lit(lo)) / (F.lit(hi) - F.lit(lo)), digits)
    return df.withColumns(out)


def minmax(df: DataFrame, value: str, name: str, digits: int = 4) -> DataFrame:
    """(v - lo) / (hi - lo + 1e-9) over the table."""
    lo, hi = (F.lit(x) for x in df.agg(F.min(value), F.max(value)).first())
    return df.withColumn(name, half_up((F.col(value) - lo) / (hi - lo + 1e-9), digits))


def fire_index(df: DataFrame, frp: str, name: str = "idx_fuego", digits: int = 4) -> DataFrame:
    """log1p(frp) over log1p of the largest, at most 1; 0 without fire."""
    top = df.agg(F.log1p(F.max(frp)).alias("top")).first()["top"] or 1.0
    return df.withColumn(name, half_up(F.least(F.lit(1.0), F.log1p(F.coalesce(F.col(frp), F.lit(0.0))) / F.lit(top)), digits))


def water_index(ica: str) -> Column:
    """1 - quality, 0 where there is no sample."""
    return F.coalesce(half_up(1 - F.col(ica), 4), F.lit(0.0))


def raised(index: str, flag: str, by: float = 0.25) -> Column:
    """Index plus a fixed amount where the flag is set, at most 1."""
    return half_up(F.least(F.lit(1.0), F.col(index) + F.lit(by) * F.col(flag)), 4)


def score(weights: dict[str, float] = WEIGHTS, digits: int = 4) -> Column:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(w) * F.col(c)
    return half_up(total, digits)


def order_statistics(df: DataFrame, value: str, places: tuple[float, ...]) -> list:
    """The values at place min(n - 1, floor(p n)) of the sorted column; None for an
    empty table. Values are counted first, so what is put in order is the distinct
    ones (10,001 at most for an index of four decimals), not the rows.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumns({"upto": F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy())})
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(f"{p:.6f}").cast("decimal(10,6)") * F.col("n")))
    return list(upto.agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"q{i}") for i, p in enumerate(places)]).first())


def with_level(df: DataFrame, value: str = "riesgo_score", name: str = "riesgo_nivel", places: tuple[float, float, float] = (0.60, 0.85, 0.95)) -> DataFrame:
    """Level by the table's own quantiles, inclusive from the top."""
    q = [F.lit(x) for x in order_statistics(df, value, places)]
    v = F.col(value)
    return df.withColumn(name, F.when(v >= q[2], LEVELS[3]).when(v >= q[1], LEVELS[2]).when(v >= q[0], LEVELS[1]).otherwise(LEVELS[0]))


def linear_attribution(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Exact Shapley values of the linear score: weight times distance from the mean."""
    means = df.agg(*[(F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count(c)).alias(c) for c in weights]).first()
    return df.withColumns({f"phi_{c}": F.lit(w) * (F.col(c) - F.lit(means[c])) for c, w in weights.items()})


def mean_absolute(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """(feature, importance): mean absolute value of each column."""
    row = df.agg(*[F.avg(F.abs(F.col(c)).cast("decimal(20,10)")).cast("double").alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).alias("importance")) for c, n in cols.items()])).alias("r")).select("r.*")
