"""Classification metrics from (truth, prediction) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    """One row per true label, one column ``pred_<label>`` per prediction."""
    out = df.groupBy(truth).pivot(pred, labels).agg(F.count(F.lit(1))).fillna(0)
    return out.select(truth, *[F.col(f"`{v}`").alias(f"pred_{v}") for v in labels])


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support); 0 where a ratio has no base."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    sides = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("c").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("t"), F.col("c").alias("p"))))
    hit = F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0)
    sums = pairs.select(sides.alias("s")).groupBy("s.label").agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"))
    hits = pairs.groupBy(F.col("t").alias("label")).agg(F.sum(hit).alias("hit"))
    r = sums.join(hits, "label", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    r = r.withColumn("precision", ratio("hit", "predicted")).withColumn("recall", ratio("hit", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return r.select("label", "precision", "recall", f1.alias("f1"), "support")


def summary(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: accuracy, share of the commonest true label (the smallest of equally
    common ones), that label, macro F1, n; none for an empty table."""
    labels = per_class(df, truth, pred)
    most = labels.agg(F.max("support")).scalar()
    hits = F.round(F.col("recall") * F.col("support"))
    row = labels.agg(
        (F.sum(hits) / F.sum("support")).alias("accuracy"), (F.max("support") / F.sum("support")).alias("baseline"),
        F.min(F.when(F.col("support") == most, F.col("label"))).cast("int").alias("majority"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"),
    )
    return row.filter("n > 0")
